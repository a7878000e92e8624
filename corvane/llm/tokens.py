"""Tokenizing with a public vocabulary inside Arrow batches, through a bounded cache of words.

White space never takes part in a token of this vocabulary and no token crosses it, so a text's ids are the ids of its
white-space separated chunks, one after another. Chunks repeat; a worker encodes each once while the cache has room.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

#: Chunks a worker remembers, and the most characters of one (about 130 MB in all); others are encoded each time.
CACHE_WORDS, CACHE_CHARS = 600_000, 32
#: The id that ends each document.
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

#: Characters that str.split takes for white space, but this tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"

_encoders: dict[str, WordEncoder] = {}

#: This vocabulary's pre-tokenizer pattern, and characters that NFC leaves alone one by one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[\x21-\x7e\u00a1-\u017f]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """A text cut at white space as tokenizers know it: str.split, but for four separators that it takes for space."""
    if any(c in text for c in SEPARATORS):
        return [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w]
    return text.split()


class WordEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; as a dict, the ids of the chunks met so far.

    A chunk of Latin letters and signs is lowered and cut here, so that variants in case and punctuation share one run of
    the merges; any other chunk goes through the whole tokenizer. Both give the tokenizer's own ids (tests compare them).
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.room = cache_words
        self.plain, self.pieces = regex.compile(PLAIN).fullmatch, regex.compile(PIECES).findall
        self.bytes_as_text = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xA1, 0x180))})

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.translate(self.bytes_as_text)
        return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not self.plain(chunk) or "<|" in chunk:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        elif (low := chunk.lower()) != chunk:
            ids = self[low] if self.plain(low) else np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        elif chunk.isalpha():
            ids = self._piece(chunk)
        elif chunk[:-1].isalpha():
            ids = self[chunk[:-1]] + (self[chunk[-1]] if len(chunk) > 1 else b"")
        else:
            ids = b"".join([self[p] if p.isalpha() else self._piece(p) for p in self.pieces(chunk)])
        if self.room > 0 and len(chunk) <= CACHE_CHARS:
            self.room -= 1
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, without the end id; null is the empty text."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, chunks(text)))


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batches: Iterator, texts: str, most_chars: int = 4_000_000) -> Iterator:
    """Record batches cut so that each holds a few million characters, or one text."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(texts)), 0))
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
