"""Token counts (operator 5): Viterbi over a unigram vocabulary that carries counts instead of pieces.

An Aho-Corasick automaton enumerates every vocabulary match in a word; for each end the best score and its number of pieces
are kept. Tie rules are the tokenizer's: scores are added in double precision from the left; of equal scores the piece that
begins first wins; a character that is no piece by itself may be unknown, at the least score less 10, and neighbouring unknown
characters are one piece. Words are parted at white space and marked in front, so no piece crosses words and each worker
remembers the counts of words it has met, up to a bound.

The vocabulary is that of a public piece file, in its order; where its scores are ranks, the unigram model takes Zipf's law:
the piece of rank r has probability proportional to 1 / (r + 1).

Cases: null and empty texts have no tokens; repeated rows are counted one by one; an empty table gives no rows; columns of
other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, text_of
from .tokens import CACHE_CHARS, chunks, slices, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_000_000

_counters: dict[str, PieceCounter] = {}


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentencepiece file with log-probabilities by Zipf's law; the unknown piece comes first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return [("<unk>", 0.0), *((p, -log(r + 1) - log(total)) for r, p in enumerate(pieces))]


class PieceCounter(dict):
    """As a dict: the number of pieces of the words met so far."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = CACHE_WORDS):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in vocabulary[1:] if len(piece) == 1}
        self.room = cache_words

    def count(self, marked: str) -> int:
        """Pieces of the best segmentation of one string."""
        n = len(marked)
        best, pieces, ends_unknown = [-inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0  # ends up to here are settled

        def settle(end: int) -> None:
            """The last candidate at an end is the unknown character before it."""
            if marked[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end] = best[end - 1] + self.unknown
                pieces[end] = pieces[end - 1] + (not ends_unknown[end - 1])
                ends_unknown[end] = True

        for last, (length, score) in self.automaton.iter(marked):
            end = last + 1
            while done < end - 1:
                done += 1
                settle(done)
            # Matches of one end come longest first, so the first of equal scores begins first.
            start = end - length
            if score + best[start] > best[end]:
                best[end], pieces[end], ends_unknown[end] = score + best[start], pieces[start] + 1, False
        while done < n:
            done += 1
            settle(done)
        return pieces[n]

    def __missing__(self, word: str) -> int:
        n = self.count(word if word.startswith(MARK) else MARK + word)
        if self.room > 0 and len(word) <= CACHE_CHARS:
            self.room -= 1
            self[word] = n
        return n


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(zipf_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in slices(batches, "text"):
            counts = [sum(map(known.__getitem__, chunks(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
