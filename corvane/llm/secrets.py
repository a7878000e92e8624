"""Secret scans (operator 1), in DataFrame functions only: fixed patterns, then character Markov models.

The patterns give spans by kind (assign, access, hex), leftmost and non-overlapping in each. Candidates of the models are
runs of ``MIN_RUN`` or more token characters, a letter among them, that touch no pattern span. Two first-order Markov chains
over characters, upper and lower case apart, are trained from labelled samples. Random: ``RANDOM_STRINGS`` digests of numbers
written in each of several alphabets, as keys and tokens are, and the values that the patterns found in the corpus. Ordinary:
words and identifiers in at most ``ORDINARY_DOCUMENTS`` documents, those with the least hash of their text, as they stand,
joined to identifiers and paths, with numbers, and in capitals. A candidate is a secret if its log-likelihood ratio reaches ``MIN_TOTAL`` and ``MIN_MEAN`` a
transition; in whole thousandths of a nat, so that sums don't depend on their order.

Places are code points, ends exclusive. They come from the pieces between matches: the pattern splits the text, and a match
begins where the pieces and matches before it end. Running sums go by blocks, so that a text of many spans stays cheap.

Cases: a null text is empty and has no spans; a corpus without words leaves the ordinary chain even; very long texts are one
row, and each span of one is found; repeated rows are scanned one by one; an empty table gives no rows; columns of other names
are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, table, text_of

#: What the base rules look for, and the least length they keep.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
ORDINARY = r"[A-Za-z]{4,}(?:[_-][A-Za-z]+)*"
#: Bounds of the labelled samples.
RANDOM_STRINGS, ORDINARY_DOCUMENTS = 1_000, 500
#: States of the chains; any other character is the last state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
MIN_TOTAL, MIN_MEAN = 30_000, 1_800
SPAN = "struct<start:int,rank:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of ints under an associative ``merge`` (a sum, a maximum): blocks of the root of its size."""

    def scan(block: Column) -> Column:
        return F.aggregate(F.slice(block, 2, F.size(block)), F.slice(block, 1, 1), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def in_blocks(all_values: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(all_values), step), lambda s: scan(F.slice(all_values, s, step)))

        def joined(done: Column) -> Column:
            # Each block goes on from the end of those before it.
            ends = scan(F.transform(done, lambda b: F.element_at(b, -1)))
            pairs = F.arrays_zip(done.alias("own"), F.concat(F.array(F.lit(None).cast("int")), F.slice(ends, 1, F.size(ends) - 1)).alias("before"))
            return F.flatten(F.transform(pairs, lambda p: F.when(p["before"].isNull(), p["own"]).otherwise(F.transform(p["own"], lambda x: merge(p["before"], x)))))

        return F.when(F.size(all_values) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))

    return let(values, in_blocks)


def matches(text: Column, pattern: str, least: int, rank: int, group: int = 0) -> Column:
    """Spans of a pattern's matches whose group has ``least`` characters or more, as structs (start, rank, end, value)."""

    def spans(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        sized = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("size"), v.alias("value")))
        return F.zip_with(running(steps, lambda a, b: a + b), sized, lambda end, x: F.struct((end - x["size"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.filter(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans), lambda x: F.length(x["value"]) >= least)).otherwise(none)


def apart(runs: Column, base: Column, first_run: int = 3) -> Column:
    """The runs, of ranks from ``first_run``, that overlap no base span."""
    far = 2**31 - 1
    inner = lambda order, of: F.transform(order, lambda s: F.when(s["rank"] >= first_run, -far).otherwise(of(s)))
    most = lambda a, b: F.greatest(a, b)

    def free(every: Column) -> Column:
        # The farthest end of base spans that begin no later than a run, and the least start of those that begin after it.
        upto = running(inner(every, lambda s: s["end"]), most)
        after = F.reverse(running(inner(F.reverse(every), lambda s: -s["start"]), most))
        told = F.zip_with(every, F.arrays_zip(upto.alias("upto"), after.alias("after")), lambda s, x: F.struct(s.alias("s"), ((x["upto"] <= s["start"]) & (-x["after"] >= s["end"])).alias("free")))
        return F.transform(F.filter(told, lambda x: (x["s"]["rank"] >= first_run) & x["free"]), lambda x: x["s"])

    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(let(F.sort_array(F.concat(runs, base)), free))


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """Beside the columns kept: ``_base``, the patterns' spans in order, and ``_runs``, runs that touch none of them."""
    text = F.col("_text")
    parts = [
        matches(text, ASSIGN, MIN_VALUE, 0, 2),
        matches(text, ACCESS, MIN_ACCESS, 1),
        matches(text, HEX.replace("+", f"{{{MIN_HEX},}}"), MIN_HEX, 2),  # the same runs: a match takes the whole of one
    ]
    runs = F.filter(matches(text, CANDIDATE, MIN_RUN, 3), lambda r: r["value"].rlike("[A-Za-z]"))
    step = docs.select(*keep, text_of().alias("_text")).select(*keep, F.sort_array(F.concat(*parts)).alias("_base"), runs.alias("_runs"))
    return step.select(*keep, "_base", apart(F.col("_runs"), F.col("_base")).alias("_runs"))


def transitions(value: Column) -> Column:
    """Numbers of the transitions between neighbouring characters."""
    states = F.transform(F.split(value, ""), lambda c: F.when(c == "", STATES - 1).otherwise(F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(STATES))))
    pairs = F.zip_with(states, F.slice(states, 2, F.size(states)), lambda a, b: a * STATES + b)
    return F.filter(pairs, lambda x: x.isNotNull())


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """``value``: digests of numbers, written as keys and tokens are: hexadecimal, base 64 and its forms, letters and digits."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    base = F.base64(digest)
    plain = F.regexp_replace(base, "[+/=]", "")
    forms = [F.substring(F.lower(F.hex(digest)), 1, 40), base, F.translate(base, "+/", "-_"), plain, F.lower(plain), F.upper(plain)]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("value"))


def ordinary_strings(docs: DataFrame, n: int = ORDINARY_DOCUMENTS) -> DataFrame:
    """``value``: words and identifiers of n documents, each also joined to the next as names in code, files and links are.

    Numbers of one or two digits stand in them where names have them: at the end, between words, after a capital. Runs that are
    candidates themselves are left out: secrets among them would count as ordinary.
    """
    some = docs.select(text_of().alias("t")).orderBy(F.xxhash64("t"), "t").limit(n)
    words = F.regexp_extract_all(F.regexp_replace("t", CANDIDATE, " "), F.lit(ORDINARY), F.lit(0))

    def forms(a: Column, b: Column) -> Column:
        number = F.pmod(F.xxhash64(a, b), F.lit(100)).cast("string")
        low, high, title = F.lower, F.upper, F.initcap
        return F.array(
            F.concat(low(a), title(b)), F.concat(title(a), title(b), number), F.concat_ws("_", a, b), F.concat_ws("_", high(a), high(b), number), high(F.concat(a, b)),
            F.concat_ws("/", low(a), F.concat(low(b), number)), F.concat(low(a), number, F.lit("/"), low(b)), F.concat_ws("-", low(a), number, low(b)), F.concat(F.substring(high(a), 1, 3), title(b)), F.concat(low(a), F.lit("="), low(b)),
        )

    joined = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.when(b.isNotNull(), forms(a, b)))
    listed = some.select(words.alias("w")).select(F.explode(F.concat("w", F.flatten(F.filter(joined, lambda x: x.isNotNull())))).alias("value"))
    return listed.groupBy("value").agg(F.lit(1).alias("one")).select("value")


def weight_table(found: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: for each transition, ln p_random - ln p_ordinary in thousandths, from the labelled samples."""
    hits = found.select(F.explode("_base").alias("s")).select("s.value").union(random_strings(found.sparkSession))
    samples = hits.withColumn("random", F.lit(1)).union(ordinary_strings(docs).withColumn("random", F.lit(0)))
    steps = samples.select("random", F.explode(transitions(F.col("value"))).alias("step"))
    counts = steps.groupBy("step").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    cells = found.sparkSession.range(STATES * STATES).select(F.col("id").cast("int").alias("step"))
    full = cells.join(counts, "step", "left").select("step", F.floor(F.col("step") / STATES).cast("int").alias("state"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    states = full.groupBy("state").agg(F.sum("r").alias("all_r"), F.sum("o").alias("all_o"))
    seen = full.join(states, "state").agg(F.collect_list(F.struct("step", "r", "o", "all_r", "all_o")).alias("all"))
    ratio = lambda c: F.log((c["r"] + 1) / (c["all_r"] + STATES)) - F.log((c["o"] + 1) / (c["all_o"] + STATES))
    return seen.select(F.transform(F.array_sort("all"), lambda c: F.round(1000 * ratio(c)).cast("int")).alias("weights"))


def find_secrets(docs: DataFrame, *keep: str) -> DataFrame:
    """Beside the columns kept: ``_spans``, an array of structs (start, rank, end) in order; ranks number ``KINDS``.

    The models need the whole corpus's samples first, so spans and candidates are written once, and weighed from there. The
    weights are as many numbers as there are pairs of states.
    """
    found = materialise(base_spans(docs, *keep))
    numbers = weight_table(found, docs).first()[0]
    weights = F.split(F.lit(",".join(map(str, numbers))), ",", -1).cast("array<int>")

    def secret(r: Column) -> Column:
        steps = transitions(r["value"])
        total = F.aggregate(steps, F.lit(0), lambda acc, x: acc + F.get(weights, x))
        return (total >= MIN_TOTAL) & (total >= MIN_MEAN * F.size(steps))

    spans = F.sort_array(F.concat("_base", F.filter("_runs", secret)))
    return found.select(*keep, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).alias("_spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def base_digest(docs: DataFrame) -> DataFrame:
    """The patterns' part of the result: numbers of spans by kind, and the hash of their list."""
    of = lambda rank: F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long")
    return docs.select("*", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(F.filter("_spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base_digest(find_secrets(table(spark, sf_dir, "documents"), "doc_id"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", listed(F.col("_spans")).alias("spans"))


#: What stands in a text for a secret.
MASK = "[secret]"


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch of overlapping spans, which ascend by their start, replaced by ``mask``.

    A text is cut into sections at every so many spans first, so that no piece is looked for from the text's beginning.
    """

    def cut(ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        step = F.ceil(F.sqrt(F.size(spans))).cast("int")
        pieces = F.zip_with(spans, F.arrays_zip(before.alias("before"), ends.alias("end")), lambda s, x: F.struct(x["before"].alias("before"), s["start"].alias("start"), x["end"].alias("end")))

        def section(some: Column) -> Column:
            begin, end = F.element_at(some, 1)["before"], F.element_at(some, -1)["end"]
            piece = lambda t, c: F.when(c["start"] >= c["before"], F.concat(F.substring(t, c["before"] - begin + 1, c["start"] - c["before"]), F.lit(mask))).otherwise("")
            return let(F.substring(text, begin + 1, end - begin), lambda t: F.array_join(F.transform(some, lambda c: piece(t, c)), ""))

        sections = let(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), step), lambda k: let(F.slice(p, k, step), section)))
        return F.concat(F.array_join(sections, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), cut))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each stretch of overlapping spans replaced by ``MASK``, and their number of characters.

    A row's own columns travel in one struct, so none of their names can clash.
    """
    rows = find_secrets(docs.select(F.struct("*").alias("_row"), "text"), "_row")
    own = lambda c: F.col("_row").getField(c)
    rows = rows.withColumn("_masked", masked(own("text"), F.col("_spans")))
    put = {"text": F.col("_masked"), "n_chars": F.when(F.size("_spans") == 0, own("n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("_masked").cast("long"))}
    return rows.select(*[(put[c] if c in put else own(c)).alias(c) for c in docs.columns])
