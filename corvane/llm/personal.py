"""Personal data (operator 13), in DataFrame functions only: fixed patterns, then candidates weighed by boosted trees.

The patterns give base spans by kind (email, ip, card, phone), leftmost and non-overlapping in each. Generators then propose
every span that could be personal data: addresses written around the at sign, runs of digits, account numbers, network addresses;
they overlap, and most are dates, prices, versions and the like. A candidate's features are whole numbers read from its format
and from the words before it. Boosted trees are trained on labelled samples, of which some are held back: on those each
generator's threshold is set to the least score from which the share of personal data reaches ``PRECISION``.

Samples are made here: ``SAMPLES`` numbers, written in forms that are personal data and in forms that look alike, each in a
sentence. Trees are grown level by level: one aggregation gives gradients by node, feature and value, a window the best cut of
each node. Sums are of whole numbers, so the trees don't depend on the order of rows. Samples are few by that parameter, so
they lie in one partition and a level is one small task.

Places are code points, ends exclusive. Added spans touch no base span; they may overlap each other. A candidate's context is
the text between it and the candidate before it of the same generator, at most ``CONTEXT`` characters.

Cases: a null text is empty and has no spans; very long texts are one row, and each span of one is found; repeated rows are
scanned one by one; an empty table gives no rows; columns of other names are kept or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialise, table, text_of
from .secrets import apart, let, masked, matches

KINDS = ("email", "ip", "card", "phone", "mail", "number", "account", "net")
BASE_KINDS = 4
#: What the base rules look for, as in the contract.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The same matches, found in linear time: no second start inside a run that has failed, and groups that repeat without recursion.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"

#: Generators of candidates, by kind.
GENERATORS = {
    "mail": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[a-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)\x20?[a-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./:-]{0,3}[0-9]){6,}+(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?",
    "net": r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{1,4}(?:(?:::?|-)[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Za-z:-])",
}
CONTEXT = 40
#: Words that speak for or against personal data, looked for in a candidate's context.
HINTS = {
    "reach": "phone|tel|call|mobile|fax|cell|dial|text me|whatsapp|reach",
    "write": "mail|contact|write|send|inbox|reply",
    "pay": "card|visa|amex|credit|debit|iban|account|bank|payment",
    "identity": "ssn|social security|passport|tax id|national id|licen[cs]e|born|birth",
    "address": r"\bip\b|host|server|login|mac\b|device|from address|client",
    "count": "order|invoice|isbn|page|total|price|version|build|model|ticket|sku|item|issue|ref|population|serial|chapter|record",
    "time": "date|on |since|until|at |updated|posted|year|between|from ",
}
FEATURES = ("digits", "letters", "length", "groups", "longest", "first", "last", "lead", "space", "dash", "dot", "slash", "colon", "round", "at", "luhn", "octets", "date", "distinct", "hex", "pause", "kind", *HINTS)

#: Samples made, trees, their depth, how much of a tree's answer counts, and the share of personal data above a threshold.
SAMPLES, TREES, DEPTH, RATE, PRECISION = 4_000, 14, 3, 0.5, 0.98
#: A threshold is never less: below, a candidate is more likely something else.
LEAST = 0
#: Weight of a leaf's prior, and gradients in whole millionths.
PRIOR, UNIT = 1.0, 1_000_000


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test; for short strings only, as each digit is looked for from the beginning."""
    n = F.length(digits)
    double = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    of = lambda i: let(F.substring(digits, i, 1).cast("int"), lambda d: F.when((n - i) % 2 == 1, double(d)).otherwise(d))
    return (n > 0) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0)


def octets(value: Column) -> Column:
    """Whether every number between dots is at most 255."""
    return ~F.exists(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda x: F.when(F.length(x) > 3, True).otherwise(x.cast("int") > 255)))


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns kept, ``_text`` and ``_base``: the patterns' spans by place, as structs (start, rank, end, value)."""
    text = F.col("_text")

    def dialled(v: Column, least: int, most: int, also=lambda d: F.lit(True)) -> Column:
        return let(digits_of(v), lambda d: F.when(F.length(d).between(least, most), also(d)).otherwise(False))

    parts = [
        F.when(F.contains(text, F.lit("@")), matches(text, _EMAIL, 1, 0)),
        F.filter(matches(text, _IP, 1, 1), lambda s: octets(s["value"])),
        F.filter(matches(text, _CARD, 16, 2), lambda s: dialled(s["value"], 16, 19, passes_luhn)),
        F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE, 1, 3), lambda s: dialled(s["value"], 8, 15))),
    ]
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    return docs.select(*keep, text_of().alias("_text")).select(*keep, "_text", F.sort_array(F.concat(*(F.coalesce(p, none) for p in parts))).alias("_base"))


def candidates(text: Column) -> Column:
    """Every generator's spans in order, as structs (start, rank, end, value); in value, context and candidate are parted by a null character."""

    def of(rank: int, pattern: str) -> Column:
        # The text before a candidate, up to the one before it, is what the pattern leaves between them.
        def told(spans: Column) -> Column:
            gaps = F.slice(F.split(text, pattern, -1), 1, F.size(spans))
            return F.zip_with(spans, gaps, lambda s, gap: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.concat(F.right(gap, F.lit(CONTEXT)), F.lit("\0"), s["value"]).alias("value")))

        return let(matches(text, pattern, 1, rank), lambda spans: F.when(F.size(spans) > 0, told(spans)).otherwise(spans))

    return F.sort_array(F.concat(*(of(BASE_KINDS + k, p) for k, p in enumerate(GENERATORS.values()))))


def features(value: Column, context: Column, rank: Column) -> Column:
    """A struct of ``FEATURES`` as ints: the format of a candidate, and what the words before it speak for."""
    is_true = lambda c: F.when(c, 1).otherwise(0)
    number = lambda sign: F.length(value) - F.length(F.replace(value, F.lit(sign)))

    def tell(v: Column) -> Column:
        digits, groups = v["digits"], v["groups"]
        size = F.length(digits)
        lead = F.when(F.startswith(value, F.lit("+")), 1).when(F.startswith(value, F.lit("(")), 2).when(F.startswith(value, F.lit("0")), 3).otherwise(0)
        date = r"^\(?(?:(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}\x20?[-/]\x20?(?:19|20)[0-9]{2})"
        at = F.when(F.contains(value, F.lit("@")), 1).when(value.rlike(r"(?i)[(\[]at[)\]]"), 2).when(value.rlike("(?i) at "), 3).otherwise(0)
        each = {
            "digits": size, "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")), "length": F.length(value), "groups": F.size(groups),
            "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), "first": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
            "last": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)), "lead": lead, "space": number(" "), "dash": number("-"), "dot": number("."), "slash": number("/"), "colon": number(":"),
            "round": number("("), "at": at, "luhn": is_true(F.when(size.between(13, 19), passes_luhn(digits)).otherwise(False)), "octets": is_true(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & octets(value)),
            "date": is_true(value.rlike(date)), "distinct": F.size(F.array_distinct(F.split(digits, ""))), "hex": is_true(value.rlike("[A-Fa-f]") & ~value.rlike("[G-Zg-z]")), "pause": is_true(value.rlike(r"[A-Za-z]\.\x20")), "kind": rank,
            **{name: is_true(context.rlike(f"(?i){words}")) for name, words in HINTS.items()},
        }
        return F.struct(*(each[name].cast("int").alias(name) for name in FEATURES))

    return let(F.struct(digits_of(value).alias("digits"), F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)).alias("groups")), tell)


#: What the samples are made of: names, and the words before a number or an address. Words of the last group tell nothing.
NAMES = "anna bruno carla denis elena felix greta hugo irina jonas karla luis maria nils olga pablo".split()
LEADS = {
    "reach": ["call me on", "my phone is", "tel.", "mobile:", "fax", "reach us under", "Dial"],
    "write": ["write to", "my mail is", "contact", "send it to", "e-mail:"],
    "identity": ["SSN", "social security number", "passport", "her tax id is", "born with"],
    "pay": ["IBAN", "my card", "account", "pay by amex", "bank account"],
    "address": ["client", "host", "MAC", "login from", "device"],
    "time": ["on", "since", "date:", "updated", "posted", "between"],
    "count": ["order", "invoice", "ISBN", "version", "total", "item", "ref", "population", "serial"],
    "plain": ["please", "they", "we", "now", "then", "it was", "they had", "and so"],
}


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``id, text, personal``: n sentences with one number or address each, and whether that is personal data.

    All is read from a hash of the sentence's number: its form, its digits, the words around it. Two of five sentences have
    words before it that tell nothing.
    """

    def drawn(at: int, below: int) -> Column:
        return F.conv(F.substring("g", at, 4), 16, 10).cast("int") % below

    def pick(options: list[Column], at: int) -> Column:
        return F.element_at(F.array(*options), 1 + drawn(at, len(options)))

    def words(listed: list[str], at: int) -> Column:
        return pick([F.lit(x) for x in listed], at)

    joined, own = F.concat_ws, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    digits = lambda at, k: F.substring("d", at, k)
    hexes = lambda at, k: F.substring("h", at, k)
    below = lambda at, most: F.lpad((digits(at, 2).cast("int") % most).cast("string"), 2, "0")
    several = lambda sep, *sizes: joined(sep, *(digits(1 + sum(sizes[:k]), m) for k, m in enumerate(sizes)))
    letters = lambda at, k: F.translate(hexes(at, k), "0123456789abcdef", "etaoinshrdlucmfp")
    someone = lambda at: F.when(drawn(at, 3) == 0, words(NAMES, at)).otherwise(letters(at, 3 + drawn(at + 2, 9)))
    name, other = someone(1), someone(15)
    host = own(other, "mail")
    year, month, day = own("20", digits(1, 2)), below(3, 12), below(5, 28)
    payable = own("37", digits(1, 12))
    checks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: own(payable, c.cast("string"))), passes_luhn)
    amex = F.element_at(checks, 1)
    personal = {
        "reach": [
            several("-", 3, 3, 4), own("(", digits(1, 3), ") ", digits(4, 3), "-", digits(7, 4)), several(".", 3, 3, 4), own("0", several(" ", 2, 4, 4)),
            own("00", several(" ", 2, 3, 3, 4)), own("0", several("/", 4, 6)), own("0", several(" ", 1, 2, 2, 2, 2)),
        ],
        "write": [own(name, " at ", host, " dot com"), own(name, " [at] ", host, " [dot] org"), own(name, digits(1, 2), "(at)", host, ".net"), own(name, " @ ", host, ".com"), own(name, ".", other, "[at]", host, ".de")],
        "identity": [several("-", 3, 2, 4), several(" ", 3, 2, 4)],
        "pay": [own("DE", several(" ", 2, 4, 4, 4, 4, 2)), own("GB", digits(1, 2), "BARC", digits(3, 14)), amex, joined(" ", F.substring(amex, 1, 4), F.substring(amex, 5, 6), F.substring(amex, 11, 5))],
        "address": [joined(":", *(hexes(1 + 4 * k, 4) for k in range(8))), joined(":", *(F.upper(hexes(1 + 2 * k, 2)) for k in range(6))), joined("-", *(hexes(1 + 2 * k, 2) for k in range(6))), own("fe80::", joined(":", *(hexes(1 + 4 * k, 4) for k in range(4))))],
    }
    ordinary = {
        "time": [
            joined("-", year, month, day), joined("/", day, month, year), joined(".", day, month, year), own(joined("-", year, month, day), " ", joined(":", below(7, 24), below(9, 60), below(11, 60))),
            own(year, "-20", digits(9, 2)), own(year, month, day, digits(7, 6)), joined(":", below(1, 24), below(3, 60), below(5, 60), below(7, 60)),
        ],
        "count": [
            digits(1, 8), digits(1, 10), digits(1, 12), digits(1, 16), several(".", 2, 1, 5, 1), own("978-", several("-", 1, 2, 6, 1)), several("-", 4, 5), several(".", 7, 2),
            several(" ", 1, 1, 1, 1, 1, 1, 1, 1), several(" ", 2, 2, 2, 2, 2, 2), own("AB12 TYPE MODE ", digits(1, 4)), own(several(".", 3, 4), " ", digits(8, 2), ".", digits(10, 4)), own("1 000 000 ", digits(1, 3)),
            several(".", 1, 14), several(".", 2, 9), several(" ", *[1] * 10), several(" ", *[2] * 9), several("/", 2, 3, 4), several(" ", 2, 3, 3), several(" ", 3, 3, 3), several("-", 3, 3),
        ],
        "plain": [own("look at page dot ", name), own(name, " at ", other, ". ", F.initcap(name)), own(other, " at ", name, "s. The"), own("meet at noon. ", F.initcap(name)), joined("-", *(hexes(1 + 4 * k, 4) for k in range(4))), own(name, " @ ", several(".", 2, 2)), several(":", 1, 1, 1, 1)],
    }

    def sentence(forms: dict[str, list[Column]]) -> Column:
        return pick([own(F.when(drawn(9, 5) < 3, words(LEADS[k], 13)).otherwise(words(LEADS["plain"], 13)), " ", pick(v, 17)) for k, v in forms.items()], 21)

    # One partition: the samples are as few as their parameter says.
    numbered = spark.range(n).coalesce(1).select("id", *(F.md5(F.concat(F.lit(x), F.col("id").cast("string"))).alias(x) for x in "gh"))
    rows = numbered.withColumn("d", F.rpad(F.concat(*(F.reverse(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10)) for k in range(4))), 40, "7"))
    is_personal = F.col("id") % 2 == 0
    return rows.select("id", own("so ", F.when(is_personal, sentence(personal)).otherwise(sentence(ordinary)), " and more").alias("text"), is_personal.cast("int").alias("personal"))


def score_sql(trees: list, of: str) -> str:
    """The sum of the trees' leaves in thousandths, as SQL over a struct of features. A tree is (feature, most, left, right) or a leaf."""

    def walk(tree) -> str:
        return str(tree) if isinstance(tree, int) else f"IF({of}.{tree[0]} <= {tree[1]}, {walk(tree[2])}, {walk(tree[3])})"

    return " + ".join(["0", *map(walk, trees)])


def _grow(samples: DataFrame, trees: list, depth: int):
    """One more tree on samples ``x, personal, n``: level by level, the cut of each node that gains most."""
    odds = F.expr(f"({score_sql(trees, 'x')}) / 1000D")
    p = 1 / (1 + F.exp(-odds))
    base = samples.select("x", (F.round(UNIT * (F.col("personal") - p)).cast("long") * F.col("n")).alias("g"), (F.round(UNIT * p * (1 - p)).cast("long") * F.col("n")).alias("h"))
    each = "explode(array(" + ", ".join(f"struct({k} AS f, x.{name} AS v)" for k, name in enumerate(FEATURES)) + ")) AS e"
    power = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + PRIOR)
    leaf = lambda g, h: round(1000 * RATE * (g / UNIT) / (h / UNIT + PRIOR))
    cuts: dict[int, tuple] = {}  # children of node k are 2 k and 2 k + 1
    leaves = {1: 0}

    def node_of(k: int = 1) -> str:
        return f"IF(x.{cuts[k][0]} <= {cuts[k][1]}, {node_of(2 * k)}, {node_of(2 * k + 1)})" if k in cuts else str(k)

    def built(k: int = 1):
        return (*cuts[k], built(2 * k), built(2 * k + 1)) if k in cuts else leaves[k]

    for _ in range(depth):
        by_value = base.selectExpr(f"{node_of()} AS node", "g", "h", each).groupBy("node", F.col("e.f").alias("f"), F.col("e.v").alias("v")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        w = Window.partitionBy("node", "f")
        upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        told = by_value.select("node", "f", "v", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(w).alias("ga"), F.sum("h").over(w).alias("ha"))
        gain = power(F.col("gl"), F.col("hl")) + power(F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")) - power(F.col("ga"), F.col("ha"))
        choice = F.struct(F.round(gain, 6).alias("gain"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "gl", "hl", "ga", "ha")
        # As many rows as open nodes: at most two to the depth.
        for node, b in told.groupBy("node").agg(F.max(choice)).collect():
            if node not in cuts and b.gain > 0:
                cuts[node] = FEATURES[-b.f], -b.v
                leaves[2 * node], leaves[2 * node + 1] = leaf(b.gl, b.hl), leaf(b.ga - b.gl, b.ha - b.hl)
    return built()


#: Models of this process by their parameters: samples and trees follow from these alone.
_models: dict[tuple, tuple] = {}


def train(spark: SparkSession, samples: int = SAMPLES, trees: int = TREES, depth: int = DEPTH) -> tuple[list, dict[int, int]]:
    """The trees, and by generator the least score that counts; a generator without such a score adds nothing."""
    key = samples, trees, depth
    if key not in _models:
        _models[key] = _train(spark, *key)
    return _models[key]


def _train(spark: SparkSession, samples: int, trees: int, depth: int) -> tuple[list, dict[int, int]]:
    rows = materialise(labelled_samples(spark, samples)).select("id", "personal", F.explode(candidates(F.col("text"))).alias("c"))
    told = rows.select("id", "personal", F.col("c.rank").alias("rank"), F.split("c.value", "\0").alias("v"))
    found = told.select((F.col("id") % 10 < 6).alias("to_train"), "personal", "rank", features(F.col("v")[1], F.col("v")[0], F.col("rank")).alias("x"))
    seen = materialise(found.groupBy("to_train", "personal", "rank", "x").agg(F.count("*").alias("n")).coalesce(1))
    grown: list = []
    for _ in range(trees):
        grown.append(_grow(seen.filter("to_train"), grown, depth))
    scored = seen.filter("NOT to_train").select("rank", "personal", "n", F.expr(score_sql(grown, "x")).alias("score"))
    w = Window.partitionBy("rank").orderBy(F.desc("score"))
    above = scored.groupBy("rank", "score").agg(F.sum(F.col("personal") * F.col("n")).alias("yes"), F.sum("n").alias("n")).select("rank", "score", (F.sum("yes").over(w) / F.sum("n").over(w)).alias("share"))
    least = above.filter(F.col("share") >= PRECISION).groupBy("rank").agg(F.min("score").alias("score")).collect()
    return grown, {r["rank"]: max(r.score, LEAST) for r in least}


def find_personal(docs: DataFrame, *keep: str) -> DataFrame:
    """Beside the columns kept: ``_spans``, an array of structs (rank, start, end) in order; ranks number ``KINDS``."""
    trees, least = train(docs.sparkSession)

    step = base_spans(docs, *keep).select(*keep, "_base", candidates(F.col("_text")).alias("_runs"))
    step = step.select(*keep, "_base", apart(F.col("_runs"), F.col("_base"), BASE_KINDS).alias("_runs"))
    told = lambda c: let(F.split(c["value"], "\0"), lambda v: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), features(v[1], v[0], c["rank"]).alias("x")))
    step = step.select(*keep, "_base", F.transform("_runs", told).alias("_runs"))
    bounds = " ".join(f"WHEN {rank} THEN {score}" for rank, score in sorted(least.items()))
    chosen = F.expr(f"filter(_runs, c -> ({score_sql(trees, 'c.x')}) >= CASE c.rank {bounds} END)") if least else F.slice("_runs", 1, 0)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    return step.select(*keep, F.sort_array(F.concat(plain("_base"), plain(chosen))).alias("_spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def base_digest(docs: DataFrame) -> DataFrame:
    """The patterns' part of the result: numbers of spans by kind, and the hash of their list."""
    of = lambda rank: F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")
    return docs.select("*", *map(of, range(BASE_KINDS)), F.sha2(listed(F.filter("_spans", lambda s: s["rank"] < BASE_KINDS)), 256).alias("base_sha256"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base_digest(find_personal(table(spark, sf_dir, "documents"), "doc_id"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", listed(F.col("_spans")).alias("spans"))


#: What stands in a text for personal data.
MASK = "[private]"


def mask_personal(docs: DataFrame) -> DataFrame:
    """The documents with each stretch of overlapping spans replaced by ``MASK``; null texts stay null, other columns as they are."""
    rows = find_personal(docs.select(F.struct("*").alias("_row"), "text"), "_row")
    by_place = F.sort_array(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    rows = rows.withColumn("_masked", masked(F.col("_row.text"), by_place, MASK))
    return rows.select(*[(F.col("_masked") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
