"""The operators' queries by name, the parts of them that SQL can express as queries of their own, and that SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, filter_audit, html_text, mixing, neardup, packing, personal, quality, secrets, substrings, token_counts, token_files, vectors
from .base import table, text_of


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern spans of ``op1_secrets``."""
    found = secrets.base_spans(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("_base", "_spans")
    return secrets.base_digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def personal_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern spans of ``op13_personal``."""
    found = personal.base_spans(table(spark, sf_dir, "documents"), "doc_id")
    by_kind = F.sort_array(F.transform("_base", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"))))
    return personal.base_digest(found.select("doc_id", by_kind.alias("_spans"))).drop("_spans")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of ``op3_quality``."""
    return quality.base_counts(table(spark, sf_dir, "documents"), "doc_id").drop("ngrams")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets of ``op4_mixing``, from the documents."""
    size = mixing.word_count(text_of())
    sizes = table(spark, sf_dir, "documents").select(mixing.source_key().alias("key"), size.alias("size")).groupBy("key").agg(F.sum("size").alias("source_size"))
    source = F.when(F.col("key") != "1", F.substring("key", 2, 1 << 30))
    return mixing.targets(sizes).select(source.alias("source"), "source_size", F.round("target", 3).alias("target"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _spans_sql(pattern: str, group: int, least: int, rank: int) -> str:
    """SQL for a pattern's spans in t: a match begins where the pieces and matches before it end."""
    p = "'" + pattern.replace("'", "''") + "'"
    begin = "CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""(SELECT list_filter(list_transform(range(1, len(found) + 1), lambda i: {{'start': {begin}, 'rank': {rank}, 'end': {begin} + length(found[i]), 'size': length(vals[i])}}), lambda s: s.size >= {least})
      FROM (SELECT regexp_extract_all(t, {p}, 0) AS found, regexp_extract_all(t, {p}, {group}) AS vals, regexp_split_to_array(t, {p}) AS gaps))"""


SECRET_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  s AS (SELECT doc_id, list_sort(list_concat({_spans_sql(secrets.ASSIGN, 2, secrets.MIN_VALUE, 0)}, list_concat({_spans_sql(secrets.ACCESS, 0, secrets.MIN_ACCESS, 1)},
      {_spans_sql("[0-9a-f]{32,}", 0, secrets.MIN_HEX, 2)}))) AS spans FROM d)
SELECT doc_id, CAST(len(list_filter(spans, lambda x: x.rank = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(spans, lambda x: x.rank = 1)) AS BIGINT) AS n_access, CAST(len(list_filter(spans, lambda x: x.rank = 2)) AS BIGINT) AS n_hex,
  sha256(array_to_string(list_transform(spans, lambda x: ['assign', 'access', 'hex'][x.rank + 1] || ':' || x.start || ':' || x.end), ',')) AS base_sha256 FROM s"""

def _valid_spans_sql(pattern: str, valid: str, rank: int) -> str:
    """SQL for the spans of a pattern's matches x for which ``valid`` holds, in t."""
    p = "'" + pattern + "'"
    begin = "CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""(SELECT list_transform(list_filter(range(1, len(found) + 1), lambda i: list_transform(found, lambda x: {valid})[i]), lambda i: {{'rank': {rank}, 'start': {begin}, 'end': {begin} + length(found[i])}})
      FROM (SELECT regexp_extract_all(t, {p}, 0) AS found, regexp_split_to_array(t, {p}) AS gaps))"""


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN (length({_DIGITS}) - k) % 2 = 1 THEN 2 * CAST({_DIGITS}[k] AS INTEGER) - CASE WHEN CAST({_DIGITS}[k] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST({_DIGITS}[k] AS INTEGER) END)) % 10 = 0"
PERSONAL_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  s AS (SELECT doc_id, list_concat(list_concat({_valid_spans_sql(personal.EMAIL, "true", 0)}, {_valid_spans_sql(personal.IP, "list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255", 1)}),
    list_concat({_valid_spans_sql(personal.CARD, f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END", 2)}, {_valid_spans_sql(personal.PHONE, f"length({_DIGITS}) BETWEEN 8 AND 15", 3)})) AS spans FROM d)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(spans, lambda x: x.rank = {k})) AS BIGINT) AS n_{kind}" for k, kind in enumerate(personal.KINDS[:4]))},
  sha256(array_to_string(list_transform(list_sort(spans), lambda x: ['email', 'ip', 'card', 'phone'][x.rank + 1] || ':' || x.start || ':' || x.end), ',')) AS base_sha256 FROM s"""

QUALITY_SQL = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
  l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
  g AS (SELECT n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
  r AS (SELECT n, i FROM (SELECT *, count(*) OVER (PARTITION BY n, g) AS c FROM g) WHERE c > 1),
  c AS (SELECT n, count(DISTINCT i + j) AS k FROM r, range(0, 3) x(j) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN c USING (n)"""

MIX_SQL = f"""WITH s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY source),
  o AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS p, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, 2.0 * source_size AS cap FROM s),
  x AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, coalesce(sum(weight) OVER (ORDER BY cap / weight, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM o),
  l AS (SELECT *, ((SELECT 1.5 * sum(source_size) FROM s) - capped) / ((SELECT sum(weight) FROM o) - gone) AS level FROM x),
  f AS (SELECT arg_min(level, (ratio, p)) AS level FROM l WHERE level <= ratio)
SELECT source, source_size, round(CAST(least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS DOUBLE), 3) AS target FROM l"""

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_packing": packing.op2_packing,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_topk": vectors.op6_topk,
    "op7_token_files": token_files.op7_token_files,
    "op8_html_text": html_text.op8_html_text,
    "op9_neardup": neardup.op9_neardup,
    "op10_substrings": substrings.op10_substrings,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_personal": personal.op13_personal,
    "secret_base_spans": secret_base_spans,
    "personal_base_spans": personal_base_spans,
    "quality_base_counts": quality_base_counts,
    "mix_targets": mix_targets,
}

ORACLES = {"op6_topk": vectors.ORACLE, "op10_substrings": substrings.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE, "secret_base_spans": SECRET_SQL, "personal_base_spans": PERSONAL_SQL, "quality_base_counts": QUALITY_SQL, "mix_targets": MIX_SQL}
