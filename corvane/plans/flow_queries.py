"""Queries of flows: markup by a machine over chunks, patches written and read back, what sources reach in a graph of several kinds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.graph import best_of, induced, nearest_sources
from corvane.operators.transducer import markup
from corvane.plans.registry import query, read
from corvane.scratch import materialise, scratch_dir
from corvane.sources.diff import change_files
from corvane.sources.patch_files import read_patches, write_patches

_MARK = r"""<!--(?s:.*?)(?:-->|\z)|<(?:"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|[^"''>])*(?:>|\z)"""


@query(f"""WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT r, page_id, h, regexp_extract_all(h, '{_MARK}') AS marks, regexp_replace(h, '{_MARK}', '', 'g') AS t FROM p),
  e AS (SELECT r, unnest(marks) AS k, unnest(range(1, len(marks) + 1)) AS i FROM m),
  s AS (SELECT r, i, sum(CASE WHEN k LIKE '</%' THEN -1 WHEN k LIKE '<!%' OR k = '<>' OR k = '<' THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS s FROM e),
  d AS (SELECT r, i, s - least(0, min(s) OVER (PARTITION BY r ORDER BY i)) AS d FROM s), w AS (SELECT r, max(d) AS peak, arg_max(d, i) AS depth FROM d GROUP BY r)
  SELECT page_id, CAST(len(marks) AS BIGINT) AS n_marks, CAST(len(list_filter(marks, lambda x: starts_with(x, '<!--'))) AS BIGINT) AS n_comments, CAST(length(h) - length(t) AS BIGINT) AS n_masked,
    CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(coalesce(peak, 0) AS BIGINT) AS peak, sha256(t) AS text_sha256 FROM m LEFT JOIN w USING (r)""")
def markup_depths(spark, d):
    """Of each page how many tags and comments, how many characters they mask, how deep tags nest, and what is left outside of them."""
    told = markup(read(spark, d, "pages"), ["page_id"], "html")
    return told.select("page_id", "n_marks", "n_comments", "n_masked", "depth", "peak", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS b, coalesce(lag(string_split(coalesce(text, ''), chr(10))) OVER (PARTITION BY conv_id ORDER BY turn, role, text), []) AS a FROM conversations),
  d AS (SELECT id, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: CAST(0 AS BIGINT)) AS l FROM t
    UNION ALL SELECT d.id, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN l[k] + 1 ELSE l[k + 1] END)))) FROM d JOIN t ON t.id = d.id WHERE i < len(a)),
  n AS (SELECT id, l[len(l)] AS same FROM d JOIN t USING (id) WHERE i = len(a))
  SELECT conv_id, turn, role, CASE WHEN len(a) = 0 THEN 'added' ELSE 'modified' END AS status, CAST(len(b) - same AS BIGINT) AS additions, CAST(len(a) - same AS BIGINT) AS deletions FROM t JOIN n USING (id) WHERE len(a) + len(b) > 2 * same""")
def patch_round_trip(spark, d):
    """Each turn against the one before it as a patch with context, written to files and read back by the patch source: lines that came and went."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    new = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # As long as conversations are, and no longer: a window holds one conversation.
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", new.alias("new"), F.coalesce(F.lag(new).over(order), F.array().cast("array<string>")).alias("old"), F.row_number().over(order).alias("n"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = turns.withColumn("name", F.concat_ws("/", part("conv_id"), part("turn"), part("role"), F.col("n").cast("string")))
    path = scratch_dir(spark)
    write_patches(named, path)
    lines = read_patches(spark, path)
    files = change_files(lines.withColumn("patch", F.lit("")))
    split = F.split("path", "/")
    asked = lambda k, t: F.nullif(split[k], F.lit("")).cast(t)
    return files.select(asked(0, "long").alias("conv_id"), asked(1, "long").alias("turn"), asked(2, "string").alias("role"), "status", "additions", "deletions")


#: How many vertices an impact map shows, and how far from a source they may lie.
SHOWN, HOPS = 400, 3


@query(f"""WITH e AS (SELECT DISTINCT CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' ELSE 'supplies' END AS kind, 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem GROUP BY l_suppkey, l_partkey
    UNION ALL SELECT 'lives', 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'lives', 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'contains', 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
  u AS (SELECT a, b FROM e WHERE kind <> 'contains' AND kind <> 'supplies' UNION SELECT b, a FROM e WHERE kind <> 'contains' AND kind <> 'supplies'),
  h0 AS (SELECT 'p' || p_partkey AS id, 'p' || p_partkey AS source, p_retailprice AS score, 0 AS hops FROM part WHERE p_size <= 3),
  {", ".join(f'''h{k} AS (SELECT * FROM h{k - 1} UNION ALL SELECT id, source, score, {k} FROM (SELECT b AS id, source, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, source) AS r FROM h{k - 1} JOIN u ON id = a WHERE hops = {k - 1} AND b NOT IN (SELECT id FROM h{k - 1})) WHERE r = 1)''' for k in range(1, HOPS + 1))},
  v AS (SELECT *, row_number() OVER (ORDER BY score DESC, hops, id) AS r FROM h{HOPS}), k AS (SELECT * FROM v WHERE r <= {SHOWN})
  SELECT kind, a, b, x.source AS source_a, y.source AS source_b, greatest(x.hops, y.hops) AS hops, greatest(x.score, y.score) AS score FROM e JOIN k x ON x.id = a JOIN k y ON y.id = b""")
def impact_subgraph(spark, d):
    """What small parts reach over returns and homes: the nearest source of each vertex, the best vertices under a cap, all edges between those."""
    named = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    lines = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    link = lambda rows, kind, a, b: rows.select(kind.alias("kind"), named(*a).alias("a"), named(*b).alias("b"))
    edges = link(lines, F.when(F.col("r"), "returned").otherwise("supplies"), ("s", "l_suppkey"), ("p", "l_partkey"))
    for t, kind, a, b in (("supplier", "lives", ("s", "s_suppkey"), ("n", "s_nationkey")), ("customer", "lives", ("c", "c_custkey"), ("n", "c_nationkey")), ("nation", "contains", ("r", "n_regionkey"), ("n", "n_nationkey"))):
        edges = edges.union(link(read(spark, d, t), F.lit(kind), a, b))
    edges = materialise(edges)
    sources = read(spark, d, "part").filter("p_size <= 3").select(named("p", "p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    shown = best_of(nearest_sources(edges, sources, HOPS, ["returned", "lives"]), [F.desc("score"), "hops", "id"], SHOWN)
    of = lambda end: F.broadcast(shown.select(F.col("id").alias(end), F.struct("source", "hops", "score").alias(f"_{end}")))
    told = induced(edges, shown, few=True).join(of("a"), "a").join(of("b"), "b")
    return told.select("kind", "a", "b", F.col("_a.source").alias("source_a"), F.col("_b.source").alias("source_b"), F.greatest("_a.hops", "_b.hops").alias("hops"), F.greatest("_a.score", "_b.score").alias("score"))
