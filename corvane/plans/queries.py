"""Change-analysis operators as queries on the given tables, each beside the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.alike import alike_texts
from corvane.operators.graph import closure, connected_components
from corvane.operators.matching import greedy_pairs, snapshot_diff
from corvane.operators.ranking import as_of, keep_best, runs, top_k
from corvane.operators.scoring import level, rolled_up, weighted_score
from corvane.operators.sequences import edit_scripts, hunks, replaced_lines, word_diffs
from corvane.plans.registry import query, read
from corvane.scratch import materialise

_BAGS = """bags(id, gram, c) AS (SELECT id, gram, count(*) FROM (SELECT id, unnest(CASE WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM words) GROUP BY ALL),
  sizes AS (SELECT id, sum(c) AS n FROM bags GROUP BY id)"""


@query(f"""WITH firsts AS (SELECT coalesce(text, '') AS t, md5(coalesce(text, '')) AS id, min(doc_id) AS doc FROM documents GROUP BY ALL),
  words AS (SELECT id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM firsts), {_BAGS},
  m AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS m FROM bags a JOIN bags b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
  SELECT CASE WHEN v.doc < u.doc THEN v.doc ELSE u.doc END AS doc_a, CASE WHEN v.doc < u.doc THEN u.doc ELSE v.doc END AS doc_b, round(CAST(2 * m AS DOUBLE) / CAST(x.n + y.n AS DOUBLE), 6) AS dice
  FROM m JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b JOIN firsts u ON u.id = a JOIN firsts v ON v.id = b WHERE CAST(2 * m AS DOUBLE) / CAST(x.n + y.n AS DOUBLE) >= 0.85
  UNION ALL SELECT doc, doc_id, CAST(1 AS DOUBLE) FROM documents JOIN firsts ON coalesce(text, '') = t WHERE doc_id > doc""")
def near_dup_bag_dice(spark, d):
    """Pairs of different texts, by their first documents, and each further copy of a text with its first document.

    Texts are told apart by content, so null and repeated ids lose none; of a pair the smaller id comes first.
    """
    body = F.coalesce("text", F.lit(""))
    docs = read(spark, d, "documents").select("doc_id", body.alias("text"), F.unhex(F.md5(body)).alias("content"))
    firsts = materialise(docs.groupBy("content").agg(F.min("doc_id").alias("first")))
    pairs = alike_texts(docs.select("content", "text"), "content", "text", 0.85).select("a", "b", F.round(2 * F.col("m") / F.col("n"), 6).alias("dice"))
    of = lambda end: firsts.select(F.col("content").alias(end), F.struct("content", "first").alias(f"_{end}"))
    ends = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("x"), F.col("_b").alias("y"), "dice")
    turned = F.col("y.first") < F.col("x.first")
    end = lambda one, two: F.when(turned, F.col(one)).otherwise(F.col(two))
    found = ends.select(end("y.first", "x.first").alias("doc_a"), end("x.first", "y.first").alias("doc_b"), "dice")
    copies = docs.select("doc_id", "content").join(firsts, "content").filter("doc_id > first")
    return found.unionByName(copies.select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("dice")))


@query()
def greedy_match(spark, d):
    """Documents of similar texts, one to one: the most similar first."""
    return greedy_pairs(near_dup_bag_dice(spark, d), "doc_a", "doc_b", "dice")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def dedupe_keep_best(spark, d):
    return keep_best(read(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def prefer_flag_first(spark, d):
    return keep_best(read(spark, d, "orders"), ["o_custkey"], [F.desc(F.col("o_orderstatus") == "O"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3")
def topk_reasons(spark, d):
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return top_k(read(spark, d, "lineitem"), ["l_orderkey"], order, 3).select("l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 600")
def ranked_cap(spark, d):
    return read(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(600)


_SNAP = "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = {} GROUP BY o_custkey"


@query(f"""WITH y AS (SELECT max(year(o_orderdate)) AS y FROM orders), o AS ({_SNAP.format('(SELECT y - 2 FROM y)')}), n AS ({_SNAP.format('(SELECT y - 1 FROM y)')})
  SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed' WHEN o.n <> n.n THEN 'modified' ELSE 'unchanged' END AS status
  FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""")
def full_outer_diff_status(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    latest = orders.agg(F.max("y")).scalar()
    year = lambda back: orders.filter(F.col("y") == latest - back).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return snapshot_diff(year(2), year(1), "o_custkey", ["n"])


@query("SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_anti_stale(spark, d):
    """Customers without an urgent order, and parts that never came back."""
    urgent = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    back = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey")
    c = read(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    p = read(spark, d, "part").join(back, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return c.unionByName(p)


#: A number for each region, nation, customer and supplier.
_PLACES = """e AS (SELECT 4 * n_nationkey + 1 AS a, 4 * n_regionkey AS b FROM nation UNION ALL SELECT 4 * c_custkey + 2, 4 * c_nationkey + 1 FROM customer
    UNION ALL SELECT 4 * s_suppkey + 3, 4 * s_nationkey + 1 FROM supplier)"""


def _places(spark, d):
    """Links from each customer and supplier to its nation, and from each nation to its region."""
    link = lambda name, own, kind, of, above: read(spark, d, name).select((4 * F.col(own) + kind).cast("long").alias("a"), (4 * F.col(of) + above).cast("long").alias("b"))
    return link("nation", "n_nationkey", 1, "n_regionkey", 0).union(link("customer", "c_custkey", 2, "c_nationkey", 1)).union(link("supplier", "s_suppkey", 3, "s_nationkey", 1))


@query(f"""WITH RECURSIVE {_PLACES}, v AS (SELECT a AS id FROM e UNION SELECT b FROM e), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT id, id AS c FROM v UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
  SELECT CAST(id AS BIGINT) AS id, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY id""")
def components_of_links(spark, d):
    """Components of all customers, suppliers, nations and regions: a hub for each nation, a component for each region."""
    return connected_components(_places(spark, d))


@query()
def components_of_all_links(spark, d):
    """Components over every part-supplier link; the recursive SQL, a row per vertex and reachable vertex, is too slow for it."""
    edges = read(spark, d, "lineitem").select((2 * F.col("l_partkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return connected_components(edges)


@query("SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 15")
def hub_filter(spark, d):
    pairs = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("parts")).filter("parts >= 15")


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS disc, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS ret FROM lineitem GROUP BY l_orderkey),
  s AS (SELECT l_orderkey, least(100, greatest(0, CASE WHEN ret THEN 35 ELSE 0 END + CASE WHEN q >= 45 THEN 25 ELSE 0 END + CASE WHEN disc >= 0.08 THEN 20 ELSE 0 END + CASE WHEN n >= 6 THEN 30 ELSE 0 END - CASE WHEN n = 1 THEN 10 ELSE 0 END)) AS score FROM f)
  SELECT l_orderkey, CAST(score AS INTEGER) AS score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level FROM s""")
def weighted_rules_score(spark, d):
    f = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("disc"), F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("ret"))
    score = weighted_score((F.col("ret"), 35), (F.col("q") >= 45, 25), (F.col("disc") >= 0.08, 20), (F.col("n") >= 6, 30), (F.col("n") == 1, -10))
    return f.select("l_orderkey", score.alias("score")).withColumn("level", level(F.col("score")))


@query("""SELECT l_orderkey, CAST(least(100, max(q) + least(10, floor((sum(q) - max(q)) / 10))) AS BIGINT) AS score
  FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey""")
def rollup_bonus_score(spark, d):
    g = read(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q")).groupBy("l_orderkey").agg(F.max("q").alias("m"), F.sum("q").alias("s"))
    return g.select("l_orderkey", rolled_up(F.col("m"), F.col("s")).cast("long").alias("score"))


@query("SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS customers, CAST(grouping(n_name) AS INTEGER) AS is_total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def layer_rollup(spark, d):
    j = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.grouping("n_name").cast("int").alias("is_total"))


@query("SELECT event_type, CAST(count(*) FILTER (value < 10) AS BIGINT) AS info, CAST(count(*) FILTER (value >= 10 AND value < 50) AS BIGINT) AS warning, CAST(count(*) FILTER (value >= 50) AS BIGINT) AS error FROM events GROUP BY event_type")
def pivot_severity(spark, d):
    band = F.when(F.col("value") < 10, "info").when(F.col("value") < 50, "warning").when(F.col("value") >= 50, "error")
    p = read(spark, d, "events").select("event_type", band.alias("band")).groupBy("event_type").pivot("band", ["info", "warning", "error"]).count()
    return p.fillna(0)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events")
def asof_delta(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return as_of(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type""")
def gap_islands(spark, d):
    r = runs(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def prefix_offsets(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("start"))


@query("""SELECT conv_id, turn, coalesce(lag(turn) OVER w, max(turn) OVER (PARTITION BY conv_id)) AS prev_turn, coalesce(lead(turn) OVER w, min(turn) OVER (PARTITION BY conv_id)) AS next_turn
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def prev_next_wrap(spark, d):
    w, every = Window.partitionBy("conv_id").orderBy("turn", "role", "text"), Window.partitionBy("conv_id")
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), F.max("turn").over(every)).alias("prev_turn"), F.coalesce(F.lead("turn").over(w), F.min("turn").over(every)).alias("next_turn"))


@query("SELECT l_returnflag, l_linestatus, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1995 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1996")
def multiset_except(spark, d):
    rows = read(spark, d, "lineitem")
    year = lambda y: rows.filter(F.year("l_shipdate") == y).select("l_returnflag", "l_linestatus", "l_suppkey")
    return year(1995).exceptAll(year(1996))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CAST(len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/')) AS INTEGER) AS depth FROM pages")
def path_parts(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.size(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/")).alias("depth"))


@query("SELECT lang, string_agg(source || ':' || n, ' ' ORDER BY n DESC, source) AS histogram FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def histogram_text(spark, d):
    g = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "source", "n")))
    return g.groupBy("lang").agg(parts.alias("p")).select("lang", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["source"], x["n"])), " ").alias("histogram"))


@query("""SELECT CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (o_totalprice >= 200000) AS BIGINT) AS large,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders""")
def summary_counters(spark, d):
    return read(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") >= 200000).alias("large"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT doc_id, lower(text) LIKE '%the%' AS hit, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS newlines FROM documents")
def search_substring(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.contains(F.lower(text), F.lit("the")).alias("hit"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int").alias("newlines"))


@query("SELECT l.doc_id, d.doc_id IS NULL AS stale FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def seen_stale(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.lit(True).alias("seen"))
    return read(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", F.col("seen").isNull().alias("stale"))


@query(f"""WITH RECURSIVE {_PLACES}, r AS (SELECT a AS id, b AS reached, 1 AS depth FROM e UNION ALL SELECT r.id, e.b, r.depth + 1 FROM r JOIN e ON r.reached = e.a)
  SELECT CAST(id AS BIGINT) AS id, CAST(reached AS BIGINT) AS reached, CAST(depth AS INTEGER) AS depth FROM r""")
def closure_with_depth(spark, d):
    return closure(_places(spark, d))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  c AS (SELECT user_id, pos, CASE WHEN pos - 3 <= lag(pos) OVER w + 4 THEN 0 ELSE 1 END AS x FROM p WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
  r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hunk FROM c)
  SELECT user_id, CAST(hunk AS BIGINT) AS hunk, CAST(greatest(1, min(pos) - 3) AS BIGINT) AS first, CAST(max(pos) + 3 AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS changes FROM r GROUP BY user_id, hunk""")
def hunks_with_context(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return hunks(read(spark, d, "events").select("user_id", "event_type", place.alias("pos")), ["user_id"], "pos", F.col("event_type") == "purchase")


@query()
def turn_edits(spark, d):
    """Words that each turn of a conversation keeps, drops and adds against the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    turns = read(spark, d, "conversations").select("conv_id", "turn", words.alias("new"), F.lag(words).over(w).alias("old"))
    kinds = edit_scripts(turns, {"conv_id": "long", "turn": "int"}, "old", "new").groupBy("conv_id", "turn")
    return kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("same", "del", "add")])


@query()
def turn_word_diffs(spark, d):
    """Each turn of a conversation against the turn before it, word by word: how alike, and the stretches that changed."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("new"), F.lag("text").over(w).alias("old"))
    return word_diffs(turns, {"conv_id": "long", "turn": "long"}, "old", "new")


@query()
def replaced_line_diffs(spark, d):
    """Of the lines that a turn has in place of the turn before it, the k-th of a stretch with the k-th, word by word."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    turns = read(spark, d, "conversations").select("conv_id", "turn", lines.alias("new"), F.lag(lines).over(w).alias("old"))
    steps = materialise(edit_scripts(turns, {"conv_id": "long", "turn": "long"}, "old", "new"))
    pairs = materialise(replaced_lines(steps, ["conv_id", "turn"]).withColumnsRenamed({"old_no": "old_line", "new_no": "new_line"}))
    return word_diffs(pairs, {"conv_id": "long", "turn": "long", "old_line": "int", "new_line": "int"}, "old", "new")
