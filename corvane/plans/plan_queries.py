"""Queries of reading plans and state: levels of a cyclic graph, marks by stream, nested spans, parts under a cap, rules as data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.fingerprints import changes, fingerprint, moved_by
from corvane.operators.graph import levels_of_cyclic, nearest_above
from corvane.operators.intervals import innermost
from corvane.operators.ordered import parts_under_cap, places
from corvane.operators.ranking import keep_best
from corvane.operators.scoring import Rule, assessed
from corvane.plans.registry import query, read
from corvane.scratch import scratch_dir
from corvane.streaming.marks import current, effective, follow, patches

_FOLLOWERS = """f AS (SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS t FROM lineitem),
  c AS (SELECT least(s, t) AS lo, greatest(s, t) AS hi, sum(CASE WHEN s < t THEN 1 ELSE -1 END) AS d FROM f WHERE t IS NOT NULL AND s <> t GROUP BY ALL),
  w AS (SELECT CASE WHEN d > 0 THEN lo ELSE hi END AS u, CASE WHEN d > 0 THEN hi ELSE lo END AS v, abs(d) AS w FROM c WHERE d <> 0),
  e AS (SELECT u, v FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM w) WHERE r = 1)"""


def followers(spark, d):
    """``u, v``: of each supplier the one that follows it most, net, in the shipments of a part."""
    after = F.lead("l_suppkey").over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))
    pairs = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), after.alias("t")).filter("t IS NOT NULL AND s <> t")
    net = pairs.groupBy(F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")).agg(F.sum(F.when(F.col("s") < F.col("t"), 1).otherwise(-1)).alias("d")).filter("d <> 0")
    up = F.col("d") > 0
    edges = net.select(F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("v"), F.abs("d").alias("w"))
    return keep_best(edges, ["u"], [F.desc("w"), F.col("v")]).select("u", "v")


@query(f"""WITH RECURSIVE {_FOLLOWERS}, r(a, b) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
  ids AS (SELECT u AS id FROM e UNION SELECT v FROM e), m AS (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a),
  comp AS (SELECT id, least(id, coalesce(min(m.b), id)) AS component FROM ids LEFT JOIN m ON m.a = id GROUP BY id),
  ce AS (SELECT DISTINCT x.component AS cu, y.component AS cv FROM e JOIN comp x ON x.id = u JOIN comp y ON y.id = v WHERE x.component <> y.component),
  lv(c, d) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT ce.cv, d + 1 FROM lv JOIN ce ON ce.cu = lv.c),
  top AS (SELECT c, max(d) AS level FROM lv GROUP BY c), n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT id AS l_suppkey, component, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (ORDER BY level, n DESC, id) AS BIGINT) AS place FROM comp JOIN top ON c = component JOIN n ON l_suppkey = id""")
def plan_levels(spark, d):
    """A plan over suppliers that follow each other: cycles as one, by level, then the busiest first; every supplier's place."""
    ranked = levels_of_cyclic(followers(spark, d), "u", "v")
    busy = read(spark, d, "lineitem").groupBy("l_suppkey").agg((-F.count("*")).alias("_less"))
    ready = ranked.join(busy, F.col("id") == F.col("l_suppkey")).select("l_suppkey", "component", "level", "_less")
    return places(ready, ["level", "_less", "l_suppkey"]).select("l_suppkey", "component", "level", "place")


@query("""WITH s AS (SELECT o_custkey AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_ms(l_shipdate) // 86400000 AS a, epoch_ms(l_shipdate) // 86400000 + CAST(floor(l_quantity) AS BIGINT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  p AS (SELECT o_orderkey, o_custkey, epoch_ms(o_orderdate) // 86400000 AS day FROM orders),
  m AS (SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY o_orderkey) AS depth, row_number() OVER (PARTITION BY o_orderkey ORDER BY b - a, a DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM p JOIN s ON k = o_custkey AND day BETWEEN a AND b)
  SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(depth AS BIGINT) AS depth FROM m WHERE r = 1""")
def nested_spans(spark, d):
    """For the day of each order the innermost span of days of its customer's shipments around it, and how many there are."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("at"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("a"), (day("l_shipdate") + F.floor("l_quantity")).alias("b"))
    spans = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return innermost(orders, spans, ["o_custkey"], "at", "a", "b", ["o_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


#: Rows of a part, for tables as small as those given.
PART_CAP = 5


@query(f"""WITH RECURSIVE n AS (SELECT p_brand, p_type, p_name, count(*) AS w FROM part GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) AS pos FROM n),
  g AS (SELECT p_brand, p_type, p_name, pos, 1 AS first, CAST(ceil(w / {PART_CAP}.0) AS INTEGER) AS last, CASE WHEN w > {PART_CAP} THEN {PART_CAP} ELSE w END AS held FROM u WHERE pos = 1
    UNION ALL SELECT u.p_brand, u.p_type, u.p_name, u.pos, CASE WHEN g.held + u.w > {PART_CAP} THEN g.last + 1 ELSE g.last END, CASE WHEN g.held + u.w > {PART_CAP} THEN g.last + CAST(ceil(u.w / {PART_CAP}.0) AS INTEGER) ELSE g.last END,
      CASE WHEN u.w > {PART_CAP} THEN {PART_CAP} WHEN g.held + u.w > {PART_CAP} THEN u.w ELSE g.held + u.w END FROM g JOIN u ON u.p_brand = g.p_brand AND u.p_type = g.p_type AND u.pos = g.pos + 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_name ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS brand FROM part),
  k AS (SELECT p_brand, p_type, max(last) AS parts FROM g GROUP BY ALL)
  SELECT p_partkey, p_brand, CASE WHEN brand > {PART_CAP} THEN p_type END AS package, CAST(CASE WHEN brand > {PART_CAP} THEN first + (r - 1) // {PART_CAP} END AS BIGINT) AS part, CAST(CASE WHEN brand > {PART_CAP} THEN parts END AS BIGINT) AS parts FROM p JOIN g USING (p_brand, p_type, p_name) JOIN k USING (p_brand, p_type)""")
def capped_parts(spark, d):
    """Parts of a brand whole if they are few, else by package, packages cut under the cap between names; long names are sliced."""
    rows = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name", (-F.col("p_retailprice")).alias("_less"))
    cut = parts_under_cap(rows, ["p_brand", "p_type"], "p_name", ["_less", "p_partkey"], PART_CAP)
    # Brands of few parts are known by their number, as many rows as brands.
    sizes = rows.groupBy("p_brand").agg((F.count("*") > PART_CAP).alias("_large"))
    only = lambda c: F.when(F.col("_large"), F.col(c))
    return cut.join(sizes, "p_brand").select("p_partkey", "p_brand", only("p_type").alias("package"), only("part").alias("part"), only("parts").alias("parts"))


_ITEM = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


def mark_patches(events):
    """Events as patches of a user's marks: errors take a mark back, purchases note their value (none below 20), the rest mark as seen."""
    kind, whole = F.col("event_type"), F.floor("value").cast("string")
    field = F.when(kind == "purchase", "note").otherwise("seen")
    item = F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("item")
    deleted = (kind == "error") | ((kind == "purchase") & (F.col("value") < 20))
    return patches(events.select("user_id", item, "event_type", "value", "ts", "event_id"), ["user_id", "item"], field, whole, deleted, F.col("ts"), F.col("event_id"))


@query(f"""WITH p AS (SELECT user_id, {_ITEM} AS item, CASE WHEN event_type = 'purchase' THEN 'note' ELSE 'seen' END AS field, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, event_type = 'error' OR (event_type = 'purchase' AND value < 20) AS deleted, ts, event_id FROM events),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item, field ORDER BY ts DESC, event_id DESC) AS r FROM p) WHERE r = 1 AND NOT deleted),
  now AS (SELECT {_ITEM} AS item, CAST(CAST(floor(max(value)) AS BIGINT) AS VARCHAR) AS print FROM events GROUP BY 1)
  SELECT user_id, l.item, 'seen' AS field, CASE WHEN value <> print THEN 'stale' ELSE 'seen' END AS value FROM l JOIN now USING (item) WHERE field = 'seen' UNION ALL SELECT user_id, item, field, value FROM l WHERE field = 'note'""")
def seen_marks_stream(spark, d):
    """Marks and notes that a stream of events leaves, and whether each mark still fits its item's print, the item's greatest value."""
    events = read(spark, d, "events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file
    target, keys = scratch_dir(spark), ["user_id", "item"]
    rows = mark_patches(source)
    follow(rows, keys, target, f"{target}-checkpoint").awaitTermination()
    marks = current(spark, target, rows.select(*keys, "field", "value", "deleted", "at", "number").schema, keys)
    prints = events.groupBy(F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("item")).agg(F.floor(F.max("value")).cast("string").alias("print"))
    status = effective(marks, prints, keys, ["item"]).select(*keys, F.lit("seen").alias("field"), F.col("status").alias("value"))
    return status.unionByName(marks.filter("field = 'note'").select(*keys, "field", "value"))


@query("""WITH RECURSIVE up AS (SELECT 'o' || o_orderkey AS c, 'c' || o_custkey AS p FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
  holds AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r' || r_regionkey FROM region),
  walls AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 1),
  w AS (SELECT c AS id, p AS met, 1 AS depth FROM up UNION ALL SELECT w.id, up.p, depth + 1 FROM w JOIN up ON up.c = w.met WHERE w.met NOT IN (SELECT id FROM holds) AND w.met NOT IN (SELECT id FROM walls))
  SELECT id, met AS found, CAST(depth AS INTEGER) AS depth FROM w WHERE met IN (SELECT id FROM holds)""")
def nearest_unblocked(spark, d):
    """Of each order, customer and nation the nearest above it that holds, unless one that is a barrier lies between."""
    named = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    link = lambda t, a, ka, b, kb: read(spark, d, t).select(named(a, ka).alias("child"), named(b, kb).alias("parent"))
    up = link("orders", "o", "o_orderkey", "c", "o_custkey").union(link("customer", "c", "c_custkey", "n", "c_nationkey")).union(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    some = lambda t, letter, key, which: read(spark, d, t).filter(which).select(named(letter, key).alias("id"))
    holds = some("customer", "c", "c_custkey", "c_acctbal >= 5000").union(some("nation", "n", "n_nationkey", "n_nationkey % 3 = 0")).union(some("region", "r", "r_regionkey", "true"))
    walls = some("customer", "c", "c_custkey", "c_mktsegment = 'BUILDING'").union(some("nation", "n", "n_nationkey", "n_nationkey % 4 = 1"))
    return nearest_above(up, holds, walls)


@query("""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations)
  SELECT conv_id, turn, role, CAST(sum(CAST('0x' || md5(line)[1:8] AS UBIGINT)) AS BIGINT) AS print FROM l GROUP BY ALL""")
def turn_fingerprints(spark, d):
    """Fingerprints of the turns' lines: each from the turn before it by the lines that came and went, none read anew."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    by = moved_by(changes(turns, ["conv_id"], ["turn", "role"], "lines"), ["conv_id", "turn", "role"])
    told = turns.select("conv_id", "turn", "role").join(by, ["conv_id", "turn", "role"], "left")
    order = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return told.select("conv_id", "turn", "role", F.sum(F.coalesce("by", F.lit(0))).over(order).alias("print"))


#: Rules over a line and its order. Lines that are still open can't be certain of what returns say.
RULES = [
    Rule("returned", "concat('returned by mode ', l_returnflag)", "25", "l_returnflag = 'R'", uncertain=True),
    Rule("returned", "concat('returned by mode ', l_returnflag)", "10", "l_returnflag IN ('R', 'A') AND l_discount >= 0.05", uncertain=True),
    Rule("discount", "'large discount'", "CAST(round(l_discount * 200) AS INT)", "l_discount >= 0.08"),
    Rule("volume", "concat('quantity ', CAST(CAST(l_quantity AS INT) AS STRING))", "IF(l_quantity >= 45, 20, 12)", "l_quantity >= 40"),
    Rule("price", "'dear'", "15", "l_extendedprice >= 60000"),
    Rule("urgent", "concat('priority ', o_orderpriority)", "30", "o_orderpriority = '1-URGENT'"),
    Rule("urgent", "concat('priority ', o_orderpriority)", "18", "o_orderpriority = '2-HIGH'"),
    Rule("failed", "'order failed'", "22", "o_orderstatus = 'F'", uncertain=True),
    Rule("value", "'order of much value'", "9", "o_totalprice >= 300000"),
    Rule("tax", "'untaxed'", "-5", "l_tax = 0"),
]


def _rules_sql() -> str:
    """The reasons of RULES as DuckDB's SQL, once for each rule; what is de-duplicated is told by a rule's number."""
    text = lambda s: s.replace("CAST(l_quantity AS INT)", "CAST(trunc(l_quantity) AS INTEGER)").replace("AS STRING", "AS VARCHAR").replace("IF(", "if(")
    each = []
    for k, r in enumerate(RULES):
        doubt = f"CASE WHEN open THEN CAST(floor(({r.weight}) / 4.0 + 0.5) AS INTEGER) ELSE {text(r.weight)} END" if r.uncertain else text(r.weight)
        said = f"CASE WHEN open THEN concat({text(r.message)}, ' (unverified)') ELSE {text(r.message)} END" if r.uncertain else text(r.message)
        each.append(f"SELECT n, {k} AS k, '{r.code}' AS code, {said} AS message, CAST({doubt} AS INTEGER) AS weight FROM j WHERE {r.when}")
    return " UNION ALL ".join(each)


@query(f"""WITH j AS (SELECT row_number() OVER () AS n, *, l_linestatus = 'O' AS open FROM lineitem JOIN orders ON l_orderkey = o_orderkey), a AS ({_rules_sql()}),
  b AS (SELECT *, row_number() OVER (PARTITION BY n, code, message ORDER BY k) AS r FROM a), c AS (SELECT n, sum(weight) AS raw, string_agg(code || ':' || weight, ',' ORDER BY k) AS said FROM b WHERE r = 1 GROUP BY n),
  s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(raw, 0) AS raw, coalesce(said, '') AS said, o_orderpriority = '5-LOW' AS test FROM j LEFT JOIN c USING (n)),
  t AS (SELECT *, CAST(CASE WHEN test AND raw > 0 THEN floor(least(raw, 100) / 2.0 + 0.5) ELSE greatest(0, least(100, raw)) END AS INTEGER) AS score FROM s)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, said || CASE WHEN test AND raw > 0 THEN CASE WHEN said <> '' THEN ',' ELSE '' END || 'test:' || CAST(score - least(raw, 100) AS INTEGER) ELSE '' END AS said, score,
    CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level FROM t""")
def rule_table_score(spark, d):
    """Lines of orders by a table of rules: which hold and what they weigh, once each; unsure ones a quarter, tests half."""
    lines, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    told = assessed(rows, RULES, "o_orderpriority = '5-LOW'", "l_linestatus = 'O'")
    said = F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["code"], r["weight"])), ",")
    return told.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", said.alias("said"), "score", "level")
