"""Queries of how reviews are shown and compared: multiset changes, keyed lists, groups by worst severity, spans, folded rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.ordered import places
from corvane.operators.ranking import select_spans
from corvane.operators.sequences import edit_scripts
from corvane.operators.shown import fold, side_by_side
from corvane.plans.registry import MICROS, query, read
from corvane.scratch import materialise


@query("""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS old FROM conversations),
  w AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), ' ')) AS w, 1 AS d FROM t UNION ALL SELECT conv_id, turn, unnest(string_split(coalesce(old, ''), ' ')), -1 FROM t),
  g AS (SELECT conv_id, turn, w, sum(d) AS d FROM w WHERE w <> '' GROUP BY ALL)
  SELECT conv_id, turn, CAST(coalesce(sum(d) FILTER (d > 0), 0) AS BIGINT) AS added, CAST(coalesce(-sum(d) FILTER (d < 0), 0) AS BIGINT) AS removed FROM g GROUP BY conv_id, turn""")
def multiset_delta(spark, d):
    """Words that each turn has more or less often than the turn before it; both sides meet in one aggregation, without a join."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    sides = read(spark, d, "conversations").select("conv_id", "turn", F.array(F.struct(F.col("text").alias("t"), F.lit(1).alias("d")), F.struct(before.alias("t"), F.lit(-1).alias("d"))).alias("sides"))
    words = sides.select("conv_id", "turn", F.explode("sides").alias("s")).select("conv_id", "turn", "s.d", F.explode(F.split(F.coalesce("s.t", F.lit("")), " ")).alias("w"))
    g = words.filter("w <> ''").groupBy("conv_id", "turn", "w").agg(F.sum("d").alias("d"))
    return g.groupBy("conv_id", "turn").agg(F.sum(F.greatest(F.col("d"), F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


@query("""WITH m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS middle FROM events), e AS (SELECT *, epoch_us(ts) > middle AS late FROM events, m),
  g AS (SELECT user_id, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS k, arg_max(value, (ts, event_id)) FILTER (NOT late) AS old, arg_max(value, (ts, event_id)) FILTER (late) AS new FROM e GROUP BY ALL)
  SELECT user_id, event_type, CASE WHEN n = 0 THEN 'added' WHEN k = 0 THEN 'removed' WHEN old IS DISTINCT FROM new THEN 'changed' ELSE 'same' END AS status FROM g""")
def keyed_lists(spark, d):
    """Two keyed lists per user, either half of the time; of entries with one key the last counts, then keys are compared."""
    e = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value", F.expr(MICROS).alias("t"))
    late = F.col("t") > e.agg(F.expr("(min(t) + max(t)) div 2")).scalar()
    last = lambda side: F.max(F.when(side, F.struct("ts", "event_id", "value")))
    g = e.groupBy("user_id", "event_type").agg(last(~late).alias("old"), last(late).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old.value").eqNullSafe(F.col("new.value")), "changed").otherwise("same")
    return g.select("user_id", "event_type", status.alias("status"))


@query("""WITH f AS (SELECT event_type AS category, CASE WHEN value >= 50 THEN 0 WHEN value >= 10 THEN 1 ELSE 2 END AS rank FROM events),
  g AS (SELECT category, count(*) AS n, min(rank) AS worst FROM f WHERE rank <= 1 GROUP BY category)
  SELECT category, CAST(n AS BIGINT) AS items, CASE worst WHEN 0 THEN 'error' ELSE 'warning' END AS worst, CAST(row_number() OVER (ORDER BY worst, n DESC, category) AS INTEGER) AS place FROM g""")
def findings_by_worst(spark, d):
    """Findings of a least severity in groups by category, the worst groups first, larger before smaller.

    Categories are few however many findings there are, so the window over all of them is over counts.
    """
    severity = F.when(F.col("value") >= 50, 0).when(F.col("value") >= 10, 1).otherwise(2)
    g = read(spark, d, "events").select(F.col("event_type").alias("category"), severity.alias("rank")).filter("rank <= 1").groupBy("category").agg(F.count("*").alias("items"), F.min("rank").alias("w"))
    place = F.row_number().over(Window.orderBy("w", F.desc("items"), "category"))
    return g.select("category", "items", F.when(F.col("w") == 0, "error").otherwise("warning").alias("worst"), place.alias("place"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS p, epoch_ms(l_shipdate) // 86400000 AS a, epoch_ms(l_shipdate) // 86400000 + CAST(floor(l_quantity) AS BIGINT) AS b,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY epoch_ms(l_shipdate) // 86400000, floor(l_quantity) DESC, l_linenumber, l_partkey) AS r FROM lineitem WHERE l_quantity >= 1),
  g AS (SELECT k, r, no, p, a, b, b AS last, true AS kept FROM s WHERE r = 1
    UNION ALL SELECT s.k, s.r, s.no, s.p, s.a, s.b, CASE WHEN s.a >= g.last THEN s.b ELSE g.last END, s.a >= g.last FROM g JOIN s ON s.k = g.k AND s.r = g.r + 1)
  SELECT k AS l_orderkey, no AS l_linenumber, p AS l_partkey, CAST(a AS BIGINT) AS first_day, CAST(b AS BIGINT) AS end_day FROM g WHERE kept""")
def spans_without_overlap(spark, d):
    """Of each order's spans of days the earliest, longest first, that overlap none chosen before them."""
    first = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", first.alias("first_day"), (first + F.floor("l_quantity")).cast("long").alias("end_day"))
    return select_spans(rows, ["l_orderkey"], "first_day", "end_day", ["l_linenumber", "l_partkey"])


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  n AS (SELECT *, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS shown FROM p),
  b AS (SELECT *, CASE WHEN lag(shown) OVER (PARTITION BY user_id ORDER BY pos) IS NOT DISTINCT FROM shown THEN 0 ELSE 1 END AS x FROM n),
  r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM b)
  SELECT user_id, CAST(min(pos) AS INTEGER) AS pos, CASE WHEN shown THEN 'line' ELSE 'gap' END AS kind, CAST(count(*) AS BIGINT) AS lines FROM r GROUP BY user_id, shown, run, CASE WHEN shown THEN pos ELSE 0 END""")
def folded_rows(spark, d):
    """Rows as they are shown: changed ones with three neighbours on either side, and one row for each gap between them."""
    order = Window.partitionBy("user_id").orderBy("pos")
    p = read(spark, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))
    shown = F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(order.rowsBetween(-3, 3)) == 1
    marked = p.select("user_id", "pos", shown.alias("shown"))
    fresh = F.when(F.lag("shown").over(order).eqNullSafe(F.col("shown")), 0).otherwise(1)
    runs = marked.withColumn("x", fresh).withColumn("run", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("user_id", "shown", "run", F.when(F.col("shown"), F.col("pos")).otherwise(0).alias("own")).agg(F.min("pos").alias("pos"), F.count("*").alias("lines"))
    return g.select("user_id", "pos", F.when(F.col("shown"), "line").otherwise("gap").alias("kind"), "lines")


@query("""WITH p AS (SELECT user_id, event_type, CAST(event_id AS VARCHAR) AS value, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'del' ELSE 'same' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  n AS (SELECT *, CASE WHEN kind <> 'add' THEN count(*) FILTER (kind <> 'add') OVER w END AS o, CASE WHEN kind <> 'del' THEN count(*) FILTER (kind <> 'del') OVER w END AS n,
    bool_or(kind <> 'same') OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT *, CASE WHEN lag(near) OVER (PARTITION BY user_id ORDER BY pos) IS NOT DISTINCT FROM near THEN 0 ELSE 1 END AS x FROM n),
  r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM x),
  u AS (SELECT *, near OR first_value(event_type) OVER (PARTITION BY user_id, run ORDER BY pos) = 'signup' AS shown FROM r),
  f AS (SELECT user_id, min(pos) AS pos, CASE WHEN shown THEN min(kind) ELSE 'gap' END AS kind, min(o) AS o, min(n) AS n, CASE WHEN shown THEN min(value) END AS value, CASE WHEN NOT shown THEN count(*) END AS hidden FROM u GROUP BY user_id, run, shown, CASE WHEN shown THEN pos END),
  l AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY pos), '') AS k FROM f),
  b AS (SELECT *, sum(CASE WHEN kind = 'del' AND k = 'del' OR kind = 'add' AND k IN ('del', 'add') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l),
  c AS (SELECT *, row_number() OVER (PARTITION BY user_id, block, kind ORDER BY pos) AS nth FROM b),
  d AS (SELECT * FROM c WHERE kind = 'del'), a AS (SELECT * FROM c WHERE kind = 'add'),
  e AS (SELECT user_id, block, nth, kind, o, value AS left_value, n, value AS right_value, hidden FROM c WHERE kind IN ('same', 'gap')
    UNION ALL SELECT coalesce(d.user_id, a.user_id), coalesce(d.block, a.block), coalesce(d.nth, a.nth), CASE WHEN a.user_id IS NULL THEN 'del' WHEN d.user_id IS NULL THEN 'add' ELSE 'changed' END, d.o, d.value, a.n, a.value, NULL FROM d FULL JOIN a ON d.user_id = a.user_id AND d.block = a.block AND d.nth = a.nth)
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY block, nth) AS INTEGER) AS row, kind, CAST(o AS INTEGER) AS left_no, left_value AS left, CAST(n AS INTEGER) AS right_no, right_value AS right, CAST(hidden AS BIGINT) AS hidden FROM e""")
def event_side_by_side(spark, d):
    """Users' events as lines of which errors went and purchases came, in two columns; gaps that begin with a signup are open."""
    w = Window.partitionBy("user_id").orderBy("pos")
    kind = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "del").otherwise("same")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = read(spark, d, "events").select("user_id", "event_type", F.col("event_id").cast("string").alias("value"), kind.alias("kind"), pos.alias("pos"))
    number = lambda other: F.when(F.col("kind") != other, F.count_if(F.col("kind") != other).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")
    steps = p.select("user_id", "event_type", "pos", "kind", number("add").alias("old_no"), number("del").alias("new_no"), "value")
    opened = steps.filter("event_type = 'signup'").select("user_id", "new_no")
    return side_by_side(fold(steps, ["user_id"], 3, opened), ["user_id"])


@query()
def turn_side_by_side(spark, d):
    """Each turn's words against those of the turn before it in two columns, unchanged stretches folded."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("nth"), words.alias("new"), F.lag(words).over(w).alias("old"))
    steps = materialise(edit_scripts(turns, {"conv_id": "long", "turn": "int", "nth": "int"}, "old", "new"))
    return side_by_side(fold(steps, ["conv_id", "turn", "nth"]), ["conv_id", "turn", "nth"])


@query("""WITH f AS (SELECT event_type AS category, CASE WHEN value >= 50 THEN 0 WHEN value >= 10 THEN 1 ELSE 2 END AS rank, event_id FROM events), s AS (SELECT * FROM f WHERE rank <= 1),
  g AS (SELECT category, count(*) AS n, min(rank) AS worst FROM s GROUP BY category), h AS (SELECT *, row_number() OVER (ORDER BY worst, n DESC, category) AS p FROM g),
  r AS (SELECT p, category, 0 AS item, worst AS rank, n, NULL AS event_id FROM h UNION ALL SELECT p, s.category, 1, s.rank, NULL, event_id FROM s JOIN h ON s.category IS NOT DISTINCT FROM h.category)
  SELECT CAST(row_number() OVER (ORDER BY p, item, rank, event_id) AS BIGINT) AS place, CASE item WHEN 0 THEN 'cat' ELSE 'finding' END AS kind, category, CASE rank WHEN 0 THEN 'error' ELSE 'warning' END AS severity, CAST(n AS BIGINT) AS items, event_id FROM r""")
def finding_rows(spark, d):
    """The list of findings as it is shown: a header for each category, the worst first, and its findings under it, the worst first.

    Categories are few, but one of them may hold most findings: places come from running sums over ranges of the whole order.
    """
    severity = F.when(F.col("value") >= 50, 0).when(F.col("value") >= 10, 1).otherwise(2)
    found = read(spark, d, "events").select(F.col("event_type").alias("category"), severity.alias("rank"), "event_id").filter("rank <= 1")
    groups = found.groupBy("category").agg(F.count("*").alias("items"), F.min("rank").alias("rank"))
    # As many rows as categories.
    heads = materialise(groups.withColumn("p", F.row_number().over(Window.orderBy("rank", F.desc("items"), "category"))))
    own = heads.select("p", F.col("category").alias("_category"))
    items = found.join(own, F.col("category").eqNullSafe(F.col("_category"))).select("p", "category", F.lit(1).alias("item"), "rank", F.lit(None).cast("long").alias("items"), "event_id")
    rows = heads.select("p", "category", F.lit(0).alias("item"), "rank", "items", F.lit(None).cast("long").alias("event_id")).unionByName(items)
    kind = F.when(F.col("item") == 0, "cat").otherwise("finding")
    return places(rows, ["p", "item", "rank", "event_id"]).select("place", kind.alias("kind"), "category", F.when(F.col("rank") == 0, "error").otherwise("warning").alias("severity"), "items", "event_id")
