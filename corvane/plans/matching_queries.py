"""More change-analysis queries: matching in passes, priorities, inherited levels, containment, layers, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.matching import bigram_sets, bigrams, contained_bags, dice_pairs, distinct_texts
from corvane.operators.ranking import keep_best
from corvane.plans.registry import MICROS, query, read
from corvane.scratch import materialise


@query("""WITH texts AS (SELECT 'd' AS side, min(doc_id) AS id, coalesce(text, '') AS t FROM documents GROUP BY 3 UNION ALL SELECT 'b', min(item_id), coalesce(text, '') FROM benchmark GROUP BY 3),
  words AS (SELECT side, id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM texts),
  bags AS (SELECT side, id, t, gram, count(*) AS c FROM (SELECT side, id, t, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM words) GROUP BY ALL),
  sizes AS (SELECT side, t, sum(c) AS n FROM bags GROUP BY ALL),
  m AS (SELECT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb, sum(least(a.c, b.c)) AS m FROM bags a JOIN bags b ON a.gram = b.gram AND a.side = 'd' AND b.side = 'b' GROUP BY ALL)
  SELECT a AS doc_id, b AS item_id, round(CAST(2 * m AS DOUBLE) / CAST(x.n + y.n AS DOUBLE), 6) AS dice FROM m JOIN sizes x ON x.side = 'd' AND x.t = ta JOIN sizes y ON y.side = 'b' AND y.t = tb
  WHERE CAST(2 * m AS DOUBLE) / CAST(x.n + y.n AS DOUBLE) >= 0.5""")
def contamination_bag_overlap(spark, d):
    """Different texts of documents, by their first, and of benchmark items whose bags of word bigrams are alike."""
    docs, items = distinct_texts(read(spark, d, "documents"), "doc_id", "text"), distinct_texts(read(spark, d, "benchmark"), "item_id", "text")
    sets = lambda texts, key: materialise(bigram_sets(texts, "id", "text").withColumnRenamed("id", key))
    pairs = dice_pairs(sets(docs, "a"), sets(items, "b"), "a", "b", 0.5)
    of = lambda texts, key, name: texts.select(F.col("id").alias(key), F.col("first").alias(name))
    return pairs.join(of(docs, "a", "doc_id"), "a").join(of(items, "b", "item_id"), "b").select("doc_id", "item_id", "dice")


@query("""WITH texts AS (SELECT DISTINCT 'd' AS side, coalesce(text, '') AS t FROM documents UNION ALL SELECT DISTINCT 'b', coalesce(text, '') FROM benchmark),
  words AS (SELECT side, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM texts),
  bags AS (SELECT side, t, gram, count(*) AS c FROM (SELECT side, t, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM words) GROUP BY ALL),
  sizes AS (SELECT t, sum(c) AS n FROM bags WHERE side = 'b' GROUP BY t),
  m AS (SELECT a.t AS a, b.t AS b, sum(least(a.c, b.c)) AS m FROM bags a JOIN bags b ON a.gram = b.gram AND a.side = 'd' AND b.side = 'b' GROUP BY ALL)
  SELECT doc_id, item_id, round(CAST(m AS DOUBLE) / CAST(n AS DOUBLE), 6) AS share FROM m JOIN sizes ON sizes.t = m.b JOIN documents d ON coalesce(d.text, '') = m.a JOIN benchmark i ON coalesce(i.text, '') = m.b
  WHERE CAST(m AS DOUBLE) / CAST(n AS DOUBLE) >= 0.5""")
def contamination_item_share(spark, d):
    """Every document that has half or more of a benchmark item's word bigrams, however long the document is.

    Rows are numbered, so null or repeated ids neither join nor lose texts. Documents keep only the items'
    grams, a written table that Spark broadcasts where it is small enough, as a benchmark's is, and shuffles otherwise.
    """
    items = read(spark, d, "benchmark").select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = materialise(bigrams(items, ["item", "item_id"], "text").groupBy("item", "item_id", "gram").agg(F.count("*").alias("c")))
    docs = read(spark, d, "documents").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    grams = materialise(items.select("gram").distinct())
    hits = bigrams(docs, ["doc", "doc_id"], "text").join(grams, "gram", "left_semi")
    docs = materialise(hits.groupBy("doc", "doc_id", "gram").agg(F.count("*").alias("c")))
    found = contained_bags(docs.select("doc", "gram", "c"), items.select("item", "gram", "c"), "doc", "item", 0.5)
    return found.join(docs.select("doc", "doc_id").distinct(), "doc").join(items.select("item", "item_id").distinct(), "item").select("doc_id", "item_id", "share")


@query("""WITH o AS (SELECT o_custkey, floor(o_totalprice / 1000) AS k, o_orderkey FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT o_custkey, floor(o_totalprice / 1000) AS k, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
  u AS (SELECT o_custkey, k, min(o_orderkey) AS old_key FROM o GROUP BY ALL HAVING count(*) = 1), v AS (SELECT o_custkey, k, min(o_orderkey) AS new_key FROM f GROUP BY ALL HAVING count(*) = 1)
  SELECT old_key, new_key FROM u JOIN v USING (o_custkey, k)""")
def trivial_unique_match(spark, d):
    """Rows of two sides that agree on a key that occurs once on each side."""
    orders = read(spark, d, "orders").withColumn("k", F.floor(F.col("o_totalprice") / 1000))

    def alone(status, name):
        return orders.filter(F.col("o_orderstatus") == status).groupBy("o_custkey", "k").agg(F.count("*").alias("n"), F.min("o_orderkey").alias(name)).filter("n = 1").drop("n")

    return alone("O", "old_key").join(alone("F", "new_key"), ["o_custkey", "k"]).select("old_key", "new_key")


_BARE = "regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, {_BARE} AS bare FROM documents), g AS (SELECT bare, min(doc_id) AS first_id FROM t GROUP BY bare)
  SELECT t.doc_id, g.first_id, t.raw <> f.raw AS cosmetic FROM t JOIN g USING (bare) JOIN t f ON f.doc_id = g.first_id WHERE t.doc_id <> g.first_id""")
def cosmetic_pairs(spark, d):
    """Documents that equal the first of their group but for white space; ``cosmetic`` where the texts do differ."""
    raw = F.coalesce("text", F.lit(""))
    rows = read(spark, d, "documents").select("doc_id", F.md5(raw).alias("raw"), F.md5(F.regexp_replace(raw, "[ \\t\\r\\n]+", "")).alias("bare"))
    first = rows.groupBy("bare").agg(F.min_by(F.struct("doc_id", "raw"), "doc_id").alias("f"))
    return rows.join(first, "bare").filter("doc_id <> f.doc_id").select("doc_id", F.col("f.doc_id").alias("first_id"), (F.col("raw") != F.col("f.raw")).alias("cosmetic"))


@query("""WITH m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS middle FROM events), e AS (SELECT user_id, event_type, epoch_us(ts) > middle AS late FROM events, m)
  SELECT user_id, event_type, CASE WHEN bool_or(NOT late) AND bool_or(late) THEN 'kept' WHEN bool_or(late) THEN 'added' ELSE 'removed' END AS status FROM e GROUP BY ALL""")
def set_diff_modifiers(spark, d):
    """Members of two sets per key, here the types of a user's events in either half of the time: kept, added or removed."""
    e = read(spark, d, "events").select("user_id", "event_type", F.expr(MICROS).alias("t"))
    middle = e.agg(F.expr("(min(t) + max(t)) div 2")).scalar()
    late = F.col("t") > middle
    g = e.groupBy("user_id", "event_type").agg(F.bool_or(late).alias("new"), F.bool_or(~late).alias("old"))
    return g.select("user_id", "event_type", F.when(F.col("new") & F.col("old"), "kept").when(F.col("new"), "added").otherwise("removed").alias("status"))


@query("""WITH s AS (SELECT s_nationkey AS n, min(s_suppkey) AS s FROM supplier GROUP BY ALL), c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
  r AS (SELECT n_regionkey, min(s) AS s FROM s JOIN nation ON n = n_nationkey GROUP BY ALL)
  SELECT c_custkey, coalesce(s.s, r.s) AS s_suppkey, CASE WHEN s.s IS NOT NULL THEN 'nation' WHEN r.s IS NOT NULL THEN 'region' ELSE 'none' END AS pass FROM c LEFT JOIN s ON n = c_nationkey LEFT JOIN r USING (n_regionkey)""")
def residual_pass_match(spark, d):
    """A supplier for each customer: of the same nation, and for what that pass leaves, of the same region."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    near = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("near"))
    wide = near.join(nation, "n_nationkey").groupBy("n_regionkey").agg(F.min("near").alias("wide"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").join(near, "n_nationkey", "left").join(wide, "n_regionkey", "left")
    return c.select("c_custkey", F.coalesce("near", "wide").alias("s_suppkey"), F.when(F.col("near").isNotNull(), "nation").when(F.col("wide").isNotNull(), "region").otherwise("none").alias("pass"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), one AS (SELECT DISTINCT s FROM e JOIN part ON p = p_partkey WHERE p_size = 1)
  SELECT p AS part, CAST(count(*) AS BIGINT) AS ways FROM e JOIN one USING (s) GROUP BY p""")
def hop_neighbourhood(spark, d):
    """Parts two steps from the parts of size 1 in the graph of parts and suppliers, and by how many suppliers each is reached."""
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s")).distinct()
    seeds = read(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("part"))
    one = e.join(seeds, "part", "left_semi").select("s").distinct()
    return e.join(one, "s", "left_semi").groupBy("part").agg(F.count("*").alias("ways"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), b AS (SELECT DISTINCT p_brand AS brand, s FROM e JOIN part ON p = p_partkey)
  SELECT brand, p AS part, CAST(count(*) AS BIGINT) AS ways FROM e JOIN b USING (s) GROUP BY ALL""")
def hop_neighbourhood_by_brand(spark, d):
    """Parts two steps from each brand's parts over all links, and by how many suppliers each is reached.

    Suppliers that the same brands reach are of one kind, numbered by its least supplier. A part's suppliers are counted
    by kind, and only these counts meet brands: a link stays one row, however many brands its supplier has.
    """
    links = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s")).filter("s IS NOT NULL")
    brands = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.struct(F.col("p_brand").alias("brand")).alias("b"))
    of = materialise(links.join(brands, "part").select("s", "b").distinct().groupBy("s").agg(F.sort_array(F.collect_list("b")).alias("brands")))
    kinds = materialise(of.groupBy("brands").agg(F.min("s").alias("kind")))
    kind_of = materialise(of.join(kinds, "brands").select("s", "kind"))
    # All counts of a part lie in one partition, so that none of them is shuffled again where kinds are few.
    ways = links.join(kind_of, "s").repartition("part").distinct().groupBy("part", "kind").agg(F.count("*").alias("n"))
    return ways.join(kinds, "kind").select("part", "n", F.explode("brands").alias("b")).groupBy(F.col("b.brand").alias("brand"), "part").agg(F.sum("n").alias("ways"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS source, 'n' || c_nationkey AS target, 'customer' AS kind, 1 AS p FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 's' || l_suppkey, 'n' || s_nationkey, CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'supply' END, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 3 END FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
  SELECT source, target, arg_min(kind, p) AS kind, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY source, target""")
def impact_edges_dedup(spark, d):
    """Edges of several kinds, one for each pair of ends: the kind that comes first, and how many there were.

    Edges are counted before the join with their ends, so the fact tables shrink to keys first.
    """
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    o = o.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("customer").alias("kind"), "n")
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    s = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"), F.when(F.col("r"), "return").otherwise("supply").alias("kind"), "n")
    return o.unionByName(s)


@query("""SELECT l_partkey AS part, CAST(max(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END) AS INTEGER) AS level, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS sources
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def risk_inherit_max(spark, d):
    """The highest level among a target's sources, and how many sources it has."""
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).otherwise(1)
    links = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("o_orderkey")).distinct()
    return links.join(read(spark, d, "orders").select("o_orderkey", level.alias("level")), "o_orderkey").groupBy("part").agg(F.max("level").alias("level"), F.count("*").alias("sources"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN 'unknown' WHEN p_size <= 5 THEN 'small' WHEN p_retailprice >= 1500 THEN 'dear' WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_brand LIKE 'Brand#1%' THEN 'first' ELSE 'other' END AS layer FROM part""")
def layer_ladder(spark, d):
    """The first rule of a ladder that holds names the layer."""
    c = F.col
    layer = F.when(c("p_retailprice").isNull(), "unknown").when(c("p_size") <= 5, "small").when(c("p_retailprice") >= 1500, "dear").when(c("p_type").contains("STEEL"), "steel").when(c("p_brand").startswith("Brand#1"), "first")
    return read(spark, d, "part").select("p_partkey", layer.otherwise("other").alias("layer"))


@query("""WITH w AS (SELECT user_id, event_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type = 'purchase')
  SELECT e.event_id, arg_max(w.event_id, w.a) AS window_id FROM events e JOIN w ON e.user_id = w.user_id AND e.ts > w.a AND (e.ts < w.b OR w.b IS NULL) WHERE e.event_type <> 'purchase' GROUP BY e.event_id""")
def range_containment(spark, d):
    """The stretch, from one purchase to the next, that holds each other event: a running value, no range join."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(w)
    # Events at the very time of a purchase lie in no open stretch.
    return e.withColumn("o", opened).filter("event_type <> 'purchase' AND o.ts < ts").select("event_id", F.col("o.event_id").alias("window_id"))


@query("""SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS starts FROM conversations""")
def boundary_markers(spark, d):
    """Rows at which a value changes."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", (~before.eqNullSafe(F.col("role"))).alias("starts"))


@query("""SELECT tag, CAST(count(*) AS BIGINT) AS uses, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""")
def regex_annotations(spark, d):
    """Marks that a pattern finds in texts, counted by use and by text; first within each page, so the shuffle is small."""
    tags = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("tag", "page_id").agg(F.count("*").alias("n")).groupBy("tag").agg(F.sum("n").alias("uses"), F.count("*").alias("pages"))


@query("""SELECT conv_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'))) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[.!?]'))) AS BIGINT) AS stops FROM conversations GROUP BY conv_id""")
def text_tokenize_counts(spark, d):
    text = F.coalesce("text", F.lit(""))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))).alias("words"), F.sum(F.regexp_count(text, F.lit("[.!?]"))).alias("stops"))


@query("""WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages), x AS (SELECT page_id, s, unnest(range(1, len(s))) AS n FROM u),
  p AS (SELECT page_id, n, array_to_string(s[1:n], '/') AS prefix FROM x), f AS (SELECT prefix, count(DISTINCT page_id) AS pages FROM p GROUP BY prefix HAVING count(DISTINCT page_id) >= 2)
  SELECT page_id, arg_max(prefix, n) AS ancestor FROM p JOIN f USING (prefix) GROUP BY page_id""")
def nearest_ancestor(spark, d):
    """The longest proper prefix of a page's path that it shares with another page: an equality join on all prefixes."""
    s = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    p = read(spark, d, "pages").select("page_id", s.alias("s")).filter(F.size("s") > 1).select("page_id", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("n"))
    p = p.select("page_id", "n", F.array_join(F.slice("s", 1, F.col("n")), "/").alias("prefix"))
    shared = p.groupBy("prefix", "page_id").agg(F.lit(1).alias("one")).groupBy("prefix").agg(F.count("*").alias("k")).filter("k >= 2").select("prefix")
    return p.join(shared, "prefix").groupBy("page_id").agg(F.max_by("prefix", "n").alias("ancestor"))


@query("""WITH c AS (SELECT o_custkey AS id, 1 AS p, o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 3, o_orderkey FROM orders)
  SELECT id, k AS o_orderkey, CAST(p AS INTEGER) AS source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, k) AS r FROM c) WHERE r = 1""")
def priority_coalesce(spark, d):
    """The first candidate of the first source that has any; sources rank by a column of one scan, not by a union of three."""
    source = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", source.alias("source"))
    return keep_best(rows, ["id"], [F.col("source"), F.col("o_orderkey")])


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <= 5)
  SELECT o_custkey, o_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'likely' ELSE 'name-only' END AS confidence FROM orders JOIN g ON o_orderkey = l_orderkey JOIN lineitem USING (l_orderkey)""")
def name_only_cap(spark, d):
    """Links by a shared name alone, here an order's number, for names with five bearers at most; bearers are counted before they are joined."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    bearers = lines.groupBy("o_orderkey").agg(F.count("*").alias("n")).filter("n <= 5")
    linked = lines.join(bearers, "o_orderkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return linked.select("o_custkey", "o_orderkey", "l_linenumber", F.when(F.col("n") == 1, "likely").otherwise("name-only").alias("confidence"))


@query("""WITH l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), k AS (SELECT l_suppkey, count(*) AS parts FROM l GROUP BY ALL)
  SELECT l_partkey, CAST(count(*) AS BIGINT) AS suppliers, arg_min(l_suppkey, (parts, l_suppkey)) AS narrowest FROM l JOIN k USING (l_suppkey) GROUP BY l_partkey""")
def nearest_depth_pick(spark, d):
    """Of a row's candidates the one of the least level, ties to the least id."""
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    k = l.groupBy("l_suppkey").agg(F.count("*").alias("parts"))
    return l.join(k, "l_suppkey").groupBy("l_partkey").agg(F.count("*").alias("suppliers"), F.min(F.struct("parts", "l_suppkey"))["l_suppkey"].alias("narrowest"))


_VERB, _CLAUSE = "select|insert|update|delete", "from|into|set|where"


@query(f"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?is)\\b({_VERB})\\b.*\\b({_CLAUSE})\\b') AS is_sql FROM documents""")
def sql_literal_detect(spark, d):
    """Texts with a verb of SQL and, anywhere after it, a clause: two searches, the second in what follows the first verb."""
    word = lambda some: rf"(?i)(?<![A-Za-z0-9_])({some})(?![A-Za-z0-9_])"
    after = F.get(F.split(F.coalesce("text", F.lit("")), word(_VERB), 2), F.lit(1))
    return read(spark, d, "documents").select("doc_id", F.coalesce(after.rlike(word(_CLAUSE)), F.lit(False)).alias("is_sql"))
