from collections import Counter

from corvane.plans.matching_queries import hop_neighbourhood_by_brand


def test_hops_take_all_edges_and_every_brand(spark, tmp_path):
    links = [(1, 1), (1, 1), (4, 1), (4, 2), (5, 2), (6, 2), (6, 3), (7, 3), (8, 9)]
    brand = {1: "a", 4: "b", 5: "a", 6: "b", 7: "c", 8: "d"}
    spark.createDataFrame([(p, s, float(p)) for p, s in links], "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(brand.items()), "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    seeds = {(brand[p], s) for p, s in links}
    want = Counter((b, p) for p, s in set(links) for b, t in seeds if s == t)
    assert {(r.brand, r.part): r.ways for r in hop_neighbourhood_by_brand(spark, str(tmp_path)).collect()} == want


def most_rows(node):
    """The most rows that a step of a plan that ran has put out."""
    name = node.getClass().getSimpleName()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_links_are_not_multiplied_by_brands(spark, tmp_path):
    """200 parts of 50 brands, each with the same 20 suppliers: 10,000 rows come out and no step has more, not 200,000."""
    spark.range(4000).selectExpr("id div 20 AS l_partkey", "id % 20 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200).selectExpr("id AS p_partkey", "concat('b', id % 50) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    out = hop_neighbourhood_by_brand(spark, str(tmp_path))
    rows = out.collect()
    assert len(rows) == 10_000 and {r.ways for r in rows} == {20}
    assert most_rows(out._jdf.queryExecution().executedPlan()) <= 10_000


def test_hops_of_null_and_repeated_keys(spark, tmp_path):
    """A part without a key or a brand still counts, a link without a supplier leads nowhere, a part may have two brands."""
    links = [(1, 1), (None, 1), (2, 1), (2, None), (3, 2), (2, 2), (2, 2), (9, 3), (None, 3), (3, 4)]
    brand = [(1, "a"), (1, "b"), (2, None), (3, "a"), (None, "n"), (4, "z")]
    spark.createDataFrame(links, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(brand, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    edges = {(p, s) for p, s in links if s is not None}
    seeds = {(b, s) for p, s in edges for q, b in brand if p is not None and p == q}
    want = Counter((b, p) for p, s in edges for b, t in seeds if s == t)
    got = hop_neighbourhood_by_brand(spark, str(tmp_path)).collect()
    assert {(r.brand, r.part): r.ways for r in got} == want and len(got) == len(want)
