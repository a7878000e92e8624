import random

from corvane.plans.queries import components_of_all_links


def test_components_of_all_links_by_union_find(spark, tmp_path):
    rng = random.Random(3)
    links = [(rng.randrange(1, 80), rng.randrange(1, 60)) for _ in range(70)]
    rows = [(p, s, float(rng.randrange(1, 51)), rng.randrange(11) / 100) for p, s in links + links[:9]]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {v: v for p, s in links for v in (2 * p, 2 * s + 1)}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for p, s in links:
        x, y = sorted((find(2 * p), find(2 * s + 1)))
        root[y] = x
    got = [tuple(r) for r in components_of_all_links(spark, str(tmp_path)).select("id", "component").collect()]
    assert sorted(got) == sorted((v, find(v)) for v in root)
