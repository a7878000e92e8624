from corvane.plans.matching_queries import contamination_item_share


def test_passages_inside_longer_documents(spark, tmp_path):
    item, other = " ".join(f"q{k}" for k in range(30)), " ".join(f"r{k}" for k in range(30))
    filler = " ".join(f"f{k}" for k in range(5000))
    docs = [(1, f"{filler} {item} {filler}"), (2, filler), (3, f"{filler} {item[: item.index(' q14')]}"), (4, None), (5, other), (5, f"{other} {filler}"), (None, item)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, item), (11, other), (12, ""), (13, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, contamination_item_share(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, 10, 1.0), (5, 11, 1.0), (5, 11, 1.0), (None, 10, 1.0)], key=repr)
