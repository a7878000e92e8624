from corvane.operators.graph import connected_components


def test_components_of_chain_star_and_cycle(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
