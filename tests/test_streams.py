"""Stream operators on small tables."""

from quarry.streaming import ingest


def test_reachable_follows_chains_to_their_end(spark):
    chain = [(i, i + 1) for i in range(24)]
    links = spark.createDataFrame([*chain, (24, 3), (2, 20), (2, 2), (50, 51)], "src long, dst long")
    found = ingest.reachable(links, spark.createDataFrame([(0,)], "node long"))
    # 20 is three steps from the seed by its short cut, 3 to 19 are on the chain
    want = {**{i: i for i in range(20)}, 20: 3, 21: 4, 22: 5, 23: 6, 24: 7}
    assert {r["node"]: r["depth"] for r in found.collect()} == want and found.count() == 25
    line = spark.createDataFrame(chain, "src long, dst long")
    assert {r["node"]: r["depth"] for r in ingest.reachable(line, spark.createDataFrame([(0,)], "node long")).collect()} == {i: i for i in range(25)}
