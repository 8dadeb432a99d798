"""assign() asks for its edges once, and leaves no table of its rounds behind."""

from skyloom.operators import components as G
from skyloom.plans import lineage


def test_edges_are_made_once(spark):
    made, kept = spark.sparkContext.accumulator(0), set(lineage._kept)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = [(i, i, 1.0) for i in range(100)] + [(1000 + i // 2, 1000 + (i + 1) // 2, 2.0 + i % 3) for i in range(41)]
    df = spark.createDataFrame(edges, "l long, r long, cost double")
    got = {(x.l, x.r) for x in G.assign(df.mapInArrow(counted, df.schema)).collect()}
    assert {(i, i) for i in range(100)} <= got and len(got) == 121
    assert made.value == len(edges)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(lineage._kept) - kept}
    assert left == {"assign-edges", "assign-sizes"}
