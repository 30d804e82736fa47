"""A range search over graphs, against brute force where queries have more hits than the walk returns."""

from vexel.operators import search
from vexel.plans import catalog, inputs
from vexel.plans.catalog_graph import RADIUS, WIDTH

SF = "/root/testdata/sf0.1"


def test_all_hits_in_range(spark):
    base = inputs.vectors(spark, SF).select("id", "vec")
    want = {(r["query_id"], r["id"]) for r in search.range_search(base, inputs.queries(base), RADIUS).collect()}
    rows = catalog.QUERIES["range_graph"](spark, SF).collect()
    got = {(r["query_id"], r["id"]) for r in rows}
    counts = {}
    for q, _ in want:
        counts[q] = counts.get(q, 0) + 1
    print("true", len(want), "found", len(got), "of them true", len(got & want), "queries beyond", sum(n > WIDTH for n in counts.values()))
    assert max(counts.values()) > WIDTH
    assert len(rows) == len(got) and got == want
    for q, n in counts.items():
        assert sorted(r["rank"] for r in rows if r["query_id"] == q) == list(range(1, n + 1))
