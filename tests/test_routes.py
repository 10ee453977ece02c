"""Routes onto a square by definition, and when they multiply rows."""

from boardlake.operators.joins import arrow_routes
from boardlake.plans import QUERIES


def test_routes_by_definition(spark):
    want = set()
    for e in range(64):
        for s in range(64):
            dx, dy = abs(s % 8 - e % 8), abs(s // 8 - e // 8)
            if (dx, dy) != (0, 0) and (0 in (dx, dy) or dx == dy or dx * dy == 2):
                kind = "horizontal" if not dy else "vertical" if not dx else "diagonal" if dx == dy else "knight"
                want.add((e, s, kind))
    ends = spark.range(64).union(spark.createDataFrame([(None,)], "id long"))
    got = [(r.id, r.start, r.geometry) for r in arrow_routes(ends, "id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_cells_are_counted_before_their_routes(spark, sf):
    plan = QUERIES["j8_all_routes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate inline", 1)
    assert "HashAggregate" in below and "Generate explode" in below
