from itertools import islice, product

import pytest
from pyspark.sql import functions as F

from gridlake.functions.geometry import MAX64, MIN64, Geometry
from gridlake.operators import area as areas


@pytest.mark.parametrize("side", [1, 3, 16, 1024])
def test_floor_division_on_all_of_int64(spark, side):
    values = [0, 1, -1, side - 1, side, -side, -side - 1, MIN64, MIN64 + 1, MAX64, 31, -17]
    g = Geometry((side, side))
    rows = spark.createDataFrame([(v, v) for v in values], "x long, y long")
    for r in g.addressed(rows, large=True).withColumn("i", g.local_index()).collect():
        assert r.cx == r.x // side and r.lx == r.cx // 8
        assert r.i == r.x % side + side * (r.y % side)


def test_absolute_is_null_beyond_int64(spark):
    g = Geometry((4, 4))
    rows = spark.createDataFrame([(MAX64 // 4, 3), (MAX64, 0), (-2, 1)], "c long, l long")
    assert [r.a for r in rows.select(g.absolute("c", "l", 0).alias("a")).collect()] == [MAX64 // 4 * 4 + 3, None, -7]


@pytest.mark.parametrize("sides", [(0, 1), (4097, 1), (1,), (1025, 1025), (2, 2, 2, 2)])
def test_geometry_limits(sides):
    with pytest.raises(ValueError):
        Geometry(sides)


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("radius", range(7))
@pytest.mark.parametrize("middle", [0, MAX64, MIN64])
def test_ball_cells_against_brute_force(dims, radius, middle):
    ball = areas.Ball((middle,) * dims, radius)
    around = [v for v in range(middle - radius, middle + radius + 1) if MIN64 <= v <= MAX64]
    expected = [p for p in product(around, repeat=dims) if sum((v - middle) ** 2 for v in p) <= radius**2]
    assert list(areas.cells(ball)) == expected
    whole = sum(1 for p in product(range(-radius, radius + 1), repeat=dims) if sum(v * v for v in p) <= radius**2)
    assert not ball.exceeds(whole) and ball.exceeds(whole - 1)
    for after in expected[:: max(1, len(expected) // 5)]:
        assert list(areas.cells(ball, after)) == [p for p in expected if p > after]


def test_pages_join_up_to_the_area():
    for area in (areas.Box((-2, 1), (3, 4)), areas.Ball((1, -1), 3), areas.Ball((0, 0, 0), 2)):
        everything, after, seen = list(areas.cells(area)), None, []
        while True:
            found = list(islice(areas.cells(area, after), 5))
            if not found:
                break
            seen += found
            after = found[-1]
        assert seen == everything


@pytest.mark.parametrize("center,radius,points", [
    ((0, 0), 2, [(0, 0), (2, 0), (1, 1), (2, 1), (-2, 0), (MAX64, MIN64)]),
    ((0, 0), MAX64, [(MAX64, 0), (MAX64, 1), (MIN64, 0), (0, MAX64), (3, 4)]),
    ((MAX64, MIN64), 2**62, [(MAX64, MIN64), (MAX64 - 2**62, MIN64), (MAX64 - 2**62, MIN64 + 1), (0, 0)]),
])
def test_ball_predicate_is_exact(spark, center, radius, points):
    ball = areas.Ball(center, radius)
    rows = spark.createDataFrame(points, "cx long, cy long").withColumn("inside", ball.inside(["cx", "cy"]))
    for r in rows.collect():
        assert bool(r.inside) == ball.contains((r.cx, r.cy)), r


def test_area_refusals(spark):
    g = Geometry((4, 4))
    chunks = spark.createDataFrame([(0, 0)], "cx long, cy long")
    with pytest.raises(areas.AreaError):
        areas.Box((1, 0), (0, 0))
    with pytest.raises(areas.AreaError):
        areas.Ball((0, 0), -1)
    with pytest.raises(areas.AreaError, match="INVALID_ARGUMENT"):
        areas.admit(areas.Box((0, 0), (64, 63)))
    areas.admit(areas.Box((0, 0), (63, 63)))
    with pytest.raises(areas.AreaError):
        areas.page(chunks, areas.Ball((0, 0), 2), g, limit=1, after=(2, 2))
    with pytest.raises(areas.AreaError):
        areas.page(chunks, areas.Ball((0, 0), 2), g, limit=0)
    with pytest.raises(areas.AreaError):
        areas.select(chunks, areas.Box((0, 0, 0), (1, 1, 1)), g)


def test_page_counts_empty_cells(spark):
    g = Geometry((4, 4))
    chunks = spark.createDataFrame([(0, 0), (2, 2)], "cx long, cy long")
    box = areas.Box((0, 0), (2, 2))
    first = areas.page(chunks, box, g, limit=4)
    assert [tuple(r) for r in first.chunks.collect()] == [(0, 0)] and first.more and first.after == (1, 0)
    rest = areas.page(chunks, box, g, limit=5, after=first.after)
    assert [tuple(r) for r in rest.chunks.collect()] == [(2, 2)] and not rest.more and rest.after is None


def test_budget_refuses_a_first_chunk_that_is_too_large(spark):
    g = Geometry((4, 4))
    chunks = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (1, 0, 50)], "cx long, cy long, n long")
    kept = areas.budgeted(chunks, g, F.col("n"), 12).select("cx", "cy").collect()
    assert sorted(map(tuple, kept)) == [(0, 0), (0, 1)]
    with pytest.raises(Exception, match="area_entry_too_large"):
        areas.budgeted(chunks, g, F.col("n"), 4).collect()


def test_area_filter_reaches_the_scan(spark, tmp_path):
    g = Geometry((4, 4))
    rows = g.sharded(spark.createDataFrame([(x, y) for x in range(40) for y in range(4)], "cx long, cy long"))
    rows.write.partitionBy("lx", "ly").parquet(str(tmp_path / "t"))
    plan = areas.select(spark.read.parquet(str(tmp_path / "t")), areas.Box((0, 0), (3, 3)), g)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "lx" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(cx,0)" in plan
