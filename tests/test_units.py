"""Golden values and properties of the raster operators."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granulite.functions import geometry_text
from granulite.operators import aggregates, decode, geoloc, geometry, gridjoin, prune
from granulite.operators.joins import box_join, range_join
from granulite.sources import catalog as cat
from granulite.sources.drivers import chunks
from granulite.sources.scan import Geo, explained, pixel_scan
from granulite.spec import Column, Geolocation, Role, Table, column_of

def bilinear(source, lines, samples, k, offset, extra):
    """Interpolation point by point: along each axis a line through the nearest two values."""
    def along(values, at):
        i = min(max(math.floor(at), 0), len(values) - 2)
        return values[i] + (values[i + 1] - values[i]) * (at - i)

    rows = [source[i * samples : (i + 1) * samples] for i in range(lines)]
    axis = lambda n: [(r + offset) / k - 0.5 for r in range(n * k + extra)]
    return [along([along(row, c) for row in rows], r) for r in axis(lines) for c in axis(samples)]


def grid(spark, source, lines, samples, k, offset, extra):
    rows, cols = lines * k + extra, samples * k + extra
    df = spark.createDataFrame([(source,)], "s array<double>").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    v = geoloc.interpolate(F.col("s"), lines, samples, F.floor(F.col("i") / cols), F.col("i") % cols, k, offset)
    return [r.v for r in df.select("i", v.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("k, offset, extra", [(1, 0.0, 1), (2, 0.0, 1), (4, 0.0, 1), (2, 0.5, 0), (4, 0.5, 0), (3, 0.5, 0)])
def test_interpolation_against_points(spark, k, offset, extra):
    r = random.Random(k)
    source = [r.uniform(-50, 50) for _ in range(4 * 5)]
    assert grid(spark, source, 4, 5, k, offset, extra) == pytest.approx(bilinear(source, 4, 5, k, offset, extra))


@pytest.mark.parametrize("k", [1, 3, 4])
def test_interpolation_is_exact_on_planes(spark, k):
    plane = [3.0 * i - 2.0 * j + 1 for i in range(4) for j in range(5)]
    got = grid(spark, plane, 4, 5, k, geoloc.CENTRE, 0)
    want = [3.0 * ((r + 0.5) / k - 0.5) - 2.0 * ((c + 0.5) / k - 0.5) + 1 for r in range(4 * k) for c in range(5 * k)]
    assert got == pytest.approx(want)


def test_interpolation_needs_two_lines():
    with pytest.raises(ValueError):
        geoloc.interpolate(F.lit(0), 1, 5, F.lit(0), F.lit(0), 2, 0.0)


def rings(spark, polygons):
    df = spark.createDataFrame([(i, p and [*p, p[0]]) for i, p in enumerate(polygons)], "id int, r array<struct<x: double, y: double>>")
    return df


BOX2 = [(0.25, 0.25), (1.25, 0.25), (1.25, 0.75), (0.25, 0.75)]


def cells(df):
    return sorted((r.i, r.j, round(r.ratio, 9)) for r in df.collect())


@pytest.mark.parametrize(
    "polygon, grid_, want",
    [
        ([(0.1, 0.1), (0.4, 0.1), (0.4, 0.4), (0.1, 0.4)], (0.5, 0.5), [(0, 0, 0.36)]),
        (BOX2, (0.5, 0.5), [(0, 0, 0.25), (0, 1, 0.25), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.25), (2, 1, 0.25)]),
        ([(0, 0), (2, 0), (0, 2)], (1.0, 1.0), [(0, 0, 1), (0, 1, 0.5), (1, 0, 0.5)]),
        ([(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)], (0.5, 0.5), [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5)]),
        (BOX2, (0.5, -0.5), [(0, -2, 0.25), (0, -1, 0.25), (1, -2, 0.5), (1, -1, 0.5), (2, -2, 0.25), (2, -1, 0.25)]),
        (None, (1.0, 1.0), []),
    ],
)
def test_grid_join_golden(spark, polygon, grid_, want):
    p = polygon and [tuple(map(float, x)) for x in polygon]
    assert cells(gridjoin.grid_join(rings(spark, [p]), "r", *grid_, keep=[])) == want


def test_grid_join_area_golden(spark):
    p = [(-0.5, 0.5), (0.75, 0.5), (0.75, 1.0), (-0.5, 1.0)]
    assert cells(gridjoin.grid_join_area(rings(spark, [p]), "r", 4, 4, 0, 0, 2, 2, keep=[])) == [(0, 1, 1), (1, 1, 0.5)]
    p = [(0.0, 0.5), (0.75, 0.5), (0.75, 1.0), (0.0, 1.0)]
    assert cells(gridjoin.grid_join_area(rings(spark, [p]), "r", 4, 4, 0, 2, 2, 0, keep=[])) == [(0, 2, 1), (1, 2, 0.5)]
    far = [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0)]
    assert cells(gridjoin.grid_join_area(rings(spark, [far, []]), "r", 4, 4, 0, 0, 2, 2, keep=[])) == []


def test_grid_join_keeps_area(spark):
    """Rings that aren't convex: the parts of cells add up to the ring's area."""
    r = random.Random(5)
    shapes = []
    for _ in range(12):
        n = r.randint(3, 9)
        c = (r.uniform(-3, 3), r.uniform(-3, 3))
        shapes.append([(c[0] + (d := r.uniform(0.3, 3)) * math.cos(2 * math.pi * i / n), c[1] + d * math.sin(2 * math.pi * i / n)) for i in range(n)])
    area = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(s, s[1:] + s[:1]))) / 2 for s in shapes]
    out = gridjoin.grid_join(rings(spark, shapes), "r", 0.7, 0.4, 0.1, -0.2, keep=["id"]).groupBy("id").agg(F.sum("ratio").alias("a"))
    got = {x.id: x.a * 0.7 * 0.4 for x in out.collect()}
    assert [got[i] for i in range(len(shapes))] == pytest.approx(area)


def test_grid_join_deals_nothing(spark):
    """Rings are cut where they are read: no exchange, whose tasks would grow with the table, and equal rows stay apart."""
    df = rings(spark, [BOX2, BOX2]).select(F.lit(7).alias("id"), "r")
    out = gridjoin.grid_join(df, "r", 0.5, 0.5, keep=["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert cells(out) == sorted(2 * [(0, 0, 0.25), (0, 1, 0.25), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.25), (2, 1, 0.25)])


@pytest.mark.parametrize("width, height", [(None, None), (9, 11)])
def test_grid_join_in_parts(monkeypatch, width, height):
    """However few pieces and cells are held at once, and with long rows, the cells are the same."""
    r = random.Random(8)
    star = lambda n, size: [(size * d * math.cos(2 * math.pi * i / n), size * d * math.sin(2 * math.pi * i / n)) for i in range(n) for d in (r.uniform(0.3, 1),)]
    comb = [(x + 0.1, y) for x in range(-30, 30) for y in (0.2, 0.8)] + [(30.0, 0.1), (-30.0, 0.1)]
    shapes = [star(5, 3), star(200, 20), [], star(9, 0.2), comb, None, [(-1e3, -2.0), (1e3, -2.0), (1e3, 3.0)], star(4, 8)]
    values = pa.array([s and [dict(x=x, y=y) for x, y in [*s, s[0]]] for s in shapes], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def found(most):
        parts = list(gridjoin._cut(values, most, (-4.0, -5.0, 0.7, 0.9), width, height))
        assert all(len(p[0]) <= most for p in parts)
        return sorted((*map(int, c[:3]), round(float(c[3]), 9)) for p in parts for c in zip(*p))

    whole = found(1 << 20)
    assert {c[0] for c in whole} == {0, 1, 3, 4, 6, 7}
    monkeypatch.setattr(gridjoin, "PIECES", 5)
    assert found(7) == whole


def test_pruning_is_sound(spark):
    """No file condition drops a file that holds a match, for boxes in boxes at random."""
    r = random.Random(3)
    rows = []
    for _ in range(4000):
        x, y, X, Y = r.randint(0, 8), r.randint(0, 8), r.randint(0, 4), r.randint(0, 4)
        px, py = x + r.randint(0, X), y + r.randint(0, Y)
        ax, ay = r.randint(-2, 10), r.randint(-2, 10)
        rows.append(tuple(map(float, (x, y, x + X, y + Y, px, py, px + r.randint(0, x + X - px), py + r.randint(0, y + Y - py), ax, ay, ax + r.randint(0, 4), ay + r.randint(0, 4)))))
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(12)))
    f, p, a = (geometry.box(*(F.col(f"c{i + j}") for j in range(4))) for i in (0, 4, 8))
    wrong = [F.count(F.when(geometry.apply(op, p, a, neg) & ~prune.file_condition(op, neg, f, a), 1)).alias(f"{op}_{neg}") for op in geometry.OPERATORS for neg in (False, True)]
    swapped = [F.count(F.when(geometry.apply(op, p, a) != geometry.apply(geometry.SWAPPED[op], a, p), 1)).alias(f"swap_{op}") for op in geometry.OPERATORS]
    assert set(df.agg(*wrong, *swapped).first().asDict().values()) == {0}


def test_box_of_corners(spark):
    """From the coordinates as from the ring; none where a corner is unknown or out of range."""
    r = random.Random(6)
    rows = [tuple(r.choice((r.uniform(-90, 90), r.uniform(-90, 90), 90.0, -90.0)) for _ in range(8)) for _ in range(50)]
    rows += [(*row[:k], bad, *row[k + 1 :]) for row in rows[:8] for k, bad in ((0, None), (3, 91.0), (6, 361.0), (7, float("nan")))]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(8)))
    corners = [(F.col(f"c{i}"), F.col(f"c{i + 1}")) for i in range(0, 8, 2)]
    got = df.select(geometry.corners_box(*corners), geometry.ring_box(geometry.ring(*corners))).collect()
    assert [a for a, _ in got] == [b for _, b in got] and [a is None for a, _ in got] == 50 * [False] + 32 * [True]


def test_containment_of_odd_rings(spark):
    """Against the even-odd rule edge by edge; rings that are null, empty or a point contain nothing."""
    r = random.Random(2)
    some = [[(float(r.randint(-4, 4)), float(r.randint(-4, 4))) for _ in range(r.randint(3, 8))] for _ in range(60)]
    shapes = [s + s[:1] for s in some] + [[], [(0.5, 0.5)], None]
    points = [(r.uniform(-4, 4), r.uniform(-4, 4)) for _ in shapes]

    def inside(x, y, s):
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(s, s[1:])) % 2 == 1

    df = spark.createDataFrame(list(zip(range(len(shapes)), points, shapes)), "i int, p struct<x: double, y: double>, r array<struct<x: double, y: double>>")
    want = [i for i, ((x, y), s) in enumerate(zip(points, shapes)) if inside(x, y, s or [])]
    for held in (geometry.in_polygon(F.col("p"), F.col("r")), geometry.st_contains(F.col("r"), F.col("p"))):
        assert sorted(x.i for x in df.where(held).collect()) == want
    assert 5 < len(want) < 50


def test_containment_computes_a_ring_once(spark):
    """A ring that is itself an expression isn't computed anew for each edge and each of its ends."""
    ring = geometry.ring((F.col("id"), F.lit(0.0)), (F.col("id") + 2, F.lit(0.0)), (F.col("id"), F.lit(3.0)))
    e = geometry.in_polygon(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")), ring)
    plan = spark.range(9).where(e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(CASE") == 1


def test_decoding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 20, float("nan"))], "a array<int>, v int, x double")
    r = df.select(
        decode.scaled(F.col("v"), 0.5, 4).alias("scaled"), decode.scaled(F.col("v"), 4, 1, inverse=True).alias("inverse"), decode.filled(F.col("v"), 20).alias("filled"), decode.filled(F.col("x"), float("nan")).alias("nan"),
        decode.in_range(F.col("v"), 0, 10).alias("ranged"), decode.replicated(F.lit(19), 8, 2, 2).alias("coarse"), decode.bits_postfix(F.col("a"), F.lit(1), 2).alias("postfix"), decode.bits_prefix(F.col("a"), F.lit(0), 2, 2).alias("prefix"),
        decode.wrapped_short(F.lit(40000)).alias("short"), decode.dataset_name('H:"%f":X%%', F.lit("a.hdf")).alias("name"), geoloc.shifted_longitude(F.lit(-10.0)).alias("lon"), geometry.point(F.lit(400.0), F.lit(0.0)).alias("far"),
    ).first()
    assert tuple(r) == (8.0, 6.0, None, None, None, 5, 3 * 256 + 4, 1 * 256 + 3, 40000 - 65536, 'H:"a.hdf":X%', 350.0, None)
    with pytest.raises(ValueError):
        decode.dataset_name("%x", F.lit(""))
    assert decode.prefix_offset((1, 2), (3, 4), 10) == 60


def test_short_last_block(spark):
    t = Table("t", (Column("v"),), lines=2, samples=2)
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([],)], "v array<int>")
    assert [(r.chunk_start, r.v) for r in chunks(df, t, ["v"]).collect()] == [(0, [1, 2, 3, 4]), (4, [5, 6])]


def scanned(spark, table, columns, rows, schema, **options):
    files_ = spark.createDataFrame(rows, schema)
    catalog_ = spark.createDataFrame([(r[0], None if r[0] == 9 else "p") for r in rows], "file_id int, path string")
    return [tuple(r) for r in pixel_scan(catalog_, files_, table, columns, **options).collect()]


def test_layers_of_mixed_shapes(spark):
    """Full, coarse, bit and N-d layers of a file of 6 lines in blocks of 4, the last one short; layers that are missing or don't fit."""
    t = Table("t", (
        Column("file_id", Role.CATALOG), Column("index", Role.INDEX), Column("v", type="int4"), Column("coarse", type="int4", hfactor=2, vfactor=2), Column("b", type="bit", bits=16), Column("p", type="bit", bits=12, bitmap_prefix=True),
        Column("nd", type="int4", prefix=(1, 0), dims=(2, 2)), Column("wide", type="bit", bits=64), Column("a", type="int4", dataset="v", product="path"), Column("s", dataset="v", scale_name="scales"),
    ), lines=4, samples=4)
    v = list(range(24))
    full = (1, v, list(range(100, 106)), [x for i in v for x in (i, 255)], [*v, *(x + 100 for x in v)], [x for k in range(4) for x in (1000 * k + i for i in v)], [1 + k for i in v for k in range(8)], [3.0])
    poor = (9, v, None, [1, 2], v, v, [], None)
    none = (2, None, [1], [1], [1], [1], [1], [1.0])
    schema = "file_id int, v array<int>, coarse array<int>, b array<int>, p array<int>, nd array<int>, wide array<int>, scales array<double>"
    got = scanned(spark, t, ["file_id", "index", "v", "coarse", "b", "p", "nd", "wide", "a", "s"], [full, poor, none], schema)
    want = [(1, i, i, 100 + (i // 4 // 2) * 2 + i % 4 // 2, i * 256 + 255, i * 256 + i + 100, 2000 + i, bytes(range(1, 9)), i, 3.0 * i) for i in v]
    want += [(9, i, i, None, None, None, None, None, None, float(i)) for i in v]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(scanned(spark, t, ["index"], [full, none], schema)) == 24  # no layer is asked for: the size still counts
    assert {r[0] for r in scanned(spark, t, ["file_id", "a"], [full, poor], schema, present=("a",))} == {1}


@pytest.mark.parametrize("factor", [1, 2])
def test_geolocation_of_layers(spark, factor):
    """Points and footprints against interpolation block by block; a file without coordinates is left out."""
    t = Table("t", (Column("file_id", Role.CATALOG), Column("index", Role.INDEX), Column("point", Role.POINT), Column("footprint", Role.FOOTPRINT)), lines=4, samples=4, shift_longitude=True, geolocation=Geolocation(factor=factor, product="path"))
    r, n = random.Random(factor), (8 // factor) * (4 // factor)
    lat, lon = [r.uniform(10, 20) for _ in range(n)], [r.uniform(-30, -20) for _ in range(n)]
    rows = [(1, lat, lon), (2, lat, lon[1:]), (3, None, lon), (9, lat, lon)]
    got = scanned(spark, t, ["file_id", "index", "point", "footprint"], rows, "file_id int, lat array<double>, lon array<double>")
    assert sorted(x[:2] for x in got) == [(1, i) for i in range(32)]
    per = (4 // factor) * (4 // factor)
    for _, i, point, ring in got:
        block = slice(i // 16 * per, (i // 16 + 1) * per)
        shape = (4 // factor, 4 // factor, factor)
        if factor == 1:
            assert tuple(point) == pytest.approx((lon[i] + 360, lat[i]))
        else:
            assert tuple(point) == pytest.approx([bilinear(x[block], *shape, 0.5, 0)[i % 16] + d for x, d in ((lon, 360), (lat, 0))])
        y, x = i % 16 // 4, i % 4
        for p, (dy, dx) in zip(ring, ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))):
            assert tuple(p) == pytest.approx([bilinear(s[block], *shape, 0.0, 1)[(y + dy) * 5 + x + dx] + d for s, d in ((lon, 360), (lat, 0))])


def test_scan_is_explained(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], "p", 0.0)], "file_id int, v array<int>, path string, x double")
    t = Table("t", (Column("file_id", Role.CATALOG), Column("v", type="int4", product="path")), lines=2, samples=2)
    geo = (Geo("left", geometry.box(0, 0, 1, 1), Role.POINT, True),)
    said = explained(df.drop("v"), df.select("file_id", "v"), t, ["file_id"], where=F.col("x") < 1, geo=geo, present=("v",), point=(F.col("x"), F.col("x")))
    assert said["active columns"] == "file_id, v" and said["geometry predicates"] == "not point left" and "isnotnull(path" in said["catalog query"] and "Generate" in said["plan"]


def test_merged_catalog(spark):
    old = spark.createDataFrame([("s1", None, "a", "x"), ("s2", 1, "b", "y")], "start string, box int, mod03 string, note string")
    new = spark.createDataFrame([("s1", None, "mod03", "c"), ("s1", None, "mod09", "d"), ("s3", 2, "mod03", "e")], "start string, box int, product string, path string")
    got = cat.merged(old, new, ["start", "box"], ["mod03", "mod09"])
    assert got.columns == ["start", "box", "note", "mod03", "mod09"]
    assert sorted(map(tuple, got.collect())) == [("s1", None, "x", "c", "d"), ("s2", 1, "y", "b", None), ("s3", 2, None, "e", None)]


def test_polygons_with_holes_raise(spark):
    hole = "POLYGON((0 0,9 0,9 9,0 0),(1 1,2 1,2 2,1 1))"
    df = spark.createDataFrame([("POLYGON EMPTY",), (None,), ("POLYGON((0 0,1 0,1 1,0 0))",)], "w string")
    assert [r.r is None for r in df.select(geometry_text.ring_from_text(F.col("w"), strict=True).alias("r")).collect()] == [True, True, False]
    for bad in (hole, "POINT(1 2)"):
        with pytest.raises(Exception, match="one contour"):
            spark.createDataFrame([(bad,)], "w string").select(geometry_text.ring_from_text(F.col("w"), strict=True)).collect()


def test_range_join(spark):
    r = random.Random(4)
    ranges = [(i, (x := r.randint(-50, 50)), x + r.randint(-3, 30)) for i in range(40)]
    values = [(r.randint(-60, 90),) for _ in range(80)]
    got = range_join(spark.createDataFrame(ranges, "i int, lo long, hi long"), "lo", "hi", spark.createDataFrame(values, "v long"), "v", 7)
    assert sorted(map(tuple, got.select("i", "v").collect())) == sorted((i, v) for i, lo, hi in ranges for v, in values if lo <= v < hi)


def test_specs_are_checked():
    with pytest.raises(ValueError):
        column_of("x", scal="1")
    with pytest.raises(ValueError):
        Column("x", type="varbit")
    with pytest.raises(ValueError):
        Table("t", (Column("p", Role.POINT), Column("q", Role.POINT)))
    with pytest.raises(ValueError):
        Table("t", (Column("v", hfactor=3),))
    c = column_of("b", "float8", cat_name="mod03", dataset="D", prefix="1, 2", dims="3 4", factor="2", inverse_scale="true")
    assert column_of("r", scale="reflectance_scales").scale_name == "reflectance_scales"
    with pytest.raises(ValueError):
        chunks(None, Table("t", (Column("v"),), driver="tape"), ["v"])
    assert (c.product, c.layer, c.prefix, c.hfactor, c.vfactor, c.inverse_scale) == ("mod03", "D", (1, 2), 2, 2, True)


def test_dense_counts(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 7), (2, 5), (1, 8), (None, 5)], "i int, j int")
    assert aggregates.count_cube(df, {"i": (0, 2), "j": (5, 8)}).first().counts == [[2, 0, 0], [0, 0, 1]]
    assert aggregates.table_count_dense(df, {"i": (3, 3)}).count() == 0


def test_text(spark):
    df = spark.createDataFrame([("POLYGON((0 0, 1.5 0,1 1, 0 0))",), ("POINT(1 2)",), (None,)], "w string").select(geometry_text.ring_from_text(F.col("w")).alias("r"))
    got = [r.r and [tuple(p) for p in r.r] for r in df.collect()]
    assert got == [[(0, 0), (1.5, 0), (1, 1), (0, 0)], None, None]
    assert df.select(geometry_text.ring_as_text(F.col("r")).alias("t")).first().t == "POLYGON((0 0,1.5 0,1 1,0 0))"


def test_catalog_rules(spark):
    df = spark.createDataFrame([(-10.0, 5.0)], "w double, e double")
    assert tuple(df.select(cat.bbox_footprint(F.col("w"), F.col("e"), F.lit(0.0), F.lit(1.0)).alias("b")).first().b) == (0.0, 0.0, 360.0, 1.0)
    box = lambda w, e: tuple(df.select(cat.bbox_footprint(F.lit(w), F.lit(e), F.lit(0.0), F.lit(1.0)).alias("b")).first().b)[::2]
    assert box(-10.0, -5.0) == (350.0, 355.0) and box(5.0, 10.0) == (5.0, 10.0) and box(170.0, -170.0) == (170.0, 190.0)
    with pytest.raises(ValueError):
        cat.scan(df, [])


def test_box_join_finds_each_pair_once(spark):
    r = random.Random(9)
    def boxes(n):
        return [(i, (x := r.uniform(-5, 5)), (y := r.uniform(-5, 5)), x + r.uniform(0, 3), y + r.uniform(0, 3)) for i in range(n)]
    a, b = boxes(60), boxes(60)
    def frame(rows, key, name):
        return spark.createDataFrame(rows, f"{key} int, l double, b double, r double, t double").select(key, geometry.box(F.col("l"), F.col("b"), F.col("r"), F.col("t")).alias(name))
    got = sorted(map(tuple, box_join(frame(a, "i", "p"), "p", frame(b, "j", "q"), "q", 1.0).select("i", "j").collect()))
    assert got == sorted((i, j) for i, l, d, R, t in a for j, L, D, RR, T in b if l <= RR and R >= L and d <= T and t >= D)


def test_arrivals(spark, tmp_path):
    from granulite.streaming.arrivals import arriving, per_hour

    df = spark.createDataFrame([("/in/MOD03.A1.hdf", "2020-01-01 00:10:00"), ("/in/MYD03.A2.hdf", "2020-01-01 00:20:00"), ("/in/MOD03.A1.hdf", "2020-01-01 00:10:00"), ("/in/README", "2020-01-01 00:00:00")], "path string, starttime string")
    df = df.withColumn("starttime", F.to_timestamp("starttime"))
    df.write.parquet(str(tmp_path / "in"))
    q = per_hour(arriving(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.product, r.files) for r in spark.sql("SELECT * FROM arrived").collect()] == [("mod03", 2)]
