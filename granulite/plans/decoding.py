"""Columns of pixels: positions, places and decoded values, and geolocation (2.11, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geoloc, geometry
from .fixtures import CATALOG, FILES, PIXELS, RICH_1X, RICH_2X, catalog, corners, file_catalog, files, pixels, rich


def pixel_index(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "index", "line_id", "sample_id"])


def catalog_columns(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "label", "lon0", "index"], where=F.col("label") < 5)


def point_geometry(spark, sf_dir):
    """Points, with rows of latitude beyond 79.5 moved out of range."""
    from ..sources.scan import pixel_scan as scan
    from .fixtures import centre, TABLE

    x, y = centre()
    px = scan(file_catalog(spark, sf_dir), files(spark, sf_dir), TABLE, ["file_id", "index", "point"], point=(x, F.when(y > 60, y + 60).otherwise(y)))
    return px.select("file_id", "index", F.col("point.x").alias("x"), F.col("point.y").alias("y"))


def footprint_geometry(spark, sf_dir):
    px = pixels(spark, sf_dir, ["file_id", "index", "footprint"])
    return px.select("file_id", "index", F.posexplode("footprint").alias("corner", "p")).select("file_id", "index", "corner", "p.x", "p.y")


def simple_footprint(spark, sf_dir):
    """Footprints from four own corners for each pixel, their boxes."""
    px = pixels(spark, sf_dir, ["file_id", "lon0", "lat0", "line_id", "sample_id", "index"])
    px = px.withColumnsRenamed({"line_id": "line", "sample_id": "sample"})
    own = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners()))
    px = px.select("file_id", "index", own.alias("own"))
    r = geometry.ring(*((F.col("own")[i]["x"], F.col("own")[i]["y"]) for i in range(4)))
    return px.select("file_id", "index", geometry.ring_box(r).alias("b")).select("file_id", "index", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


def _column(name):
    def query(spark, sf_dir):
        return pixels(spark, sf_dir, ["file_id", "index", name]).withColumnRenamed(name, "value")

    return query


fill_value_null, valid_range, scale_offset, inverse_scale = (_column(c) for c in ("filled", "ranged", "scaled", "inverse"))


def const_layer(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "index", "first"])


def multires_layer(spark, sf_dir):
    """A layer of 4 x 4 values, each for 2 x 2 pixels, over two scan blocks."""
    return rich(spark, sf_dir, ["file_id", "index", "value"])


def bitmap_postfix(spark, sf_dir):
    """16 bits for each pixel, byte by byte."""
    return rich(spark, sf_dir, ["file_id", "index", "post"]).withColumnRenamed("post", "bits")


def bitmap_prefix(spark, sf_dir):
    """16 bits for each pixel, from two planes."""
    return rich(spark, sf_dir, ["file_id", "index", "planes"]).withColumnRenamed("planes", "bits")


def size_mismatch(spark, sf_dir):
    """A layer that hasn't the file's size is null, the file's other layers stay."""
    return rich(spark, sf_dir, ["file_id", "index", "raw", "misfit"])


def scan_geolocation_2x(spark, sf_dir):
    """Points between coordinates of 2 x 2 pixels, block by block."""
    px = rich(spark, sf_dir, ["file_id", "index", "point"], RICH_2X)
    return px.select("file_id", "index", F.round("point.x", 8).alias("x"), F.round("point.y", 8).alias("y"))


def scan_footprint_compact(spark, sf_dir):
    """Rings around pixels, from corners that neighbours of a block share."""
    px = rich(spark, sf_dir, ["file_id", "index", "footprint"], RICH_1X).select("file_id", "index", F.posexplode("footprint").alias("corner", "p"))
    return px.select("file_id", "index", "corner", F.round("p.x", 8).alias("x"), F.round("p.y", 8).alias("y"))


def shift_longitude(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", geoloc.shifted_longitude(F.col("xmin")).alias("lon"))


#: An affine grid: an origin, steps of 1/4 and a slant.
AFFINE = (-100.0, 0.25, 0.125, 50.0, -0.0625, -0.25)


def affine_geolocation(spark, sf_dir):
    px = pixels(spark, sf_dir, ["file_id", "index", "line_id", "sample_id"])
    x, y = geoloc.affine(AFFINE, F.col("line_id") + 0.5, F.col("sample_id") + 0.5, hfactor=2, vfactor=2)
    return px.select("file_id", "index", x.alias("x"), y.alias("y"))


def sinusoidal_inverse(spark, sf_dir):
    c = catalog(spark, sf_dir)
    lon, lat = geoloc.sinusoidal_inverse(F.col("xmin") * 40000, F.col("ymin") * 100000)
    return c.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def tile_geolocation_reuse(spark, sf_dir):
    """Places are computed once for each tile and joined to its granules."""
    c = catalog(spark, sf_dir).select("id", "tile")
    tiles = c.select("tile").distinct().withColumn("h", F.substring("tile", 2, 2).cast("int"))
    tiles = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index"), "h").select("tile", "index", (F.col("h") * 10.0 + F.col("index") * 2.5 - 180).alias("lon"))
    return c.join(tiles, "tile").select("id", "tile", "index", "lon")


def _interpolated(factor: int, offset: float, extra: int):
    """Outputs of a block of 8 x 8: (8 k + extra) squared of them."""
    n = 8 * factor + extra

    def query(spark, sf_dir):
        px = files(spark, sf_dir).withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
        row, col = F.floor(F.col("index") / n), F.col("index") % n
        return px.select("file_id", "index", (F.round(geoloc.interpolate(F.col("v"), 8, 8, row, col, factor, offset), 6) + 0.0).alias("value"))

    sql = f"""WITH {FILES}, o AS (SELECT r::INT AS r, least(greatest(floor((r + {offset}) / {float(factor)} - 0.5), 0), 6)::INT AS i, (r + {offset}) / {float(factor)} - 0.5 - least(greatest(floor((r + {offset}) / {float(factor)} - 0.5), 0), 6) AS a FROM (SELECT unnest(range({n})) AS r)),
d AS (SELECT file_id, y.r AS r, x.c AS c, (1 - y.a) * embedding[y.i * 8 + x.c + 1]::DOUBLE + y.a * embedding[(y.i + 1) * 8 + x.c + 1]::DOUBLE AS v FROM g, o y, (SELECT unnest(range(8)) AS c) x),
l AS (SELECT file_id, r, list(v ORDER BY c) AS v FROM d GROUP BY 1, 2)
SELECT file_id, l.r * {n} + o.r AS index, round((1 - a) * v[i + 1] + a * v[i + 2], 6) + 0.0::DOUBLE AS value FROM l, o"""
    return query, sql


INTERPOLATED = {
    "interp_footprint_1x": _interpolated(1, geoloc.CORNER, 1), "interp_footprint_2x": _interpolated(2, geoloc.CORNER, 1), "interp_footprint_4x": _interpolated(4, geoloc.CORNER, 1),
    "interp_points_2x": _interpolated(2, geoloc.CENTRE, 0), "interp_points_4x": _interpolated(4, geoloc.CENTRE, 0), "interp_generic_k": _interpolated(3, geoloc.CENTRE, 0),
}

QUERIES = {
    f.__name__: f
    for f in (pixel_index, catalog_columns, point_geometry, footprint_geometry, simple_footprint, const_layer, multires_layer, bitmap_postfix, bitmap_prefix, size_mismatch, scan_geolocation_2x, scan_footprint_compact, shift_longitude, affine_geolocation, sinusoidal_inverse, tile_geolocation_reuse)
} | {"fill_value_null": fill_value_null, "valid_range": valid_range, "scale_offset": scale_offset, "inverse_scale": inverse_scale} | {k: q for k, (q, _) in INTERPOLATED.items()}

_CORNER = "(VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) k(corner, dx, dy)"


#: Coordinates that are places.
_IN = "x BETWEEN -180 AND 360 AND y BETWEEN -90 AND 90"


def _byte(k: int) -> str:
    """A byte of a pixel's bit fields."""
    return f"(((raw * {k}) % 256 + 256) % 256)"


def _between(axis: str, samples: int, first: int | None, block: str) -> str:
    """A coordinate between the four around (f, g), of layers that begin at ``first`` of the values, or at the last and run back."""
    def value(dr: int, dc: int) -> str:
        at = f"{block} + (r + {dr}) * {samples} + c + {dc}"
        at = f"{first} + {at} + 1" if first is not None else f"64 - ({at})"
        v = f"({'lon0' if axis == 'x' else 'lat0'} + floor(embedding[{at}]::DOUBLE * 1000) / 1000)"
        return f"(CASE WHEN {v} < 0 THEN {v} + 360 ELSE {v} END)" if axis == "x" else v

    return f"round((1 - (f - r)) * ((1 - (g - c)) * {value(0, 0)} + (g - c) * {value(0, 1)}) + (f - r) * ((1 - (g - c)) * {value(1, 0)} + (g - c) * {value(1, 1)}), 8) AS {axis}"


ORACLES = {
    "pixel_index": f"WITH {PIXELS} SELECT file_id, idx AS index, line_id, sample_id FROM px",
    "catalog_columns": f"WITH {PIXELS} SELECT file_id, label, lon0, idx AS index FROM px WHERE label < 5",
    "point_geometry": f"WITH {PIXELS}, q AS (SELECT *, CASE WHEN lat > 60 THEN lat + 60 ELSE lat END AS y FROM px) SELECT file_id, idx AS index, CASE WHEN y BETWEEN -90 AND 90 THEN lon END AS x, CASE WHEN y BETWEEN -90 AND 90 THEN y END AS y FROM q",
    "footprint_geometry": f"WITH {PIXELS} SELECT file_id, idx AS index, corner, lon - 0.0625 + dx * 0.125 AS x, lat + 0.0625 - dy * 0.125 AS y FROM px, {_CORNER}",
    "simple_footprint": f"WITH {PIXELS} SELECT file_id, idx AS index, lon - 0.0625 AS xmin, lat - 0.0625 AS ymin, lon + 0.0625 AS xmax, lat + 0.0625 AS ymax FROM px",
    "fill_value_null": f"WITH {PIXELS} SELECT file_id, idx AS index, nullif(raw, 100) AS value FROM px",
    "valid_range": f"WITH {PIXELS} SELECT file_id, idx AS index, CASE WHEN raw >= -150 AND raw <= 150 THEN raw::DOUBLE END AS value FROM px",
    "scale_offset": f"WITH {PIXELS} SELECT file_id, idx AS index, (raw - 4) / 2 AS value FROM px",
    "inverse_scale": f"WITH {PIXELS} SELECT file_id, idx AS index, (raw + 4) / 4 AS value FROM px",
    "const_layer": f"WITH {PIXELS}, w AS (SELECT vec_id, embedding FROM embeddings) SELECT file_id, idx AS index, floor(embedding[idx // 32 * 32 + 1]::DOUBLE * 1000)::INT AS first FROM px JOIN w ON vec_id = file_id",
    "multires_layer": f"WITH {PIXELS}, w AS (SELECT vec_id, embedding FROM embeddings) SELECT file_id, idx AS index, floor(embedding[(line_id // 2) * 4 + sample_id // 2 + 1]::DOUBLE * 1000)::INT AS value FROM px JOIN w ON vec_id = file_id",
    "bitmap_postfix": f"WITH {PIXELS} SELECT file_id, idx AS index, ({_byte(1)} * 256 + {_byte(7)})::BIGINT AS bits FROM px",
    "bitmap_prefix": f"WITH {PIXELS} SELECT file_id, idx AS index, ({_byte(3)} * 256 + {_byte(5)})::BIGINT AS bits FROM px",
    "size_mismatch": f"WITH {PIXELS} SELECT file_id, idx AS index, raw, CASE WHEN file_id % 3 <> 0 THEN raw END AS misfit FROM px",
    "scan_geolocation_2x": f"""WITH {FILES}, p AS (SELECT file_id, lon0, lat0, i, i // 32 AS block, least(greatest(floor((i // 8 % 4 + 0.5) / 2 - 0.5), 0), 0)::INT AS r, least(greatest(floor((i % 8 + 0.5) / 2 - 0.5), 0), 2)::INT AS c,
  embedding, (i // 8 % 4 + 0.5) / 2 - 0.5 AS f, (i % 8 + 0.5) / 2 - 0.5 AS g FROM g, (SELECT unnest(range(64)) AS i) WHERE file_id % 5 <> 0),
q AS (SELECT file_id, i::INT AS index, {_between('x', 4, 0, 'block * 8')}, {_between('y', 4, 16, 'block * 8')} FROM p)
SELECT file_id, index, CASE WHEN {_IN} THEN x END AS x, CASE WHEN {_IN} THEN y END AS y FROM q""",
    "scan_footprint_compact": f"""WITH {FILES}, p AS (SELECT file_id, lon0, lat0, i, corner, i // 32 AS block, least(greatest(floor(i // 8 % 4 + dy - 0.5), 0), 2)::INT AS r, least(greatest(floor(i % 8 + dx - 0.5), 0), 6)::INT AS c,
  embedding, i // 8 % 4 + dy - 0.5 AS f, i % 8 + dx - 0.5 AS g FROM g, (SELECT unnest(range(64)) AS i), {_CORNER}),
q AS (SELECT file_id, i::INT AS index, corner, {_between('x', 8, 0, 'block * 32')}, {_between('y', 8, None, 'block * 32')} FROM p)
SELECT file_id, index, corner, x, y FROM q QUALIFY bool_and({_IN}) OVER (PARTITION BY file_id, index)""",
    "shift_longitude": f"WITH {CATALOG} SELECT id, xmin + 360 * (xmin < 0)::INT AS lon FROM c",
    "affine_geolocation": f"WITH {PIXELS} SELECT file_id, idx AS index, -100 + 0.125 * (sample_id + 0.5) + 0.0625 * (line_id + 0.5) AS x, 50 - 0.03125 * (sample_id + 0.5) - 0.125 * (line_id + 0.5) AS y FROM px",
    "sinusoidal_inverse": f"WITH {CATALOG} SELECT id, round(degrees(xmin * 40000 / (6371007.181 * cos(ymin * 100000 / 6371007.181))), 6) AS lon, round(degrees(ymin * 100000 / 6371007.181), 6) AS lat FROM c",
    "tile_geolocation_reuse": f"WITH {CATALOG} SELECT id, tile, i::INT AS index, substr(tile, 2, 2)::INT * 10.0::DOUBLE + i * 2.5::DOUBLE - 180 AS lon FROM c, (SELECT unnest(range(4)) AS i)",
} | {k: sql for k, (_, sql) in INTERPOLATED.items()}
