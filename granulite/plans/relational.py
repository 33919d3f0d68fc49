"""Catalog conditions, expressions, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry
from ..operators.joins import box_join, range_join
from ..sources.scan import pixel_scan
from .fixtures import CATALOG, FILES, PIXELS, RICH, catalog, file_catalog, pixels, read, rich_catalog, rich_files


def catalog_filter(spark, sf_dir):
    """A condition on catalog columns only: it reaches the catalog's scan."""
    return pixels(spark, sf_dir, ["file_id", "index", "v"], where=(F.col("label") == 7) & (F.col("lat0") > 0))


def dataset_not_null(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "index", "filled"]).where("filled is not null")


def dataset_is_null(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "index", "filled"]).where("filled is null").select("file_id", "index")


def expr_literals(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select("id", F.lit(3).alias("i"), F.lit(2.5).alias("d"), F.lit("it's").alias("s"), F.lit(True).alias("b"), F.lit(None).cast("int").alias("n"), F.col("price").eqNullSafe(F.lit(float("nan"))).alias("is_nan"))


def expr_functions(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select("id", F.upper("tile").alias("u"), F.substring("priority", 3, 4).alias("s"), F.length("priority").alias("n"), F.year("starttime").cast("long").alias("y"), F.col("xmin").cast("int").alias("x"), F.abs("ymin").alias("a"), F.floor("ymin").alias("f"), F.coalesce("mod03", "mod09", F.lit("none")).alias("c"))


def expr_operators(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.where((F.col("id") % 3 == 1) & (F.col("xmin") + 10 < F.col("ymin") * 2)).select("id", (-F.col("xmin")).alias("neg"), (F.col("xmax") - F.col("xmin")).alias("width"), (F.col("id") * 2 + 1).alias("odd"), F.col("id").bitwiseAND(F.lit(12)).alias("bits"))


def expr_is_distinct(spark, sf_dir):
    return catalog(spark, sf_dir).where(~F.substring("mod03", 7, 20).eqNullSafe(F.substring("mod09", 7, 20))).select("id")


def _tags():
    return F.array(F.col("id") % 5, F.col("id") % 7, F.col("id") % 11)


def expr_array_subscript(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("a", _tags())
    return c.select("id", F.element_at("a", 2).alias("second"), F.array_join(F.slice("a", 2, 2), ",").alias("tail"))


def expr_any_all(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("a", _tags())
    return c.where(F.exists("a", lambda x: x == 3) & F.forall("a", lambda x: x < 9) & F.col("tile").isin("h01", "h02", "h03", "h04", "h05", "h06", "h07")).select("id", "tile")


def expr_array(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select("id", F.size(F.array("xmin", "ymin")).alias("n"), F.array_max(F.array("xmin", "ymin")).alias("greatest"), F.size(F.array().cast("array<int>")).alias("none"))


def expr_boolean(spark, sf_dir):
    return catalog(spark, sf_dir).where((F.col("is_terra") | (F.col("ymin") > 50)) & ~(F.col("xmin") < 0)).select("id")


def expr_null_test(spark, sf_dir):
    return catalog(spark, sf_dir).where(F.col("mod03").isNull() & F.col("mod09").isNotNull()).select("id")


def _items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")


def catalog_theta_join(spark, sf_dir):
    """Ranges of ids, each joined to the catalog rows that lie in it."""
    outer = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 40).cast("long").alias("lo"), (F.col("n_nationkey") * 40 + 25).cast("long").alias("hi"))
    return range_join(outer, "lo", "hi", catalog(spark, sf_dir).select("id", "tile"), "id", 40).select("n_nationkey", "id", "tile")


def scan_theta_join(spark, sf_dir):
    """Ranges of file ids choose the files whose pixels are scanned."""
    outer = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 20).cast("long").alias("lo"), (F.col("n_nationkey") * 20 + 30).cast("long").alias("hi"))
    chosen = range_join(outer, "lo", "hi", rich_catalog(spark, sf_dir), "file_id", 30)
    return pixel_scan(chosen, rich_files(spark, sf_dir), RICH, ["file_id", "index", "value"], carry=("n_nationkey",))


def scan_equi_join(spark, sf_dir):
    """Nations whose key is a file's label choose the files whose pixels are scanned."""
    chosen = read(spark, sf_dir, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "label").join(rich_catalog(spark, sf_dir), "label")
    return pixel_scan(chosen, rich_files(spark, sf_dir), RICH, ["file_id", "index", "raw"], carry=("n_name",))


def catalog_equi_join(spark, sf_dir):
    c = catalog(spark, sf_dir).where("is_terra").select("id", "tile")
    return c.join(_items(spark, sf_dir), c.id == F.col("file_id")).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


def spatial_join(spark, sf_dir):
    """Files whose box overlaps a granule's box."""
    f = file_catalog(spark, sf_dir).select("file_id", geometry.box(F.col("lon0"), F.col("lat0"), F.col("lon0") + 1, F.col("lat0") + 1).alias("f"))
    c = catalog(spark, sf_dir).select("id", geometry.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("g"))
    return box_join(f, "f", c, "g", cell=4.0).select("file_id", "id")


def _join(how):
    def query(spark, sf_dir):
        c = catalog(spark, sf_dir).where("mod03 is not null").select("id", "tile")
        i = _items(spark, sf_dir).where("l_quantity > 45").withColumnRenamed("file_id", "id")
        return c.join(i, "id", how).select("id", "tile", *(["l_linenumber"] if how in ("inner", "left") else []))

    return query


def avg_quality_by_file(spark, sf_dir):
    """The mean of a test of bits 2 to 29, by file."""
    good = (F.col("l_partkey").bitwiseAND(F.lit(0x3FFFFFFC)) % 8 == 0).cast("int")
    return _items(spark, sf_dir).groupBy("file_id").agg(F.round(F.avg(good), 6).alias("quality"))


def count_null_by_file(spark, sf_dir):
    px = pixels(spark, sf_dir, ["file_id", "filled", "ranged"])
    return px.groupBy("file_id").agg(F.count(F.when(F.col("filled").isNull(), 1)).alias("filled"), F.count(F.when(F.col("ranged").isNull(), 1)).alias("ranged"), F.count(F.lit(1)).alias("n"))


def max_by_file(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "v", "index"]).groupBy("file_id").agg(F.max("v").alias("top"), F.max_by("index", "v").alias("at"))


def distinct_files(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "ranged"]).where("ranged is null").select("file_id").distinct()


def agg_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem")
    return e.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.grouping_id().alias("g"))


def agg_cube(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem")
    return e.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top"), F.grouping_id().alias("g"))


def count_distinct(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


def window_rank(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = read(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return e.select("user_id", "event_id", F.col("r").cast("long").alias("r"))


def window_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.max("value").over(w.rowsBetween(-2, 0)).alias("recent"), F.lag("event_id").over(w).alias("previous"), F.count(F.lit(1)).over(w).alias("n"))


def order_by_time(spark, sf_dir):
    return catalog(spark, sf_dir).where("mod03 is not null").select("id", "starttime").orderBy("starttime", "id").limit(100)


def topk(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", "price").orderBy(F.desc("price"), "id").limit(20)


def set_intersect(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.where("is_terra").select("tile", (F.col("id") % 17).alias("k")).intersect(c.where("not is_terra and ymin > 0").select("tile", (F.col("id") % 17).alias("k")))


def set_except(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select("tile", (F.col("id") % 17).alias("k")).exceptAll(c.where("ymin > 0").select("tile", (F.col("id") % 17).alias("k"))).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        catalog_filter, dataset_not_null, dataset_is_null, expr_literals, expr_functions, expr_operators, expr_is_distinct, expr_array_subscript, expr_any_all, expr_array, expr_boolean, expr_null_test,
        catalog_theta_join, scan_theta_join, scan_equi_join, catalog_equi_join, spatial_join, avg_quality_by_file, count_null_by_file, max_by_file, distinct_files, agg_rollup, agg_cube, count_distinct, window_rank, window_frame, order_by_time, topk, set_intersect, set_except,
    )
} | {"join_inner": _join("inner"), "join_left": _join("left"), "join_semi": _join("left_semi"), "join_anti": _join("left_anti")}

_P = f"{PIXELS}, q AS (SELECT *, nullif(raw, 100) AS filled, CASE WHEN raw BETWEEN -150 AND 150 THEN raw END AS ranged FROM px)"
_TAGS = "[id % 5, id % 7, id % 11]"
_J = f"WITH {CATALOG}, k AS (SELECT id, tile FROM c WHERE mod03 IS NOT NULL), i AS (SELECT l_orderkey AS id, l_linenumber FROM lineitem WHERE l_quantity > 45)"
ORACLES = {
    "catalog_filter": f"WITH {PIXELS} SELECT file_id, idx AS index, v FROM px WHERE label = 7 AND lat0 > 0",
    "dataset_not_null": f"WITH {_P} SELECT file_id, idx AS index, filled FROM q WHERE filled IS NOT NULL",
    "dataset_is_null": f"WITH {_P} SELECT file_id, idx AS index FROM q WHERE filled IS NULL",
    "expr_literals": f"WITH {CATALOG} SELECT id, 3 AS i, 2.5::DOUBLE AS d, 'it''s' AS s, true AS b, NULL::INT AS n, isnan(price) AS is_nan FROM c",
    "expr_functions": f"WITH {CATALOG} SELECT id, upper(tile) AS u, substr(priority, 3, 4) AS s, length(priority)::INT AS n, year(starttime) AS y, trunc(xmin)::INT AS x, abs(ymin) AS a, floor(ymin)::BIGINT AS f, coalesce(mod03, mod09, 'none') AS c FROM c",
    "expr_operators": f"WITH {CATALOG} SELECT id, -xmin AS neg, xmax - xmin AS width, id * 2 + 1 AS odd, id & 12 AS bits FROM c WHERE id % 3 = 1 AND xmin + 10 < ymin * 2",
    "expr_is_distinct": f"WITH {CATALOG} SELECT id FROM c WHERE substr(mod03, 7, 20) IS DISTINCT FROM substr(mod09, 7, 20)",
    "expr_array_subscript": f"WITH {CATALOG} SELECT id, ({_TAGS})[2] AS second, array_to_string(({_TAGS})[2:3], ',') AS tail FROM c",
    "expr_any_all": f"WITH {CATALOG} SELECT id, tile FROM c WHERE 3 = ANY ({_TAGS}) AND id % 5 < 9 AND id % 7 < 9 AND id % 11 < 9 AND tile IN ('h01', 'h02', 'h03', 'h04', 'h05', 'h06', 'h07')",
    "expr_array": f"WITH {CATALOG} SELECT id, 2 AS n, greatest(xmin, ymin) AS greatest, 0 AS none FROM c",
    "expr_boolean": f"WITH {CATALOG} SELECT id FROM c WHERE (is_terra OR ymin > 50) AND NOT xmin < 0",
    "expr_null_test": f"WITH {CATALOG} SELECT id FROM c WHERE mod03 IS NULL AND mod09 IS NOT NULL",
    "catalog_theta_join": f"WITH {CATALOG} SELECT n_nationkey, id, tile FROM c JOIN nation ON id >= n_nationkey * 40 AND id < n_nationkey * 40 + 25",
    "scan_theta_join": f"WITH {PIXELS}, w AS (SELECT vec_id, embedding FROM embeddings) SELECT n_nationkey, file_id, idx AS index, floor(embedding[(line_id // 2) * 4 + sample_id // 2 + 1]::DOUBLE * 1000)::INT AS value FROM px JOIN w ON vec_id = file_id JOIN nation ON file_id >= n_nationkey * 20 AND file_id < n_nationkey * 20 + 30",
    "scan_equi_join": f"WITH {PIXELS} SELECT n_name, file_id, idx AS index, raw FROM px JOIN nation ON n_nationkey = label WHERE n_regionkey < 3",
    "catalog_equi_join": f"WITH {CATALOG} SELECT tile, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM c JOIN lineitem ON id = l_orderkey WHERE is_terra GROUP BY 1",
    "spatial_join": f"WITH {CATALOG}, {FILES} SELECT file_id, id FROM c JOIN g ON xmin <= lon0 + 1 AND xmax >= lon0 AND ymin <= lat0 + 1 AND ymax >= lat0",
    "avg_quality_by_file": "SELECT l_orderkey AS file_id, round(avg(((l_partkey & 1073741820) % 8 = 0)::INT), 6) AS quality FROM lineitem GROUP BY 1",
    "count_null_by_file": f"WITH {_P} SELECT file_id, count(*) FILTER (WHERE filled IS NULL) AS filled, count(*) FILTER (WHERE ranged IS NULL) AS ranged, count(*) AS n FROM q GROUP BY 1",
    "max_by_file": f"WITH {PIXELS} SELECT file_id, max(v) AS top, arg_max(idx, v) AS at FROM px GROUP BY 1",
    "distinct_files": f"WITH {_P} SELECT DISTINCT file_id FROM q WHERE ranged IS NULL",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS top, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1",
    "window_rank": "SELECT user_id, event_id, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3",
    "window_frame": "SELECT event_id, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent, lag(event_id) OVER w AS previous, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "order_by_time": f"WITH {CATALOG} SELECT id, starttime FROM c WHERE mod03 IS NOT NULL ORDER BY starttime, id LIMIT 100",
    "topk": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 20",
    "set_intersect": f"WITH {CATALOG} SELECT tile, id % 17 AS k FROM c WHERE is_terra INTERSECT SELECT tile, id % 17 FROM c WHERE NOT is_terra AND ymin > 0",
    "set_except": f"WITH {CATALOG}, a AS (SELECT tile, id % 17 AS k, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT tile, id % 17 AS k, count(*) AS m FROM c WHERE ymin > 0 GROUP BY 1, 2) SELECT tile, k FROM a LEFT JOIN b USING (tile, k) WHERE n > coalesce(m, 0)",
    "join_inner": f"{_J} SELECT id, tile, l_linenumber FROM k JOIN i USING (id)",
    "join_left": f"{_J} SELECT id, tile, l_linenumber FROM k LEFT JOIN i USING (id)",
    "join_semi": f"{_J} SELECT id, tile FROM k WHERE id IN (SELECT id FROM i)",
    "join_anti": f"{_J} SELECT id, tile FROM k WHERE id NOT IN (SELECT id FROM i)",
}
