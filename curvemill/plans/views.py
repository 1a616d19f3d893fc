"""The engine's relations as views of the given tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves from events: a figure for each user, a curve for each type, even ids the reference and odd ones the prediction."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("figure_id"), F.col("event_type").alias("curve_id"), F.expr("if(event_id % 2 = 0, 'gt', 'pred')").alias("role"), F.col("event_id").alias("ord"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6").alias("x"), F.col("value").alias("y"),
    )


POINTS = """pts AS (SELECT CAST(user_id AS VARCHAR) AS figure_id, event_type AS curve_id, CASE WHEN event_id % 2 = 0 THEN 'gt' ELSE 'pred' END AS role,
  event_id AS ord, (epoch_us(ts) - 1704067200000000) / 1e6 AS x, value AS y FROM events)"""


def hot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As points, but a third of all events are one figure's only curves."""
    hot = F.col("ord") % 3 == 0
    return points(spark, sf_dir).withColumns({c: F.when(hot, "hot").otherwise(F.col(c)) for c in ("figure_id", "curve_id")})


HOT_POINTS = POINTS.replace("CAST(user_id AS VARCHAR) AS figure_id, event_type AS curve_id", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE user_id::VARCHAR END AS figure_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS curve_id")
STATS = """st AS (SELECT figure_id, role, curve_id, count(*) AS n_points, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM pts GROUP BY ALL)"""
PAIRS = """pr AS (SELECT p.figure_id, p.curve_id AS pred_curve_id, g.curve_id AS gt_curve_id, p.x_min AS p_lo, p.x_max AS p_hi, g.x_min AS g_lo, g.x_max AS g_hi, g.y_max - g.y_min AS y_range,
  CASE WHEN g.x_max = g.x_min THEN CASE WHEN g.x_min >= p.x_min AND g.x_min <= p.x_max THEN 1.0 ELSE 0.0 END
  ELSE greatest(0.0, least(g.x_max, p.x_max) - greatest(g.x_min, p.x_min)) / (g.x_max - g.x_min) END::DOUBLE AS coverage
  FROM st p JOIN st g ON p.figure_id = g.figure_id AND p.role = 'pred' AND g.role = 'gt')"""
SAMPLES = """one AS (SELECT figure_id, curve_id, x, arg_max(y, ord) AS y, arg_min(y, ord) AS y_first FROM pts WHERE role = 'pred' GROUP BY ALL),
want AS (SELECT pr.figure_id, pred_curve_id, gt_curve_id, ord, x, y AS gt_y FROM pr JOIN pts ON pts.figure_id = pr.figure_id AND pts.curve_id = gt_curve_id AND role = 'gt' WHERE coverage > 0),
lo AS (SELECT want.*, one.x AS x0, one.y AS y0 FROM want ASOF LEFT JOIN one ON one.figure_id = want.figure_id AND one.curve_id = want.pred_curve_id AND want.x >= one.x),
smp AS (SELECT lo.figure_id, pred_curve_id, gt_curve_id, lo.ord, lo.x, gt_y, CASE WHEN x0 IS NULL THEN one.y_first WHEN one.x IS NULL OR x0 = lo.x THEN y0
  ELSE (one.y_first - y0) / (one.x - x0) * (lo.x - x0) + y0 END AS pred_y
  FROM lo ASOF LEFT JOIN one ON one.figure_id = lo.figure_id AND one.curve_id = lo.pred_curve_id AND lo.x < one.x)"""
COMPARED = """er AS (SELECT figure_id, pred_curve_id, gt_curve_id, avg(CASE WHEN y_range <= 1e-12 THEN CASE WHEN abs(pred_y - gt_y) <= 1e-12 THEN 0.0 ELSE 1.0 END ELSE abs(pred_y - gt_y) / y_range END) AS e
  FROM smp JOIN pr USING (figure_id, pred_curve_id, gt_curve_id) GROUP BY ALL),
cmp AS (SELECT pr.figure_id, pred_curve_id, gt_curve_id, coverage, coalesce(e, 1.0) AS mean_error, CASE WHEN coverage <= 0 THEN 1.0 ELSE least(coalesce(e, 1.0), 1.0) END AS distance
  FROM pr LEFT JOIN er USING (figure_id, pred_curve_id, gt_curve_id))"""
#: All assignments of a figure's predictions, in order, each to an unused reference or, where these are fewer, to none ("~"); the least total, then the least text of choices, wins.
ASSIGNED = """ix AS (SELECT *, dense_rank() OVER (PARTITION BY figure_id ORDER BY pred_curve_id) - 1 AS p, dense_rank() OVER (PARTITION BY figure_id ORDER BY gt_curve_id) - 1 AS g FROM cmp),
dim AS (SELECT figure_id, max(p) + 1 AS np, max(g) + 1 AS ng FROM ix GROUP BY figure_id),
walk(figure_id, k, used, skipped, total, path) AS (
  SELECT figure_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, ''::VARCHAR FROM dim
  UNION ALL
  SELECT w.figure_id, w.k + 1, w.used + CASE WHEN c.g < 0 THEN 0 ELSE 1 << c.g END, w.skipped + CASE WHEN c.g < 0 THEN 1 ELSE 0 END, w.total + c.distance, w.path || CASE WHEN c.g < 0 THEN '~' ELSE chr((97 + c.g)::INTEGER) END
  FROM walk w JOIN dim USING (figure_id)
  JOIN (SELECT figure_id, p, g, distance FROM ix UNION ALL SELECT DISTINCT figure_id, p, -1, 0.0 FROM ix) c ON c.figure_id = w.figure_id AND c.p = w.k
  WHERE (c.g < 0 AND w.skipped < greatest(np - ng, 0)) OR (c.g >= 0 AND (w.used >> CASE WHEN c.g < 0 THEN 0 ELSE c.g END) & 1 = 0)),
best AS (SELECT figure_id, arg_min(path, (round(total, 9), path)) AS path, min(total) AS total FROM walk JOIN dim USING (figure_id) WHERE k = np GROUP BY figure_id),
asg AS (SELECT ix.* FROM ix JOIN best USING (figure_id) WHERE substr(path, (p + 1)::INTEGER, 1) = chr((97 + g)::INTEGER))"""


def curve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve rows with JSON arrays from line items, a row for each order, some of them broken."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("string").alias("q"), F.col("l_tax").cast("string").alias("t"), "l_returnflag")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "t"))), lambda s: s[c])
    rows = lines.groupBy("l_orderkey").agg(ordered("q").alias("q"), ordered("t").alias("t"), F.min("l_returnflag").alias("flag"))
    key = F.col("l_orderkey") % 11
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    return rows.select(
        "l_orderkey", F.when(key == 0, "not-json").otherwise(text("q")).alias("x"), F.when(key == 1, F.lit("[1.5")).when(key == 2, F.lit("[]")).when(key == 3, "[null]").otherwise(text("t")).alias("y"),
        F.lit("quantity").alias("prop_x"), F.concat(F.lit("tax "), "flag").alias("prop_y"), F.lit("").alias("unit_x"), F.when(F.col("l_orderkey") % 2 == 0, "1/K").alias("unit_y"),
    )


CURVE_ROWS = """cr AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'not-json' ELSE '[' || string_agg(l_quantity::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::VARCHAR, l_tax::VARCHAR) || ']' END AS x,
  CASE l_orderkey % 11 WHEN 1 THEN '[1.5' WHEN 2 THEN '[]' WHEN 3 THEN '[null]' ELSE '[' || string_agg(l_tax::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::VARCHAR, l_tax::VARCHAR) || ']' END AS y,
  'tax ' || min(l_returnflag) || CASE WHEN l_orderkey % 2 = 0 THEN ' (1/K)' ELSE '' END AS series_label FROM lineitem GROUP BY l_orderkey),
pa AS (SELECT *, try(json_transform(x, '["DOUBLE"]')) AS xs, try(json_transform(y, '["DOUBLE"]')) AS ys FROM (SELECT l_orderkey, series_label, CASE WHEN json_valid(x) THEN x END AS x, CASE WHEN json_valid(y) THEN y END AS y FROM cr)),
pe AS (SELECT l_orderkey, series_label, xs, ys, CASE WHEN xs IS NULL OR ys IS NULL OR len(list_filter(xs, lambda v: v IS NULL)) > 0 OR len(list_filter(ys, lambda v: v IS NULL)) > 0 THEN 'malformed array'
  WHEN len(xs) <> len(ys) THEN 'lengths differ' END AS error FROM pa)"""


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the nesting customer, order, line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n_points"), F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey").alias("ord"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").cast("string").alias("paper_id"), F.col("o_orderkey").cast("string").alias("figure_id"), F.concat_ws("-", "o_orderpriority", "l_linenumber").alias("figure_name"), F.col("ord"), "n_points")


MANIFEST_ROWS = """mr AS (SELECT o_custkey::VARCHAR AS paper_id, o_orderkey::VARCHAR AS figure_id, o_orderpriority || '-' || l_linenumber AS figure_name, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey AS ord, l_quantity::BIGINT AS n_points
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
mf AS (SELECT paper_id, figure_id, arg_min(figure_name, ord) AS figure_reference, min(ord) AS first_ord, count(*) AS n_curves FROM mr GROUP BY ALL),
mc AS (SELECT mr.*, row_number() OVER (PARTITION BY paper_id ORDER BY first_ord, figure_id, ord, figure_name, n_points) - 1 AS number FROM mr JOIN mf USING (paper_id, figure_id))"""

#: License ids that documents get in turn.
LICENSES = ("cc-by", " CC-BY ", "cc-by-4.0", "cc0", "Public-Domain", "cc-by-sa", "cc-by-nc", "cc-by-nd-4.0", "publisher-specific", "", None, "  ", "cc-by-3.0")
OTHERS = ("cc-by", None, "cc-by-nc", "")


def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works with a license id, another source's license id, and three-valued access."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    pick = lambda of: F.get(F.array(*(F.lit(x).cast("string") for x in of)), (F.col("doc_id") % len(of)).cast("int"))
    return docs.join(labels, "doc_id", "left").select("doc_id", pick(LICENSES).alias("license_id"), pick(OTHERS).alias("other_id"), (F.col("toxic") == 0).alias("is_oa"))


def _list(of: tuple) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in of) + "]"


LICENSED = f"""li AS (SELECT doc_id, {_list(LICENSES)}[(doc_id % {len(LICENSES)} + 1)::INTEGER] AS license_id, {_list(OTHERS)}[(doc_id % {len(OTHERS)} + 1)::INTEGER] AS other_id, toxic = 0 AS is_oa
  FROM documents LEFT JOIN labels USING (doc_id)),
ls AS (SELECT *, CASE WHEN lower(trim(coalesce(license_id, ''))) IN ('cc-by','cc-by-4.0','cc-by-3.0','cc-by-2.5','cc-by-2.0','cc0','public-domain','cc-by-sa','cc-by-sa-4.0','cc-by-sa-3.0') THEN 'REDISTRIBUTABLE'
  WHEN NOT is_oa THEN 'EXCLUDED' WHEN trim(coalesce(license_id, '')) = '' THEN CASE WHEN other_id = 'cc-by' THEN 'REDISTRIBUTABLE' ELSE 'NEEDS_REVIEW' END ELSE 'EXCLUDED' END AS license_status FROM li)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured images from parts: a pixel for each part, images of 200 parts."""
    return table(spark, sf_dir, "part").select(
        F.expr("cast(p_partkey div 200 as string)").alias("image_id"), F.expr("cast((p_partkey * 13) % 40 as int)").alias("x"), F.expr("cast((p_partkey * 29 + p_size) % 50 as int)").alias("y"),
        *(F.expr(f"cast((p_partkey * {a} + p_size * {b}) % 256 as int)").alias(c) for c, a, b in (("r", 37, 3), ("g", 101, 5), ("b", 59, 11))),
    ).distinct()


COLOURS = """px AS (SELECT DISTINCT (p_partkey // 200)::VARCHAR AS image_id, ((p_partkey * 13) % 40)::INTEGER AS x, ((p_partkey * 29 + p_size) % 50)::INTEGER AS y,
  ((p_partkey * 37 + p_size * 3) % 256)::INTEGER AS r, ((p_partkey * 101 + p_size * 5) % 256)::INTEGER AS g, ((p_partkey * 59 + p_size * 11) % 256)::INTEGER AS b FROM part),
hx AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 1.0 ELSE greatest(r, g, b) / 255.0::DOUBLE - least(r, g, b) / 255.0::DOUBLE END AS d FROM px),
hs AS (SELECT *, CASE WHEN r = greatest(r, g, b) THEN CASE WHEN (mx - b / 255.0::DOUBLE) / d < (mx - g / 255.0::DOUBLE) / d THEN (mx - b / 255.0::DOUBLE) / d - (mx - g / 255.0::DOUBLE) / d + 6 ELSE (mx - b / 255.0::DOUBLE) / d - (mx - g / 255.0::DOUBLE) / d END WHEN g = greatest(r, g, b) THEN 2 + (mx - r / 255.0::DOUBLE) / d - (mx - b / 255.0::DOUBLE) / d
  ELSE 4 + (mx - g / 255.0::DOUBLE) / d - (mx - r / 255.0::DOUBLE) / d END AS six FROM hx),
hu AS (SELECT image_id, x, y, r, g, b, fmod(six / 6, 1) * 360 AS hue, greatest(r, g, b) - least(r, g, b) > 40 AND (r + g + b) / 3.0 < 245 AS coloured FROM hs),
hn AS (SELECT *, CASE WHEN hue >= 340 OR hue < 20 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 170 THEN 'green' WHEN hue < 200 THEN 'cyan' WHEN hue < 260 THEN 'blue' ELSE 'purple' END AS series_label FROM hu)"""


def luminances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images of 24 x 24 from embeddings: an 8 x 8 pattern with a white column, a white row, or lines as of text."""
    grid = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(23))))
    value = F.get("embedding", F.floor(F.col("y") / 3).cast("int") * 8 + F.floor(F.col("x") / 3).cast("int"))
    at = (F.col("vec_id") * 7 % 12 + 5).cast("int")
    v = F.col("vec_id")
    white = ((v % 3 > 0) & F.col("x").between(at, at + 2)) | ((v % 2 > 0) & F.col("y").between(at, at + 2)) | ((v % 5 == 0) & (F.col("y") % 4 == 3) & (F.col("x") > 12)) | (value > 0.1)
    return grid.select(v.cast("string").alias("image_id"), "x", "y", F.when(white, 255).otherwise(0).alias("lum"))


LUMINANCES = """lu AS (SELECT vec_id::VARCHAR AS image_id, x::INTEGER AS x, y::INTEGER AS y, CASE WHEN (vec_id % 3 > 0 AND x BETWEEN vec_id * 7 % 12 + 5 AND vec_id * 7 % 12 + 7) OR (vec_id % 2 > 0 AND y BETWEEN vec_id * 7 % 12 + 5 AND vec_id * 7 % 12 + 7)
  OR (vec_id % 5 = 0 AND y % 4 = 3 AND x > 12) OR embedding[(y // 3 * 8 + x // 3 + 1)::INTEGER] > 0.1::DOUBLE THEN 255 ELSE 0 END AS lum FROM embeddings, range(24) a(x), range(24) b(y))"""


def bands_sql(name: str, source: str, keys: str, gutter: str = "share >= 0.98", least: int = 3) -> str:
    """CTEs that split the profile source (keys, i, share) into bands name (keys, lo, hi)."""
    return f"""{name}_f AS (SELECT *, {gutter} AS flag FROM {source}),
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) - row_number() OVER (PARTITION BY {keys}, flag ORDER BY i) AS isl FROM {name}_f),
{name}_r AS (SELECT {keys}, flag, isl, min(i) AS lo, max(i) + 1 AS hi FROM {name}_i GROUP BY ALL),
{name}_g AS (SELECT *, sum(CASE WHEN flag AND hi - lo >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY lo) AS band FROM {name}_r),
{name} AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi FROM {name}_g WHERE NOT (flag AND hi - lo >= {least}) GROUP BY {keys}, band)"""


GRID = f"""{LUMINANCES},
pry AS (SELECT image_id, y AS i, avg(CASE WHEN lum >= 245 THEN 1.0 ELSE 0.0 END) AS share FROM lu GROUP BY ALL),
prx AS (SELECT image_id, x AS i, avg(CASE WHEN lum >= 245 THEN 1.0 ELSE 0.0 END) AS share FROM lu GROUP BY ALL),
{bands_sql("by0", "pry", "image_id")},
{bands_sql("bx0", "prx", "image_id")},
bndy AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY lo) - 1 AS ix, count(*) OVER (PARTITION BY image_id) AS n FROM by0 WHERE hi - lo >= 0.05 * 24),
bndx AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY lo) - 1 AS ix, count(*) OVER (PARTITION BY image_id) AS n FROM bx0 WHERE hi - lo >= 0.05 * 24),
cel AS (SELECT bndy.image_id, bndy.ix AS row, bndx.ix AS col, bndx.lo AS x0, bndy.lo AS y0, bndx.hi AS x1, bndy.hi AS y1 FROM bndy JOIN bndx USING (image_id) WHERE bndy.n > 1 OR bndx.n > 1),
lin AS (SELECT image_id, row, col, x0, y0, x1, y1, y AS i, avg(CASE WHEN lum >= 245 THEN 1.0 ELSE 0.0 END) AS share FROM cel JOIN lu USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL),
fil AS (SELECT image_id, row, col, x0, y0, x1, y1, 1 - avg(share) AS content FROM lin GROUP BY ALL HAVING 1 - avg(share) >= 0.02),
rn_f AS (SELECT *, share < 0.98 AS flag FROM lin),
rn_i AS (SELECT *, row_number() OVER (PARTITION BY image_id, row, col ORDER BY i) - row_number() OVER (PARTITION BY image_id, row, col, flag ORDER BY i) AS isl FROM rn_f),
rn AS (SELECT image_id, row, col, isl, count(*) AS height FROM rn_i WHERE flag GROUP BY ALL),
txt AS (SELECT image_id, row, col, count(*) AS n_runs, stddev_pop(height) / avg(height) AS cv FROM rn GROUP BY ALL),
pan AS (SELECT fil.*, count(*) OVER (PARTITION BY image_id) AS np FROM fil LEFT JOIN txt USING (image_id, row, col) WHERE NOT coalesce(n_runs >= 4 AND cv <= 0.3, false)),
lab AS (SELECT image_id, chr((96 + row_number() OVER (PARTITION BY image_id ORDER BY row, col))::INTEGER) AS label, row, col, x0, y0, x1, y1 FROM pan WHERE np <= 26),
grd AS (SELECT * FROM lab UNION ALL SELECT DISTINCT image_id, 'a', 0, 0, 0, 0, 24, 24 FROM lu WHERE image_id NOT IN (SELECT image_id FROM lab))"""
