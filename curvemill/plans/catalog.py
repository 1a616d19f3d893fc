"""The registered queries, each with SQL for DuckDB that gives the same rows, where SQL can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill import ports
from curvemill.functions import geometry, references, responses
from curvemill.functions.licensing import license_status
from curvemill.functions.split import assign_split, unit_hash
from curvemill.operators import assignment, curves, leaderboard, manifest, pairings, panels, scoring, tables, tracing
from curvemill.plans import views
from curvemill.plans.views import table
from curvemill.sources import sinks
from curvemill.sources.files import with_default_scales, works
from curvemill.sources.order import with_read_order
from curvemill.sources.snapshots import Snapshots, run_in_batches
from curvemill.staging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- leaderboard -------------------------------------------------------------------------------------------------

RESULTS = """rs AS (SELECT s_suppkey::VARCHAR AS model_id, s_name AS model_name, CASE WHEN n IS NULL OR s_suppkey % 7 = 0 THEN 'pending_external_run' ELSE 'scored' END AS status, m AS mean_summary_score, n AS n_figures,
  'v' || s_nationkey AS dataset_version, run_at, 'note ' || s_suppkey AS note FROM supplier LEFT JOIN (SELECT l_suppkey, round(avg(1 - l_discount), 6) AS m, count(*) AS n, strftime(max(l_shipdate), '%Y-%m-%d') AS run_at FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
bd AS (SELECT model_id, model_name, status, note, CASE WHEN status = 'scored' THEN mean_summary_score END AS mean_summary_score, CASE WHEN status = 'scored' THEN n_figures END AS n_figures,
  CASE WHEN status = 'scored' THEN dataset_version END AS dataset_version, CASE WHEN status = 'scored' THEN run_at END AS run_at,
  row_number() OVER (ORDER BY status <> 'scored', CASE WHEN status = 'scored' THEN mean_summary_score END DESC NULLS LAST, model_id)::INTEGER AS rank FROM rs)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("m"), F.count("*").alias("n"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("run_at"))
    models = table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    status = F.when(F.col("n").isNull() | (F.col("s_suppkey") % 7 == 0), leaderboard.PENDING).otherwise("scored")
    return models.select(F.col("s_suppkey").cast("string").alias("model_id"), F.col("s_name").alias("model_name"), status.alias("status"), F.col("m").alias("mean_summary_score"), F.col("n").alias("n_figures"), F.concat(F.lit("v"), "s_nationkey").alias("dataset_version"), "run_at", F.concat(F.lit("note "), "s_suppkey").alias("note"))


@query(f"WITH {RESULTS} SELECT * FROM bd")
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.ranked(_results(spark, sf_dir))


@query(f"WITH {RESULTS} SELECT dataset_version, run_at FROM bd WHERE status = 'scored' ORDER BY bd.run_at DESC, rank LIMIT 1")
def leaderboard_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.latest(leaderboard.ranked(_results(spark, sf_dir)))


# --- licenses and identifiers ------------------------------------------------------------------------------------


@query(f"WITH {views.LICENSED} SELECT doc_id, license_status FROM ls")
def license_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.licensed(spark, sf_dir).select("doc_id", license_status(F.col("license_id"), F.col("is_oa"), F.col("other_id")).alias("license_status"))


@query(f"WITH {views.LICENSED} SELECT license_status, count(*) AS n FROM ls GROUP BY 1")
def license_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_classify(spark, sf_dir).groupBy("license_status").agg(F.count("*").alias("n"))


@query("""SELECT doc_id::VARCHAR AS doi, CASE WHEN quality IS NULL THEN 'NEEDS_REVIEW' WHEN quality = 1 THEN 'REDISTRIBUTABLE' WHEN toxic = 1 THEN 'EXCLUDED' ELSE 'NEEDS_REVIEW' END AS license_status FROM documents LEFT JOIN labels USING (doc_id)""")
def license_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dois = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doi"))
    lookup = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doi"), F.when(F.col("quality") == 1, "CC-BY").alias("license_id"), (F.col("toxic") == 0).alias("is_oa"))
    return manifest.classified(dois, lookup).select("doi", "license_status")


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 3 = 1 THEN '' ELSE lang END END, ''), list_filter([CASE WHEN doc_id % 2 = 0 THEN source END, '', lang], lambda v: v <> '')[1]) AS license FROM documents""")
def license_first_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    locations = F.array(*(F.struct(v.alias("license")) for v in (F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(""), F.col("lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", references.work_license(primary, locations).alias("license"))


@query("""SELECT 'W' || doc_id AS doi, doc_id % 2 = 0 AS is_oa, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, source) AS license_id, CASE WHEN doc_id % 4 = 0 THEN 'u' || doc_id END AS pdf_url FROM documents WHERE doc_id % 5 > 0""")
def works_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("u"), "doc_id"))
    work = F.struct(
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("https://doi.org/W"), "doc_id")).alias("doi"), F.struct((F.col("doc_id") % 2 == 0).alias("is_oa")).alias("open_access"),
        F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("license"), pdf.alias("pdf_url")).alias("primary_location"), F.struct(F.lit("").alias("pdf_url")).alias("best_oa_location"),
        F.array(F.struct(F.lit(None).cast("string").alias("license")), F.struct(F.col("source").alias("license"))).alias("locations"),
    )
    return works(table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.array(work).alias("results"))).alias("body")))


@query("""SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'held_out' ELSE 'public' END AS split FROM documents""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", assign_split(F.col("doc_id"), 0.2).alias("split"))


@query("""SELECT round(avg(CASE WHEN ('0x' || substr(sha256(l_orderkey || '-' || l_linenumber), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM lineitem""")
def split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg((unit_hash(key) < 0.2).cast("double")), 6).alias("share"), F.count("*").alias("n"))


NOTATIONS = ("{n}({p})", "Fig. {n}{p}", " Figure {n} ", "fig {n}_{p}", "{n}{p}", "FIG. {n} ({p})", "Table {n}", "S{n}", "Fig.{n}", "{n}({p}", "")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, replace(replace(['{n}({p})', 'Fig. {n}{p}', ' Figure {n} ', 'fig {n}_{p}', '{n}{p}', 'FIG. {n} ({p})', 'Table {n}', 'S{n}', 'Fig.{n}', '{n}({p}', ''][(l_orderkey % 11 + 1)::INTEGER], '{n}', l_linenumber::VARCHAR), '{p}', l_returnflag) AS raw FROM lineitem),
m AS (SELECT *, regexp_extract(trim(raw), '(?i)^(?:fig(?:ure)?\\.?\\s+)?(\\d+)\\s*(?:[(_]?\\s*([a-zA-Z])\\)?)?$', ['number', 'panel']) AS g FROM r)
SELECT l_orderkey, l_linenumber, nullif(g.number, '') AS number, lower(nullif(g.panel, '')) AS panel FROM m""")
def figref_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, NOTATIONS)), (F.col("l_orderkey") % len(NOTATIONS)).cast("int"))
    raw = F.replace(F.replace(raw, F.lit("{n}"), F.col("l_linenumber").cast("string")), F.lit("{p}"), F.col("l_returnflag"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", references.figure_reference(raw).alias("f"))
    return found.select("l_orderkey", "l_linenumber", "f.number", "f.panel")


@query("""SELECT page_id, nullif(regexp_replace(d, '^https://doi\\.org/', ''), '') AS doi, lower(nullif(regexp_replace(d, '^https://doi\\.org/', ''), '')) AS low FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://doi.org/' || url WHEN 1 THEN upper(url) WHEN 2 THEN '' END AS d FROM pages)""")
def doi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.expr("case page_id % 4 when 0 then concat('https://doi.org/', url) when 1 then upper(url) when 2 then '' end")
    return table(spark, sf_dir, "pages").select("page_id", references.bare_doi(doi).alias("doi"), references.bare_doi(doi, lower=True).alias("low"))


@query("""SELECT page_id, starts_with(ltrim(h, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '%PDF') AS is_pdf FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '%PDF-1.4' || html WHEN 1 THEN chr(10) || ' %PDF' || html WHEN 2 THEN '%PD' ELSE html END AS h FROM pages)""")
def pdf_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.expr("cast(case page_id % 4 when 0 then concat('%PDF-1.4', html) when 1 then concat('\n %PDF', html) when 2 then '%PD' else html end as binary)")
    return table(spark, sf_dir, "pages").select("page_id", references.is_pdf(content).alias("is_pdf"))


@query("""SELECT l_orderkey, l_linenumber, printf('p%02d_%s_%d.%s', (l_orderkey % 120)::INTEGER, s, l_linenumber, CASE WHEN s = 'page_render' THEN 'png' ELSE 'jpg' END) AS name, '/data/' || CASE WHEN contains(l_returnflag || CASE WHEN l_linenumber = 1 THEN '/x' ELSE '' END, '/') THEN '' ELSE 'raw/' END || l_returnflag || CASE WHEN l_linenumber = 1 THEN '/x' ELSE '' END AS path
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'page_render' ELSE 'embedded' END AS s FROM lineitem)""")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("l_linestatus") == "O", "page_render").otherwise("embedded")
    bare = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 1, "/x").otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", references.image_name(F.col("l_orderkey") % 120, source, F.col("l_linenumber")).alias("name"), references.image_path(bare, "/data", "raw").alias("path"))


_PAPERS = """pp AS (SELECT doc_id, license_status, CASE doc_id % 4 WHEN 0 THEN 'http://x/' || doc_id WHEN 1 THEN '' WHEN 2 THEN chr(32) || chr(9) END AS pdf_url FROM ls)"""


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified documents as papers, some of them with the address of a PDF."""
    url = F.expr("case doc_id % 4 when 0 then concat('http://x/', doc_id) when 1 then '' when 2 then concat(char(32), char(9)) end")
    return license_classify(spark, sf_dir).withColumn("pdf_url", url)


@query(f"WITH {views.LICENSED} SELECT doc_id FROM ls WHERE license_status = 'REDISTRIBUTABLE'")
def redistributable_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.gated(license_classify(spark, sf_dir)).select("doc_id")


@query(f"WITH {views.LICENSED}, {_PAPERS} SELECT doc_id, pdf_url FROM pp WHERE license_status = 'REDISTRIBUTABLE' AND pdf_url <> ''")
def downloadable_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.downloadable(_papers(spark, sf_dir)).select("doc_id", "pdf_url")


@query(f"WITH {views.LICENSED}, {_PAPERS} SELECT doc_id FROM pp WHERE trim(coalesce(pdf_url, ''), chr(32) || chr(9)) = ''")
def papers_without_pdf_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.without_pdf_url(_papers(spark, sf_dir)).select("doc_id")


@query(f"WITH {views.LICENSED} SELECT count(*) AS n FROM ls WHERE lower(trim(coalesce(license_id, ''))) LIKE 'cc-by%' AND lower(trim(license_id)) NOT LIKE '%-n_%'")
def gate_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that a pattern takes for free ones; the assertion looks at each one's status and would stop the job."""
    name = F.lower(F.regexp_replace(F.coalesce("license_id", F.lit("")), r"^\s+|\s+$", ""))
    papers = views.licensed(spark, sf_dir).withColumn("license_status", license_status(F.col("license_id"), F.col("is_oa"), F.col("other_id")))
    return manifest.must_be_redistributable(papers.where(name.like("cc-by%") & ~name.like("%-n_%"))).agg(F.count("*").alias("n"))


@query(f"WITH {views.LICENSED} SELECT l_orderkey, l_linenumber FROM lineitem JOIN ls ON doc_id = l_orderkey WHERE license_status = 'REDISTRIBUTABLE'")
def manifest_inner_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = license_classify(spark, sf_dir).withColumn("paper_id", F.col("doc_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_linenumber")
    return manifest.gated(papers).join(lines, "paper_id").select(F.col("paper_id").alias("l_orderkey"), "l_linenumber")


PAIRINGS = "case quality when 1 then 'verified' else 'rejected' end as status", "case when toxic = 1 then 'toxic' end as excluded_reason"

# --- ingest and manifest -----------------------------------------------------------------------------------------


@query(f"WITH {views.CURVE_ROWS} SELECT l_orderkey, series_label, error, len(xs) AS n_points, CASE WHEN error IS NULL THEN round(list_sum(ys), 6) END AS sum_y FROM pe WHERE xs IS NOT NULL UNION ALL SELECT l_orderkey, series_label, error, NULL, NULL FROM pe WHERE xs IS NULL")
def curve_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = manifest.parsed_curve_rows(views.curve_rows(spark, sf_dir))
    total = F.aggregate("y_values", F.lit(0.0), lambda a, v: a + v)
    return parsed.select("l_orderkey", "series_label", "error", F.when(F.col("x_values").isNotNull(), F.size("x_values")).cast("long").alias("n_points"), F.when(F.col("error").isNull(), F.round(total, 6)).alias("sum_y"))


@query(f"WITH {views.CURVE_ROWS}, bad AS (SELECT DISTINCT o_custkey FROM pe JOIN orders ON l_orderkey = o_orderkey WHERE error IS NOT NULL) SELECT l_orderkey, o_custkey FROM pe JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT o_custkey FROM bad)")
def curve_bad_rows_void_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sid"))
    return manifest.without_spoilt_papers(manifest.parsed_curve_rows(views.curve_rows(spark, sf_dir)).join(orders, "l_orderkey")).select("l_orderkey", F.col("sid").alias("o_custkey"))


@query(f"WITH {views.CURVE_ROWS} SELECT doc_id::VARCHAR AS figure_id, series_label, len(xs)::INTEGER AS n_points FROM labels JOIN pe ON l_orderkey = doc_id WHERE quality = 1 AND toxic = 0 AND error IS NULL AND len(xs) > 0")
def pairing_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = manifest.verified(table(spark, sf_dir, "labels").selectExpr("cast(doc_id as string) as figure_id", *PAIRINGS))
    parsed = manifest.parsed_curve_rows(views.curve_rows(spark, sf_dir)).withColumn("figure_id", F.col("l_orderkey").cast("string"))
    return pairings.ground_truth(pairs, parsed).select("figure_id", "series_label", F.size("x_values").alias("n_points"))


@query("""SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS number, CASE WHEN l_linestatus = 'O' THEN 'embedded' ELSE 'page_render' END AS source FROM lineitem l WHERE (l_linestatus = 'O' AND l_quantity * 10 * 150 >= 22500)
OR (l_linestatus <> 'O' AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_linestatus = 'O' AND m.l_quantity * 10 * 150 >= 22500))""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as page", "l_partkey as number", "if(l_linestatus = 'O', 'embedded', 'page_render') as source", "l_quantity * 10 as width", "150 as height")
    return pairings.page_images(images).select("doc", "page", "number", "source")


@query("""SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ordinal FROM lineitem""")
def image_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairings.with_ordinals(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as page", "l_partkey as number"))


_LINKS = """pg AS (SELECT doc_id AS paper_id, source AS image_id, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'z' END AS panel_label, CASE doc_id % 3 WHEN 0 THEN 'p' || doc_id || '.png' WHEN 1 THEN 'raw/p' || doc_id || '.png' END AS image_path FROM documents)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairings of documents with a panel, or none, and an image, bare or with its folder."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as paper_id", "source as image_id", "case doc_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'z' end as panel_label", "case doc_id % 3 when 0 then concat('p', doc_id, '.png') when 1 then concat('raw/p', doc_id, '.png') end as image_path"
    )


@query(f"WITH {_LINKS} SELECT paper_id, image_path FROM pg WHERE image_path NOT LIKE '%/%'")
def pairing_bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairings.bare_names(_links(spark, sf_dir)).select("paper_id", "image_path")


@query(f"WITH {_LINKS} SELECT paper_id, coalesce(CASE quality WHEN 1 THEN lang END, 'cc-by') AS license_id FROM pg JOIN labels ON paper_id = labels.doc_id JOIN documents d ON d.doc_id = paper_id")
def pairing_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").selectExpr("doc_id as paper_id", "case quality when 1 then lang else '' end as license_id")
    return pairings.with_license(_links(spark, sf_dir), papers).select("paper_id", "license_id")


@query(f"WITH {_LINKS}, bx AS (SELECT DISTINCT source AS image_id, unnest(['a', 'b']) AS label, length(source) AS x0 FROM documents) SELECT paper_id, bx.x0, CASE WHEN panel_label IS NOT NULL AND label IS NULL THEN 'KeyError: no panel ' || panel_label END AS error FROM pg LEFT JOIN bx ON bx.image_id = pg.image_id AND label = panel_label")
def pairing_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "documents").select(F.col("source").alias("image_id")).distinct().select("image_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label"), F.length("image_id").cast("long").alias("x0"))
    return pairings.with_panel(_links(spark, sf_dir), boxes).select("paper_id", "x0", "error")


@query(f"WITH {_LINKS} SELECT pg.paper_id, quality AS size FROM pg JOIN labels ON doc_id = paper_id WHERE image_path = 'p' || doc_id || '.png'")
def pairing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "labels").selectExpr("doc_id as paper_id", "concat('p', doc_id, '.png') as name", "quality as size")
    return pairings.with_images(_links(spark, sf_dir), names).select("paper_id", "size")


@query("SELECT o_custkey AS paper_id, count(*) AS n_files FROM orders WHERE o_custkey % 5 > 0 GROUP BY 1")
def papers_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "customer").selectExpr("c_custkey as paper_id", "c_custkey % 5 as n_images")
    files = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("folder")).agg(F.collect_list("o_orderkey").alias("names"))
    return pairings.papers_with_images(papers, files).select("paper_id", F.size("names").cast("long").alias("n_files"))


@query(f"WITH {views.CURVE_ROWS} SELECT coalesce(sum(len(xs)), 0)::BIGINT AS total FROM pe")
def total_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.total_size(manifest.parsed_curve_rows(views.curve_rows(spark, sf_dir)), "x_values")


@query("""SELECT s_suppkey, 'Read every data series from the chart image. The plot area spans x from ' || s_suppkey || ' to ' || (s_suppkey + 5) || ' (' || CASE WHEN s_nationkey % 2 = 0 THEN 'log' ELSE 'linear' END || ' scale) and y from ' || s_nationkey || ' to 99.' || chr(10) || 'Answer with one JSON object only: {"series": [{"label": "<name>", "x": [<numbers>], "y": [<numbers>]}]}' AS prompt FROM supplier""")
def llm_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = responses.prompt(F.col("s_suppkey"), F.col("s_suppkey") + 5, F.expr("if(s_nationkey % 2 = 0, 'log', 'linear')"), F.col("s_nationkey"), F.lit(99))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("prompt"))


@query("SELECT 'v0-eval-pilot-n' || count(*) AS dataset_version FROM labels WHERE quality = 1 AND toxic = 0")
def dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_verified(spark, sf_dir).agg(pairings.dataset_version(F.count("*")).alias("dataset_version"))


@query(f"WITH {views.MANIFEST_ROWS} SELECT paper_id, figure_id, figure_reference, n_curves, CASE WHEN ('0x' || substr(sha256(paper_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'held_out' ELSE 'public' END AS split FROM mf")
def manifest_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.figures(views.manifest_rows(spark, sf_dir)).drop("first_ord")


@query(f"WITH {views.MANIFEST_ROWS} SELECT paper_id || '-' || figure_id || '-' || number AS curve_id, figure_id, n_points FROM mc")
def manifest_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.curves(views.manifest_rows(spark, sf_dir)).select("curve_id", "figure_id", "n_points")


@query("""WITH li AS (SELECT l_orderkey, l_quantity, row_number() OVER () - 1 AS ord FROM lineitem), mr AS (SELECT o_custkey, o_orderkey, ord, l_quantity FROM li JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT *, min(ord) OVER (PARTITION BY o_custkey, o_orderkey) AS first FROM mr) SELECT o_custkey || '-' || o_orderkey || '-' || (row_number() OVER (PARTITION BY o_custkey ORDER BY first, o_orderkey::VARCHAR, ord) - 1) AS curve_id, ord, l_quantity::BIGINT AS n_points FROM f""")
def curves_in_read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves numbered by where their rows stand in the file."""
    lines = with_read_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("paper_id"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("paper_id", F.col("l_orderkey").cast("string").alias("figure_id"), "ord", F.col("l_quantity").cast("long").alias("n_points"))
    return manifest.curves(rows).select("curve_id", "ord", "n_points")


@query(f"WITH {views.MANIFEST_ROWS} SELECT c_custkey::VARCHAR AS paper_id, coalesce(f, 0) AS n_figures, coalesce(c, 0)::BIGINT AS n_curves FROM customer LEFT JOIN (SELECT paper_id, count(*) AS f, sum(n_curves) AS c FROM mf GROUP BY 1) ON paper_id = c_custkey::VARCHAR")
def manifest_paper_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest_rows(spark, sf_dir)
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"))
    return manifest.paper_counts(papers, manifest.figures(rows), manifest.curves(rows))


@query(f"""WITH {views.MANIFEST_ROWS}, inn AS (SELECT paper_id, figure_id, string_agg(paper_id || '-' || figure_id || '-' || number || ':' || n_points, ',' ORDER BY number) AS c FROM mc GROUP BY ALL)
SELECT c_custkey::VARCHAR AS paper_id, coalesce(t, '') AS figures FROM customer LEFT JOIN (SELECT paper_id, string_agg(figure_id || '=' || c, ';' ORDER BY first_ord, figure_id) AS t FROM mf JOIN inn USING (paper_id, figure_id) GROUP BY 1) ON paper_id = c_custkey::VARCHAR""")
def manifest_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest_rows(spark, sf_dir)
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"))
    nested = manifest.nested(papers, manifest.figures(rows), manifest.curves(rows))
    curve = lambda c: F.concat_ws(":", c["curve_id"], c["n_points"].cast("string"))
    figure = lambda f: F.concat_ws("=", f["figure_id"], F.array_join(F.transform(f["curves"], curve), ","))
    return nested.select("paper_id", F.coalesce(F.array_join(F.transform("figures", figure), ";"), F.lit("")).alias("figures"))


@query("""WITH p AS (SELECT o_custkey AS paper_id, CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN o_orderstatus = 'F' THEN 'http_error' END AS pdf_status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN o_orderkey % 20 END AS n_images FROM orders)
SELECT count(DISTINCT paper_id) AS n_papers, count(pdf_status) AS n_attempted, count(*) FILTER (pdf_status = 'ok') AS n_ok, round(count(*) FILTER (pdf_status = 'ok') / greatest(1, count(pdf_status)), 6) AS ok_rate, count(*) FILTER (coalesce(n_images, 0) > 0) AS n_with_images, sum(coalesce(n_images, 0))::BIGINT AS n_images, round(avg(n_images) FILTER (pdf_status = 'ok'), 6) AS mean_images_per_ok FROM p""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "orders").selectExpr("o_custkey as paper_id", "case o_orderstatus when 'O' then 'ok' when 'F' then 'http_error' end as pdf_status", "case when o_orderstatus = 'O' and o_orderkey % 3 > 0 then o_orderkey % 20 end as n_images")
    return rounded(manifest.summary(papers), "ok_rate", "mean_images_per_ok")


@query("SELECT o_orderstatus AS pdf_status, count(*) AS n FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("pdf_status"))
    return manifest.status_counts(rows)


@query("""SELECT CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus END AS pdf_status, count(DISTINCT o_custkey) AS n_papers, count(*) AS n FROM (SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) GROUP BY 1""")
def manifest_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest kept in batches: a run that did a third of the papers, then one that does the rest, and one with nothing to do."""
    papers = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"))
    kept = Snapshots(spark, f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}", "paper_id long, pdf_status string")
    fetch = lambda rows: rows.select("paper_id", F.when(F.col("paper_id") % 4 > 0, F.col("status")).alias("pdf_status"))
    kept.commit(1, fetch(papers.where("paper_id % 3 = 0")))
    kept.commit(1, fetch(papers))  # the same batch again
    rest = papers.count() // 2 + 1
    run_in_batches(papers, "paper_id", rest, fetch, kept)
    return run_in_batches(papers, "paper_id", rest, fetch, kept).groupBy("pdf_status").agg(F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.not_yet_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])




@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def gate_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "labels").selectExpr("doc_id", *PAIRINGS)).select("doc_id")


@query("SELECT doc_id::VARCHAR AS figure_id, source AS paper_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gate_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as figure_id", "source as paper_id", "doc_id")
    pairings = table(spark, sf_dir, "labels").selectExpr("doc_id", *PAIRINGS).join(docs, "doc_id").select("paper_id", "figure_id", "status", "excluded_reason")
    return manifest.verified_exists(docs.select("paper_id", "figure_id"), pairings).select("figure_id", "paper_id")


@query("SELECT doc_id, coalesce(p.x_scale, 'linear') AS x_scale, coalesce(p.y_scale, 'linear') AS y_scale FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'log' END AS x_scale, CASE WHEN quality = 1 THEN 'log' END AS y_scale FROM labels) p")
def registry_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_default_scales(table(spark, sf_dir, "labels").selectExpr("doc_id", "case when toxic = 1 then 'log' end as x_scale", "case when quality = 1 then 'log' end as y_scale"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def cache_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


_CACHES = """ol AS (SELECT o_custkey AS id, max(o_orderpriority) AS name FROM orders GROUP BY 1), nw AS (SELECT c_custkey AS id, c_name AS name FROM customer)"""


def _caches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cache of the customers that ordered something, and rows for all customers."""
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name"))
    return old, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(f"WITH {_CACHES} SELECT * FROM ol UNION ALL SELECT * FROM nw WHERE id NOT IN (SELECT id FROM ol)")
def cache_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_absent(*_caches(spark, sf_dir), ["id"])


@query(f"WITH {_CACHES} SELECT id, coalesce(nw.name, ol.name) AS name FROM ol FULL JOIN nw USING (id)")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert(*_caches(spark, sf_dir), ["id"])


@query("SELECT s_suppkey::VARCHAR AS figure_id, 'real' AS kind FROM supplier UNION ALL SELECT 'synthetic-' || n_nationkey, 'synthetic' FROM nation")
def union_real_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as figure_id", "'real' as kind")
    return real.unionByName(table(spark, sf_dir, "nation").selectExpr("concat('synthetic-', n_nationkey) as figure_id", "'synthetic' as kind"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 40)::BIGINT AS batch FROM orders")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 40)


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 50")
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sample_n(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 50)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 10")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 7, 10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# --- curves ------------------------------------------------------------------------------------------------------

_PAIRS = f"WITH RECURSIVE {views.POINTS}, {views.STATS}, {views.PAIRS}"
_CMP = f"{_PAIRS}, {views.SAMPLES}, {views.COMPARED}"
_ASG = f"{_CMP}, {views.ASSIGNED}"


@query(f"WITH {views.POINTS}, {views.STATS} SELECT figure_id, role, curve_id, n_points, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, y_min, y_max FROM st")
def curve_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.curve_stats(views.points(spark, sf_dir)), "x_min", "x_max")


@query(f"WITH {views.POINTS} SELECT figure_id, role, curve_id, ord, (row_number() OVER (PARTITION BY figure_id, role, curve_id ORDER BY x, ord))::INTEGER AS place FROM pts")
def curve_sorted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.sorted_points(views.points(spark, sf_dir)).select("figure_id", "role", "curve_id", "ord", "place")


@query(f"{_PAIRS} SELECT figure_id, pred_curve_id, gt_curve_id, round(coverage, 6) AS coverage FROM pr")
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.with_coverage(curves.pairs(views.points(spark, sf_dir))).select("figure_id", "pred_curve_id", "gt_curve_id", "coverage"), "coverage")


@query(f"{_PAIRS}, {views.SAMPLES} SELECT figure_id, pred_curve_id, gt_curve_id, ord, round(pred_y, 6) AS pred_y FROM smp")
def pair_interp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = views.points(spark, sf_dir)
    met = curves.with_coverage(curves.pairs(pts)).where("coverage > 0")
    return rounded(curves.interpolated(pts, met).select("figure_id", "pred_curve_id", "gt_curve_id", "ord", "pred_y"), "pred_y")


@query(f"{_CMP} SELECT figure_id, pred_curve_id, gt_curve_id, round(coverage, 6) AS coverage, round(mean_error, 6) AS mean_error, round(distance, 6) AS distance FROM cmp")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.compared(views.points(spark, sf_dir)), "coverage", "mean_error", "distance")


_CHAMFER = """, sc AS (SELECT figure_id, pred_curve_id, gt_curve_id, CASE WHEN g_hi = g_lo THEN 1 ELSE g_hi - g_lo END AS xr, CASE WHEN y_range = 0 THEN 1 ELSE y_range END AS yr FROM pr),
dd AS (SELECT sc.figure_id, pred_curve_id, gt_curve_id, p.ord AS po, g.ord AS go, sqrt(pow(p.x / xr - g.x / xr, 2) + pow(p.y / yr - g.y / yr, 2)) AS d FROM sc JOIN pts p ON p.figure_id = sc.figure_id AND p.curve_id = pred_curve_id AND p.role = 'pred' JOIN pts g ON g.figure_id = sc.figure_id AND g.curve_id = gt_curve_id AND g.role = 'gt'),
a AS (SELECT figure_id, pred_curve_id, gt_curve_id, avg(m) AS v FROM (SELECT figure_id, pred_curve_id, gt_curve_id, po, min(d) AS m FROM dd GROUP BY ALL) GROUP BY ALL), b AS (SELECT figure_id, pred_curve_id, gt_curve_id, avg(m) AS w FROM (SELECT figure_id, pred_curve_id, gt_curve_id, go, min(d) AS m FROM dd GROUP BY ALL) GROUP BY ALL)
SELECT figure_id, pred_curve_id, gt_curve_id, round((v + w) / 2, 6) AS chamfer FROM a JOIN b USING (figure_id, pred_curve_id, gt_curve_id)"""


@query(_PAIRS + _CHAMFER)
def pair_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = views.points(spark, sf_dir)
    return rounded(curves.chamfer(pts, curves.pairs(pts)), "chamfer")


@query(_PAIRS.replace(views.POINTS, views.HOT_POINTS) + _CHAMFER)
def pair_chamfer_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve with a sixth of all events against another as long, in blocks."""
    pts = views.hot_points(spark, sf_dir)
    return rounded(curves.chamfer(pts, curves.pairs(pts)), "chamfer")


@query(f"{_PAIRS.replace(views.POINTS, views.HOT_POINTS)}, {views.SAMPLES} SELECT figure_id, pred_curve_id, gt_curve_id, ord, round(pred_y, 6) AS pred_y FROM smp")
def pair_interp_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curves interpolated, in ranges of some 500 points."""
    pts = views.hot_points(spark, sf_dir)
    met = curves.with_coverage(curves.pairs(pts)).where("coverage > 0")
    return rounded(curves.interpolated(pts, met, range_points=500).select("figure_id", "pred_curve_id", "gt_curve_id", "ord", "pred_y"), "pred_y")


def _log_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The curves on a logarithmic x axis in figures of odd number, shifted so that some x aren't positive."""
    pts = views.points(spark, sf_dir).withColumn("x", F.col("x") - 20000)
    figures = pts.select("figure_id").distinct()
    scales = figures.withColumn("x_scale", F.when(F.col("figure_id").cast("long") % 2 > 0, "log").otherwise("linear"))
    return (*curves.in_log_space(pts, scales), figures)


_LOG = (_PAIRS.replace("pts AS (", "raw AS (", 1).replace(f", {views.STATS}", "", 1)).split(", pr AS (")[0] + f""", bad AS (SELECT DISTINCT figure_id FROM raw WHERE figure_id::BIGINT % 2 > 0 AND x - 20000 <= 0),
pts AS (SELECT figure_id, curve_id, role, ord, CASE WHEN figure_id::BIGINT % 2 > 0 THEN log10(x - 20000) ELSE x - 20000 END AS x, y FROM raw WHERE figure_id NOT IN (SELECT figure_id FROM bad)), {views.STATS}, {views.PAIRS}, {views.SAMPLES}, {views.COMPARED}"""


@query(f"{_LOG} SELECT figure_id, pred_curve_id, gt_curve_id, round(distance, 5) AS distance, round(coverage, 5) AS coverage FROM cmp")
def pair_distance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _, _ = _log_points(spark, sf_dir)
    return rounded(curves.compared(good).select("figure_id", "pred_curve_id", "gt_curve_id", "distance", "coverage"), "distance", "coverage", places=5)


@query(f"{_ASG} SELECT figure_id, round(sum(distance), 6) AS total FROM asg GROUP BY 1")
def assign_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = curves.compared(views.points(spark, sf_dir))
    return assignment.assign(pairs).groupBy("figure_id").agg(F.round(F.sum("distance"), 6).alias("total"))


@query(f"{_ASG} SELECT figure_id, pred_curve_id, gt_curve_id FROM asg")
def assign_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.assign(curves.compared(views.points(spark, sf_dir))).select("figure_id", "pred_curve_id", "gt_curve_id")


_FULL = f"""{_ASG}, al AS (SELECT figure_id, pred_curve_id, gt_curve_id, distance, coverage FROM asg
UNION ALL SELECT figure_id, curve_id, NULL, NULL, NULL FROM st WHERE role = 'pred' AND NOT EXISTS (SELECT 1 FROM asg WHERE asg.figure_id = st.figure_id AND pred_curve_id = curve_id)
UNION ALL SELECT figure_id, NULL, curve_id, NULL, NULL FROM st WHERE role = 'gt' AND NOT EXISTS (SELECT 1 FROM asg WHERE asg.figure_id = st.figure_id AND gt_curve_id = curve_id)),
fs AS (SELECT figure_id, count(pred_curve_id) AS n_pred, count(gt_curve_id) AS n_gt, count(*) FILTER (pred_curve_id IS NOT NULL AND gt_curve_id IS NOT NULL) / greatest(count(pred_curve_id), count(gt_curve_id), 1) AS match_rate, coalesce(avg(distance), 1.0) AS mean_distance, coalesce(avg(coverage), 0.0) AS mean_coverage FROM al GROUP BY 1),
sp AS (SELECT u.figure_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_gt, 0) AS n_gt, coalesce(match_rate, 1.0) AS match_rate, coalesce(mean_distance, 0.0) AS mean_distance, coalesce(mean_coverage, 1.0) AS mean_coverage FROM (SELECT c_custkey::VARCHAR AS figure_id FROM customer UNION SELECT figure_id FROM pts) u LEFT JOIN fs USING (figure_id)),
sc AS (SELECT *, (match_rate + (1 - mean_distance) + mean_coverage) / 3 AS summary_score FROM sp)"""


@query(f"{_FULL} SELECT figure_id, pred_curve_id, gt_curve_id, pred_curve_id IS NULL AS is_miss, gt_curve_id IS NULL AS is_false_positive FROM al")
def match_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = views.points(spark, sf_dir)
    return assignment.matched_curves(curves.compared(pts), curves.curve_stats(pts)).drop("distance", "coverage")


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More figures than have curves: all customers too."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("figure_id")).union(views.points(spark, sf_dir).select("figure_id")).distinct()


SCORES = ("match_rate", "mean_distance", "mean_coverage", "summary_score")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


@query(f"{_FULL} SELECT figure_id, n_pred, n_gt, {_ROUND} FROM sc")
def figure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.figure_scores(views.points(spark, sf_dir), _figures(spark, sf_dir)), *SCORES)


@query(f"{_FULL} SELECT count(*) AS n_figures, round(avg(summary_score), 6) AS mean_summary_score FROM sc")
def dataset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.dataset_score(scoring.figure_scores(views.points(spark, sf_dir), _figures(spark, sf_dir))), "mean_summary_score")


_FULL_LOG = _LOG + _FULL[len(_CMP):]


@query(f"""{_FULL_LOG.replace("SELECT c_custkey::VARCHAR AS figure_id FROM customer UNION SELECT figure_id FROM pts", "SELECT DISTINCT figure_id FROM raw")} SELECT figure_id, CASE WHEN b.figure_id IS NULL THEN round(summary_score, 5) ELSE 0.0 END AS summary_score, CASE WHEN b.figure_id IS NOT NULL THEN 'ValueError: log scale requires positive x' END AS error FROM sc LEFT JOIN bad b USING (figure_id)""")
def figure_score_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad, figures = _log_points(spark, sf_dir)
    return rounded(scoring.with_errors(scoring.figure_scores(good, figures), bad).select("figure_id", "summary_score", "error"), "summary_score", places=5)


# --- pixels ------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey, p_partkey % 37 AS px, p_partkey % 23 AS py, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 36 END AS w, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 22 END AS h, CASE WHEN p_size % 2 = 0 THEN 'log' ELSE 'linear' END AS xs, CASE WHEN p_size % 3 = 0 THEN 'log' ELSE 'linear' END AS ys, p_size - 1 AS lo FROM part),
f AS (SELECT *, CASE WHEN w = 0 THEN 0.0 ELSE px / w END AS fx, 1 - CASE WHEN h = 0 THEN 0.0 ELSE py / h END AS fy, CASE WHEN xs = 'log' AND lo <= 0 THEN 'ValueError: log scale requires a positive range' END AS error FROM c)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN round(CASE WHEN xs = 'log' THEN pow(10, log10(lo) + fx * (log10(lo + 100) - log10(lo))) ELSE lo + fx * 100 END, 6) END AS x, CASE WHEN error IS NULL THEN round(CASE WHEN ys = 'log' THEN pow(10, fy * 2) ELSE 1 + fy * 99 END, 6) END AS y FROM f""")
def pixel_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "double(p_partkey % 37) as px", "double(p_partkey % 23) as py", "if(p_partkey % 10 = 0, 0d, 36d) as w", "if(p_partkey % 9 = 0, 0d, 22d) as h", "if(p_size % 2 = 0, 'log', 'linear') as xs", "if(p_size % 3 = 0, 'log', 'linear') as ys", "double(p_size - 1) as lo"
    )
    col, zero = F.col, F.lit(0.0)
    ranges = (col("lo"), col("lo") + 100), (F.lit(1.0), F.lit(100.0))
    error = geometry.calibration_error(*ranges, col("xs"), col("ys"))
    x, y = geometry.to_data(col("px"), col("py"), (zero, zero, col("w"), col("h")), *ranges, col("xs"), col("ys"))
    good = c.withColumn("error", error)
    return good.select("p_partkey", "error", F.when(col("error").isNull(), F.round(x, 6)).alias("x"), F.when(col("error").isNull(), F.round(y, 6)).alias("y"))


@query(f"WITH {views.COLOURS} SELECT image_id, x, y, r, g, b, series_label FROM hn WHERE coloured")
def pixel_hue_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    found = views.colours(spark, sf_dir).where(geometry.coloured(*rgb))
    return found.withColumn("series_label", geometry.hue_name(geometry.hue(*rgb)))


@query(f"""WITH {views.COLOURS}, k AS (SELECT * FROM hn WHERE coloured), big AS (SELECT image_id, series_label FROM k GROUP BY ALL HAVING count(*) >= 15), md AS (SELECT image_id, series_label, x AS px, median(y) AS m FROM k JOIN big USING (image_id, series_label) GROUP BY ALL),
wide AS (SELECT image_id, series_label FROM md GROUP BY ALL HAVING count(*) >= 2), bx AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM k GROUP BY 1)
SELECT image_id, series_label, px, round(CASE WHEN image_id::INTEGER % 2 = 0 THEN pow(10, 2 * (px - x0) / (x1 - x0)) ELSE 1 + 99 * (px - x0) / (x1 - x0) END, 6) AS x, round(50 * (1 - (m - y0) / (y1 - y0)), 6) AS y FROM md JOIN wide USING (image_id, series_label) JOIN bx USING (image_id)""")
def pixel_trace_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.colours(spark, sf_dir)
    axes = pixels.select("image_id").distinct().selectExpr("image_id", "1d as x_lo", "100d as x_hi", "0d as y_lo", "50d as y_hi", "if(int(image_id) % 2 = 0, 'log', 'linear') as x_scale", "'linear' as y_scale")
    return rounded(tracing.traced(pixels, axes), "x", "y")


@query(f"WITH {views.COLOURS} SELECT image_id, x, y, r, g, b, floor(0.299::FLOAT * r::FLOAT + 0.587::FLOAT * g::FLOAT + 0.114::FLOAT * b::FLOAT)::INTEGER AS lum FROM px")
def pixel_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.colours(spark, sf_dir).withColumn("lum", geometry.luminance(*(F.col(c) for c in "rgb")))


@query(f"WITH {views.GRID} SELECT image_id, 'y' AS axis, lo, hi FROM by0 UNION ALL SELECT image_id, 'x', lo, hi FROM bx0")
def band_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.luminances(spark, sf_dir)
    one = lambda axis: panels.bands(panels.profile(pixels, axis)).select("image_id", F.lit(axis).alias("axis"), "lo", "hi")
    return one("y").unionByName(one("x"))


@query(f"WITH {views.GRID} SELECT image_id, label, row, col, x0, y0, x1, y1 FROM grd")
def panel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel_grid(views.luminances(spark, sf_dir))


@query(f"WITH {views.GRID} SELECT n_panels, count(*) AS n_images FROM (SELECT image_id, count(*) AS n_panels FROM grd GROUP BY 1) GROUP BY 1")
def panel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.histogram(panel_grid(spark, sf_dir))


@query(f"WITH {views.GRID}, oc AS (SELECT image_id, CASE WHEN image_id::BIGINT % 13 > 0 THEN count(*) END AS n FROM grd GROUP BY image_id) SELECT count(*) AS n_images, count(*) FILTER (n IS NULL) AS n_failed, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n = 1) AS n_single, round(count(*) FILTER (n > 1) / greatest(1, count(n)), 6) AS multi_rate FROM oc")
def panel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.rates(panels.outcomes(_split(spark, sf_dir))), "multi_rate")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of all images, with an error where an image of every thirteenth number was damaged."""
    damaged = F.when(F.col("image_id").cast("long") % 13 == 0, "SplitError: damaged")
    return panel_grid(spark, sf_dir).withColumn("error", damaged)


@query(f"WITH {views.GRID}, oc AS (SELECT image_id, count(*) > 1 AS multi, sha256('3:' || image_id) AS h FROM grd GROUP BY image_id), rk AS (SELECT *, row_number() OVER (PARTITION BY multi ORDER BY h, image_id) AS n FROM oc) SELECT image_id, multi FROM rk WHERE n <= 15")
def sample_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = panel_grid(spark, sf_dir).groupBy("image_id").agg((F.count("*") > 1).alias("multi"))
    return tables.half_sample(counted, "image_id", F.col("multi"), 3, 30)


@query(f"WITH {views.GRID}, oc AS (SELECT image_id, count(*) AS n_panels, sha256('5:' || image_id) AS h FROM grd GROUP BY image_id) SELECT image_id, n_panels FROM oc QUALIFY row_number() OVER (PARTITION BY n_panels > 1 ORDER BY h, image_id) <= 10")
def panel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a review sample of 20 images."""
    return sinks.panel_sample(panel_grid(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n_panels")), 5, 20)


@query(f"WITH {views.GRID} SELECT grd.image_id, label, count(*) AS n_pixels, sum((x - x0) * lum)::BIGINT AS mass FROM grd JOIN lu ON lu.image_id = grd.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL")
def panel_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.luminances(spark, sf_dir)
    return panels.cropped(pixels, panels.panel_grid(pixels)).groupBy("image_id", "label").agg(F.count("*").alias("n_pixels"), F.sum(F.col("x") * F.col("lum")).alias("mass"))


@query(f"WITH {views.LUMINANCES}, li AS (SELECT image_id, y AS i, avg(CASE WHEN lum >= 245 THEN 1.0 ELSE 0.0 END) < 0.6 AS flag FROM lu GROUP BY image_id, y), ii AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i) - row_number() OVER (PARTITION BY image_id, flag ORDER BY i) AS isl FROM li), r AS (SELECT image_id, isl, count(*) AS h FROM ii WHERE flag GROUP BY ALL) SELECT image_id, count(*) AS n_runs, round(stddev_pop(h) / avg(h), 6) AS cv FROM r GROUP BY 1")
def text_run_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = panels.profile(views.luminances(spark, sf_dir), "y").select("image_id", "i", (F.col("share") < 0.6).alias("content"))
    return rounded(panels.run_variation(lines, ["image_id"]), "cv")


# --- language models and plug-ins --------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, '{"series":[{"label":"' || role || '","x":[' || turn || ',' || (turn + 1) || '],"y":[' || length(text) || CASE WHEN turn % 3 = 1 THEN '' ELSE ',2' END || ']}' || CASE WHEN turn % 2 = 0 THEN ',{"label":"z","x":[1],"y":[' || conv_id || ']}' ELSE '' END || ']}' AS j FROM conversations),
s AS (SELECT conv_id, turn, unnest(json_transform(j, '{"series":[{"label":"VARCHAR","x":["DOUBLE"],"y":["DOUBLE"]}]}').series) AS s FROM c WHERE turn % 5 < 4)
SELECT conv_id, turn, s.label AS label, len(s.x) AS n_points, round(list_sum(s.y), 6) AS sum_y FROM s WHERE len(s.x) = len(s.y) AND len(s.x) > 0""")
def llm_parse_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""concat('{"series":[{"label":"', role, '","x":[', turn, ',', turn + 1, '],"y":[', length(text), if(turn % 3 = 1, '', ',2'), ']}', if(turn % 2 = 0, concat(',{"label":"z","x":[1],"y":[', conv_id, ']}'), ''), ']}')""")
    reply = F.when(F.col("turn") % 5 == 4, "no json").when(F.col("turn") % 5 == 0, body).when(F.col("turn") % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit(" ```\n"), body, F.lit("```\n")))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(responses.parsed_series(reply)).alias("s"))
    return found.select("conv_id", "turn", "s.label", F.size("s.x").cast("long").alias("n_points"), F.round(F.aggregate("s.y", F.lit(0.0), lambda a, v: a + v), 6).alias("sum_y"))


@query("""WITH c AS (SELECT *, turn % 4 AS k FROM conversations) SELECT conv_id, turn, 'good' AS label, 2 AS n_points, (length(text) + conv_id)::DOUBLE AS sum_y FROM c WHERE k < 3
UNION ALL SELECT conv_id, turn, '', 1, 4.5 FROM c WHERE k = 1""")
def llm_malformed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose list of series holds other things too; what is a series counts."""
    good = """concat('{"label":"good","x":[1,2],"y":[', length(text), ',"', conv_id, '"]}')"""
    others = """case turn % 4 when 0 then '7,null,"text",{}' when 1 then '{"x":[3],"y":["4.5"]},{"label":"z","x":[1],"y":["many"]}' when 2 then '{"label":"z","x":[1,2],"y":[1]},[1],{"y":[1]}' end"""
    reply = F.expr(f"""case when turn % 4 = 3 then '{{"series":{{"label":"good","x":[1],"y":[1]}}}}' else concat('{{"series":[', {others}, ',', {good}, ']}}') end""")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(responses.parsed_series(reply)).alias("s"))
    return found.select("conv_id", "turn", "s.label", F.size("s.x").alias("n_points"), F.aggregate("s.y", F.lit(0.0), lambda a, v: a + v).alias("sum_y"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT (p_partkey // 200)::VARCHAR AS figure_id, '0:s' AS curve_id, count(*) AS n, sum(p_size)::DOUBLE AS total FROM part GROUP BY 1")
def model_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged-in model: its curve is the task's payload, the parts of 200 keys; more parts make more tasks."""
    tasks = table(spark, sf_dir, "part").groupBy(F.expr("cast(p_partkey div 200 as string)").alias("figure_id")).agg(F.collect_list("p_size").alias("sizes"))
    found = ports.run_model(tasks, lambda task: [("s", list(range(len(task["sizes"]))), list(task["sizes"]))])
    return found.groupBy("figure_id", "curve_id").agg(F.count("*").alias("n"), F.sum("y").alias("total"))


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A task for each user, whose payload is what a model should read from the image; and the true curves."""
    pts = views.points(spark, sf_dir)
    point = F.when(F.col("role") == "pred", F.struct("ord", "x", "y"))
    by_curve = pts.groupBy("figure_id", "curve_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    series = F.struct(F.col("curve_id").alias("label"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    payload = F.array_sort(F.collect_list(F.when(F.size("p") > 0, series)))
    return by_curve.groupBy("figure_id").agg(payload.alias("series")), pts.where("role = 'gt'").drop("role")


def _reads(task: dict) -> list[tuple[str, list[float], list[float]]]:
    if int(task["figure_id"]) % 7 == 0:
        raise TimeoutError(f"figure {task['figure_id']}")
    return [(s["label"], s["x"], s["y"]) for s in task["series"]]


_EVALUATED = f"""{_FULL}, ev AS (SELECT sc.*, figure_id::BIGINT % 7 = 0 AS failed FROM sc WHERE figure_id IN (SELECT figure_id FROM pts))
SELECT figure_id, CASE WHEN failed THEN 0.0 ELSE round(match_rate, 6) END AS match_rate, CASE WHEN failed THEN 0.0 ELSE round(summary_score, 6) END AS summary_score, CASE WHEN failed THEN 'TimeoutError: figure ' || figure_id END AS error FROM ev"""


@query(_EVALUATED)
def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that raises for every seventh figure, from tasks to scores."""
    tasks, truth = _tasks(spark, sf_dir)
    return rounded(ports.evaluate(tasks, truth, _reads).select("figure_id", "match_rate", "summary_score", "error"), "match_rate", "summary_score")


def _answers(model: str, image: bytes | None, text: str) -> str:
    said = json.loads(image)
    if int(said["figure_id"]) % 7 == 0:
        raise TimeoutError(f"figure {said['figure_id']}")
    assert model == "reader" and text.startswith("Read every data series")
    return "```json\n" + json.dumps({"series": [7, {"label": "broken"}, *said["series"]]}) + "\n```"


@query(_EVALUATED)
def evaluate_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client that sees the image, answers with broken entries too and fails for every seventh figure, from tasks to scores."""
    tasks, truth = _tasks(spark, sf_dir)
    asked = tasks.select("figure_id", F.to_json(F.struct("figure_id", "series")).cast("binary").alias("image"), *(F.lit(v).alias(c) for c, v in (("x_lo", 0), ("x_hi", 1), ("x_scale", "linear"), ("y_lo", 0), ("y_hi", 1))))
    return rounded(ports.evaluate_llm(asked, truth, _answers, "reader").select("figure_id", "match_rate", "summary_score", "error"), "match_rate", "summary_score")
