"""Writers of manifests, results, images and pages."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.operators.panels import cropped
from curvemill.operators.tables import half_sample
from curvemill.sources import named_files


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, or json with a document on each line."""
    getattr(rows.write.mode("overwrite"), kind)(path)


def result_document(scores: DataFrame, model_id: str, model_name: str, version: str, run_at: str) -> DataFrame:
    """One result row with the figures' scores inside; a data set's figures are what a leaderboard entry lists."""
    figure = F.struct("figure_id", "summary_score", "match_rate", F.col("mean_distance").alias("mean_curve_distance"), F.col("mean_coverage").alias("mean_coverage_ratio"), "error")
    has_error = scores if "error" in scores.columns else scores.withColumn("error", F.lit(None).cast("string"))
    one = has_error.agg(F.count("*").alias("n_figures"), F.avg("summary_score").alias("mean_summary_score"), F.sort_array(F.collect_list(figure)).alias("per_figure"))
    fixed = {"model_id": model_id, "model_name": model_name, "status": "scored", "note": "", "dataset_version": version, "run_at": run_at}
    return one.select(*(F.lit(v).alias(k) for k, v in fixed.items()), "*")


def png(width: int, height: int, grey: bytes) -> bytes:
    """An 8-bit grey PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + grey[i * width : (i + 1) * width] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def panel_images(crops: DataFrame) -> DataFrame:
    """Crops (image_id, label, x, y, lum) as PNG bytes; a panel's pixels are one group."""

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"])
        width, height = int(frame["x"].max()) + 1, int(frame["y"].max()) + 1
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "label": [frame["label"].iloc[0]], "image": [png(width, height, frame["lum"].astype("uint8").to_numpy().tobytes())]})

    return crops.groupBy("image_id", "label").applyInPandas(encode, "image_id string, label string, image binary")


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """rows (name, content) to files of a folder that driver and executors share, all or none of them; with overwrite other files there go."""
    named_files.register(rows.sparkSession)
    rows.select("name", "content").write.format("named_files").mode("overwrite" if overwrite else "append").option("path", folder).save()


def panel_sample(counted: DataFrame, seed: int, n: int) -> DataFrame:
    """Images to look at, of (image_id, n_panels): half of several panels, half of one."""
    return half_sample(counted, "image_id", F.col("n_panels") > 1, seed, n)


def panel_sample_files(images: DataFrame, panels: DataFrame, pixels: DataFrame, seed: int, n: int) -> DataFrame:
    """What write_files needs for a review: of n images (image_id: a path, content) the originals, their panels as PNG, and a manifest."""
    chosen = panel_sample(panels.groupBy("image_id").agg(F.count("*").alias("n_panels")), seed, n)
    part = F.split("image_id", "/")
    paper, file = F.coalesce(F.get(part, F.size(part) - 2), F.lit("")), F.element_at(part, -1)
    stem = F.concat(paper, F.lit("__"), F.regexp_replace(file, r"\.[^.]*$", ""))
    originals = images.join(chosen, "image_id").select(F.concat(F.lit("sample/"), stem, F.lit("__original"), F.regexp_extract(file, r"(\.[^.]*)?$", 0)).alias("name"), "content")
    crops = panel_images(cropped(pixels.join(chosen.select("image_id"), "image_id", "left_semi"), panels))
    cut = crops.select(F.concat(F.lit("sample/"), stem, F.lit("__panel_"), "label", F.lit(".png")).alias("name"), F.col("image").alias("content"))
    entry = F.struct(paper.alias("paper_id"), F.col("image_id").alias("source"), "n_panels")
    listed = chosen.agg(F.to_json(F.sort_array(F.collect_list(entry))).cast("binary").alias("content")).select(F.lit("sample_manifest.json").alias("name"), "content")  # n entries
    return originals.unionByName(cut).unionByName(listed)


def upload(folder: str, token: str | None = None) -> None:
    """Publishing isn't part of this engine; it always refuses."""
    raise PermissionError("an access token is needed to publish") if not token else NotImplementedError(f"publishing {folder} has to be done by hand")
