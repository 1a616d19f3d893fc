"""Chart-curve analytics on Spark: ingest, license gating, curve comparison, assignment, scoring, ranking, panel and colour segmentation."""

__version__ = "0.1.0"
