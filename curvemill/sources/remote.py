"""What comes over a network, behind injected transports: license lookups in batches, and PDF downloads.

A transport is a function from an address to bytes. Each batch or download is a row of its own, so tasks share them;
nothing here opens a connection by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.operators.tables import chunks, insert_absent, not_yet_done
from curvemill.sources.files import works
from curvemill.sources.snapshots import Snapshots
from curvemill.staging import settled

Transport = Callable[[str], bytes]
BATCH = 40
OK, NO_URL, NOT_PDF, HTTP_ERROR, CONNECTION_ERROR = "ok", "no_pdf_url", "not_a_pdf", "http_error", "connection_error"


def works_url(base: str, dois: list[str], mailto: str | None = None) -> str:
    """Address that asks for several works at once."""
    query = {"filter": "doi:" + "|".join(dois), "per-page": str(len(dois))} | ({"mailto": mailto} if mailto else {})
    return f"{base}?{urlencode(query)}"


def lookups(dois: DataFrame, transport: Transport, base: str, mailto: str | None = None) -> DataFrame:
    """A row for each batch of dois (doi): its ids, and the response body or the error, for which its ids stay unresolved."""
    batches = chunks(dois.select("doi").distinct(), "doi", BATCH).groupBy("batch").agg(F.sort_array(F.collect_list("doi")).alias("dois"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for batch, ids in zip(frame["batch"], frame["dois"], strict=True):
                try:
                    out.append((batch, list(ids), transport(works_url(base, list(ids), mailto)).decode(), None))
                except OSError as e:
                    out.append((batch, list(ids), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["batch", "dois", "body", "error"])

    return batches.mapInPandas(ask, "batch long, dois array<string>, body string, error string")


#: Rows of a kept table of licenses.
CACHE = "doi string, is_oa boolean, license_id string, pdf_url string"


def looked_up(dois: DataFrame, cache: Snapshots, transport: Transport, base: str, mailto: str | None = None) -> DataFrame:
    """Licenses of dois (doi), lower-case, from a kept table, which gets those that it doesn't have yet.

    Ids that an answer doesn't hold are kept as unknown and not asked for again; those of a batch that failed are, in the
    next run. A run that breaks off keeps nothing, and asks again.
    """
    asked = dois.select(F.lower("doi").alias("doi")).where("doi <> ''").distinct()
    answers = settled(lookups(not_yet_done(asked, cache.read(), ["doi"]), transport, base, mailto))
    if answers.where("error is null").isEmpty():
        return cache.read().join(asked, "doi", "left_semi")
    found = works(answers).withColumn("doi", F.lower("doi")).dropDuplicates(["doi"])
    ids = answers.where("error is null").select(F.explode("dois").alias("doi"))
    cache.commit(cache.batch() + 1, ids.join(found, "doi", "left"))
    return cache.read().join(asked, "doi", "left_semi")


def pdf_urls(dois: DataFrame, transport: Transport, base: str, mailto: str | None = None) -> DataFrame:
    """Where the PDF of each of dois (doi) is, null if nobody says."""
    answers = settled(lookups(dois.select(F.lower("doi").alias("doi")), transport, base, mailto))
    found = works(answers).select(F.lower("doi").alias("found"), "pdf_url").dropDuplicates(["found"])
    return dois.select("doi").distinct().join(found, F.lower("doi") == F.col("found"), "left").drop("found")


def with_cache(cache: DataFrame, found: DataFrame, asked: DataFrame) -> DataFrame:
    """cache with found, and asked ids that no answer had, so that they are not asked again."""
    both = insert_absent(cache, found.dropDuplicates(["doi"]), ["doi"])
    unknown = asked.select("doi").distinct().join(both.select("doi"), "doi", "left_anti")
    return both.unionByName(unknown, allowMissingColumns=True)


def fetched_pdfs(rows: DataFrame, transport: Transport) -> DataFrame:
    """rows (id, pdf_url) to (id, status, content, detail): five outcomes, of which only "ok" has content."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, url in zip(frame["id"], frame["pdf_url"], strict=True):
                if not isinstance(url, str) or not url.strip():
                    out.append((key, NO_URL, None, None))
                    continue
                try:
                    content = transport(url)
                except HTTPError as e:  # before OSError, which it is one of
                    out.append((key, HTTP_ERROR, None, f"HTTP {e.code}"))
                except OSError as e:
                    out.append((key, CONNECTION_ERROR, None, str(e)))
                else:
                    good = content.lstrip().startswith(b"%PDF")
                    out.append((key, OK if good else NOT_PDF, content if good else None, None))
            yield pd.DataFrame(out, columns=["id", "status", "content", "detail"])

    return rows.select(F.col("id").cast("string").alias("id"), "pdf_url").mapInPandas(fetch, "id string, status string, content binary, detail string")


#: An image's bytes, width and height, or a function that reads them from the document.
Image = tuple[bytes, int, int] | Callable[[], tuple[bytes, int, int]]


def extracted_images(pdfs: DataFrame, pages: Callable[[bytes], Iterator[tuple[int, list[Image], Image]]], least_pixels: int = 22500) -> DataFrame:
    """Images of PDFs (id, content) by an injected reader of pages: number, embedded images, the page's render (each bytes, width, height, or a function that gives them).

    Embedded images of at least least_pixels count; one whose function raises is left out, and only that one. A page
    without any gives its render. An unreadable document gives a row with the error.
    """

    def readable(images: Iterable[Image]) -> Iterator[tuple[bytes, int, int]]:
        for image in images:
            try:
                yield image() if callable(image) else image
            except Exception:  # noqa: S112 - a damaged image is no reason to lose the others
                continue

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, content in zip(frame["id"], frame["content"], strict=True):
                try:
                    for number, embedded, render in pages(bytes(content)):
                        large = [x for x in readable(embedded) if x[1] * x[2] >= least_pixels]
                        out += [(key, number, "embedded" if large else "page_render", *image, None) for image in large or [render() if callable(render) else render]]
                except Exception as e:  # any reader's failure concerns this document alone
                    out.append((key, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "page", "source", "image", "width", "height", "error"]).astype({"page": "Int32", "width": "Int32", "height": "Int32"})

    return pdfs.select("id", "content").mapInPandas(extract, "id string, page int, source string, image binary, width int, height int, error string")
