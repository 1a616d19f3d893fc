"""Works looked up by id, as a data source of Spark: a partition for each batch of ids."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from curvemill.sources.remote import BATCH, Transport, works_url

FOUND, UNKNOWN, FAILED = "found", "unknown", "failed"
_ADDRESS = "https://doi.org/"


@dataclass
class Batch(InputPartition):
    dois: tuple[str, ...]


class WorksReader(DataSourceReader):
    """Rows (doi, status, work, error) of the ids asked for; work is what the service says of one, as JSON."""

    def __init__(self, options: dict, transport: Transport | None):
        self.base, self.mailto = options.get("base", ""), options.get("mailto")
        self.size = int(options.get("batch", BATCH))
        self.dois = set(json.loads(options["dois"])) if "dois" in options else None
        if transport is None:
            module, _, name = options["transport"].partition(":")
            transport = getattr(import_module(module), name)
        self.transport = transport

    def partitions(self) -> list[Batch]:
        if self.dois is None:
            raise ValueError("say which ids to look up: the option dois, or a filter on doi")
        every = sorted(d for d in self.dois if d)
        return [Batch(tuple(every[i : i + self.size])) for i in range(0, len(every), self.size)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        try:
            answer = json.loads(self.transport(works_url(self.base, list(partition.dois), self.mailto)))
            works = {(w.get("doi") or "").removeprefix(_ADDRESS).lower(): w for w in answer.get("results", [])}
        except (OSError, ValueError) as e:  # the network, or no JSON: these ids can be asked for again
            for doi in partition.dois:
                yield doi, FAILED, None, f"{type(e).__name__}: {e}"
            return
        for doi in partition.dois:
            work = works.get(doi.lower())
            yield (doi, FOUND, json.dumps(work, ensure_ascii=False), None) if work else (doi, UNKNOWN, None, None)


class AskedReader(WorksReader):
    """Looks up the ids that the query's filters on doi name. Spark has to be told to hand filters on (spark.sql.python.filterPushdown.enabled), and remembers them with the loaded table: load it anew for each query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids that a query asks for are the ids that are looked up."""
        for one in filters:
            wanted = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if wanted is None or one.attribute != ("doi",):
                yield one
            else:
                self.dois = wanted if self.dois is None else self.dois & wanted


def _reader(options: dict, transport: Transport | None) -> WorksReader:
    return (WorksReader if "dois" in options else AskedReader)(options, transport)


class WorksSource(DataSource):
    """spark.read.format("works"): options base, dois (a JSON list; without it the filters say which), batch (ids of a request), mailto and transport ("module:function", from address to bytes)."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "doi string, status string, work string, error string"

    def reader(self, schema: object) -> WorksReader:
        return _reader(dict(self.options), None)


def source_with(transport: Transport, name: str = "works") -> type[WorksSource]:
    """The source with a transport of one's own, to be registered."""

    class Source(WorksSource):
        @classmethod
        def name(cls) -> str:
            return name

        def reader(self, schema: object) -> WorksReader:
            return _reader(dict(self.options), transport)

    return Source
