"""A remote catalogue as a Spark data source: text search and lookup by id, one partition per request.

The transport is a function (url, parameters) -> parsed JSON, given as 'package.module:function', so the workers import it. The
JSON-file transport serves fixtures; an HTTP transport has the same shape.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROW = "query string, item int, id string, trackTitle string, artists array<struct<name:string>>, durationMs bigint, popularity int, href string"


class SourceError(RuntimeError):
    """The catalogue could not be read."""


def json_file_transport(url: str, parameters: dict) -> dict:
    """Serves a JSON file of tracks: those whose title or artist contains the search text, or whose id is asked for."""
    with open(url, encoding="utf-8") as file:
        tracks = json.load(file)
    if "ids" in parameters:
        wanted = set(parameters["ids"].split(","))
        return {"content": [t for t in tracks if t.get("id") in wanted]}
    text = parameters["searchText"].lower()
    hits = [t for t in tracks if text in (t.get("trackTitle") or "").lower() or any(text in (a.get("name") or "").lower() for a in t.get("artists") or [])]
    return {"content": hits[: int(parameters["limit"])]}


class _Request(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.transport = options["url"], options.get("transport", f"{__name__}:json_file_transport")
        self.limit, self.by_id, self.strict = int(options.get("limit", 20)), options.get("mode") == "ids", options.get("strict", "true") == "true"
        self.queries = json.loads(options["queries"])

    def partitions(self) -> list[_Request]:
        if self.by_id:
            return [_Request(",".join(self.queries[i : i + 50])) for i in range(0, len(self.queries), 50)]
        return [_Request(q) for q in self.queries]

    def read(self, partition: _Request) -> Iterator[tuple]:
        module, name = self.transport.split(":")
        parameters = {"ids": partition.query} if self.by_id else {"searchText": partition.query, "limit": self.limit}
        try:
            found = getattr(importlib.import_module(module), name)(self.url, parameters).get("content", [])
        except Exception as e:  # any failure of the transport
            if self.strict:
                raise SourceError(f"catalogue request failed: {partition.query}") from e
            return
        for i, t in enumerate(found):
            artists = [(a.get("name"),) for a in t.get("artists") or []]
            yield (partition.query, i, t.get("id"), t.get("trackTitle"), artists, t.get("durationMs"), t.get("popularity"), t.get("href"))


class CatalogueSource(DataSource):
    """spark.read.format('track_catalogue'): options url, queries (JSON list), limit, mode (search or ids), strict, transport."""

    @classmethod
    def name(cls) -> str:
        return "track_catalogue"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _read(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(CatalogueSource)
    return spark.read.format("track_catalogue").options(**options).load()


def search_catalogue(spark: SparkSession, url: str, queries: list[str], limit: int = 20, strict: bool = True, **options: str) -> DataFrame:
    """Rows (ROW) per query, in the catalogue's order by item. strict=False skips failing queries instead of raising."""
    return _read(spark, url=url, queries=json.dumps(queries), limit=str(limit), strict=str(strict).lower(), **options)


def lookup_catalogue(spark: SparkSession, url: str, ids: list[str], **options: str) -> DataFrame:
    """Rows by id, fifty ids per request; unknown ids give none."""
    return _read(spark, url=url, queries=json.dumps(ids), mode="ids", **options)


def crawl(spark: SparkSession, url: str, keywords: list[str], per_keyword: int = 50, limit: int = 5000, **options: str) -> DataFrame:
    """The first `limit` tracks over all keywords, each id at its first sight, with keyword and position."""
    from trackloom.operators.candidates import first_seen

    found = search_catalogue(spark, url, keywords, per_keyword, strict=False, **options)
    position = F.array_position(F.lit(keywords), F.col("query")).cast("int")
    return first_seen(found.withColumn("keyword_pos", position), "id", ["keyword_pos", "item"]).orderBy("keyword_pos", "item").limit(limit)
