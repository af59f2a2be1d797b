"""A paged search service as a Spark data source.

    spark.dataSource.register(Portal)
    spark.read.format("portal").option("url", ...).load()

The first page tells how many there are; each page is a partition, so a lost
one is fetched again by itself."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Languages that the service names, and their codes; others by their first two letters.
CODES = {"english": "en", "french": "fr", "spanish": "es", "arabic": "ar", "chinese": "zh", "russian": "ru", "german": "de", "portuguese": "pt"}


def page(url: str, start: int, size: int) -> dict:
    body = json.dumps({"from": start, "size": size, "search": "", "filter": {"country": []}}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=30) as answer:
        return json.loads(answer.read())


def row(hit: dict, detail: str = "") -> tuple | None:
    """A public report, with the address of its own page under detail; null for others."""
    source = hit["_source"]
    if source.get("access") != "public":
        return None
    language = (source.get("language") or "english").lower()
    year = source.get("year")
    return str(source["id"]), source["country"]["iso"], source["country"]["name"], int(year) if year else None, CODES.get(language, language[:2]), "un", f"{detail}{source['id']}"


class Portal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "report_id string, country_iso3 string, country string, year int, language string, type string, source_url string"

    def reader(self, schema) -> DataSourceReader:
        url = self.options["url"]
        return _Reader(url, int(self.options.get("size", 100)), self.options.get("detail", f"{url.rstrip('/')}/report/detail/"))


class _Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


class _Reader(DataSourceReader):
    def __init__(self, url: str, size: int, detail: str):
        self.url, self.size, self.detail = url, size, detail

    def partitions(self) -> list[InputPartition]:
        total = page(self.url, 0, 1).get("total", 0)
        n = total.get("value", 0) if isinstance(total, dict) else int(total or 0)
        return [_Page(i) for i in range(0, n, self.size)] or [_Page(0)]

    def read(self, partition: _Page):
        for hit in page(self.url, partition.start, self.size).get("hits", []):
            if found := row(hit, self.detail):
                yield found
