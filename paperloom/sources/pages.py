"""A paged web source as a data source of Spark: `spark.read.format("pages")`, and the same as a stream.

A service answers url?filter=..&per-page=..&page=n with {"meta": {"count": n}, "results": [..]}. The first page tells how many
there are; each further page is a partition that its task fetches. Pages end at the count, at the limit, at a short page
and at what the service lets one page through (most). Equality and comparison conditions on the columns that the service
can filter by (the option filters) are sent along, and Spark need not look at them again.

Options: url, columns (the schema), perpage (200), limit, sort, most (10,000), filters (columns, comma-separated), filter."""

import json
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader

PER_PAGE, MOST = 200, 10_000


def fetched(options: dict, page: int, conditions: list[str]) -> dict:
    asked = {"per-page": int(options.get("perpage", PER_PAGE)), "page": page}
    said = [c for c in (options.get("filter"), *conditions) if c]
    if said:
        asked["filter"] = ",".join(said)
    if options.get("sort"):
        asked["sort"] = options["sort"]
    with urllib.request.urlopen(f"{options['url']}?{urllib.parse.urlencode(asked)}", timeout=60) as answer:
        return json.load(answer)


class Page(InputPartition):
    def __init__(self, number: int, rows: int):
        super().__init__(number)
        self.number, self.rows = number, rows


def pages_of(options: dict, conditions: list[str]) -> list[Page]:
    """Each page with how many of its rows count: up to the limit, the service's count and its last page."""
    size, most = int(options.get("perpage", PER_PAGE)), int(options.get("most", MOST))
    first = fetched(options, 1, conditions)
    there = len(first.get("results") or [])
    count = (first.get("meta") or {}).get("count")
    if there < size:
        count = there
    elif count is None:
        # without a count the pages are asked for one by one until a short one
        count, page = there, 2
        while page * size <= most:
            n = len(fetched(options, page, conditions).get("results") or [])
            count, page = count + n, page + 1
            if n < size:
                break
    wanted = min(count, most // size * size)
    if options.get("limit") is not None:
        wanted = min(wanted, max(0, int(options["limit"])))
    return [Page(n + 1, min(size, wanted - n * size)) for n in range(-(-wanted // size))]


class PagesReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.conditions = options, names, []

    def pushFilters(self, filters):
        can = {c.strip() for c in self.options.get("filters", "").split(",") if c.strip()}
        for f in filters:
            sign = {EqualTo: "", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}.get(type(f))
            if sign is not None and len(f.attribute) == 1 and f.attribute[0] in can and "," not in str(f.value):
                self.conditions.append(f"{f.attribute[0]}:{sign}{f.value}")
            else:
                yield f

    def partitions(self):
        return pages_of(self.options, self.conditions) or [Page(1, 0)]

    def read(self, partition: Page):
        rows = (fetched(self.options, partition.number, self.conditions).get("results") or [])[: partition.rows] if partition.rows else []
        for r in rows:
            yield tuple(r.get(n) for n in self.names)


class PagesStream(SimpleDataSourceStreamReader):
    """New results of a growing answer, whose order must not change (option sort): the offset is how many were read."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def initialOffset(self):
        return {"read": 0}

    def _rows(self, start: int, end: int | None):
        size, most, out = int(self.options.get("perpage", PER_PAGE)), int(self.options.get("most", MOST)), []
        page = start // size + 1
        while page * size <= most and (end is None or (page - 1) * size < end):
            got = fetched(self.options, page, []).get("results") or []
            out += [tuple(r.get(n) for n in self.names) for i, r in enumerate(got, (page - 1) * size) if i >= start and (end is None or i < end)]
            page += 1
            if len(got) < size:
                break
        return out

    def read(self, start: dict):
        rows = self._rows(start["read"], None)
        return iter(rows), {"read": start["read"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start["read"], end["read"]))


class PagesSource(DataSource):
    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        return PagesReader(dict(self.options), schema.names)

    def simpleStreamReader(self, schema):
        return PagesStream(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push conditions into it."""
    spark.dataSource.register(PagesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
