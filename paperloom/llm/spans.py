"""Spans found in texts: their column type, and counts, digests and listings of them by DataFrame functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column, kinds: list[str]) -> Column:
    return F.sha2(listing(F.filter(spans, lambda s: s["kind"].isin(kinds))), 256)
