"""Mixing sources to target weights along a curriculum.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating; all targets together are 150% of all words; no
target is over twice its source, and the excess goes to the others by weight. That is a water level: the target is
min(2 * size, level * weight), with one level for which the targets sum up.

Order inside a source is by md5 of the doc_id. A source's words lie on one line in that order, once more after its end
for a second pass; a document belongs to a pass if its middle lies before the target. The line is a distributed prefix
sum: sizes are summed by the first three hex digits (4096 ranges a source), accumulated over those sums, and inside a
range over its own documents, so that no task holds a source. Only sums by source (and by source and range, to
accumulate them) are ever in one task.

Curriculum: a source's weight over training time t in [0, 1] is 1 - tilt + 2 * tilt * t times its target; its integral
target * ((1 - tilt) * t + tilt * t * t) is its cumulative demand, and inverting that at the place of a document's
middle gives the position of each pass. A pass is taken if its position lies before the end of training, at 1.

Defined cases: null text has size 0; documents of size 0 are never taken; a null source is a source; a null doc_id
sorts by the md5 of the empty text; repeated rows are taken one by one; an empty table gives an empty table; other
columns stay whatever their names.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paperloom.llm import textbytes as tb
from paperloom.llm.store import bounded, named, numbered, saved

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: By weight: how the source's weight moves over training; -1 (fades to nothing) to 1 (starts from nothing).
TILTS = {5: -0.5, 2: 0.0, 1: 0.5}


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    return pa.array(tb.count_words(text), pa.int64())


def targets(sized: DataFrame) -> DataFrame:
    """(source, size) rows -> a row for each source: source, weight, tilt, source_size, target. Works on sums by source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = lambda of: F.element_at(F.array(*[F.lit(of(w)) for w in WEIGHTS]), F.col("nth") % len(WEIGHTS) + 1)
    by = by.withColumn("nth", nth).withColumn("weight", weigh(lambda w: w)).withColumn("tilt", weigh(TILTS.get)).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (SHARE * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    by = by.withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight")).withColumn("place", F.row_number().over(up))
    level = F.min_by("level", F.when(F.col("fits"), F.col("place"))).over(Window.partitionBy())
    return by.select("source", "weight", "tilt", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _placed(docs: DataFrame) -> DataFrame:
    """numbered(docs) plus size, source_size, target and positions (of each pass taken, ascending)."""
    plain, c = numbered(docs)
    doc_id = F.col(c["doc_id"])
    rows = plain.withColumn("size", word_count(F.col(c["text"]).cast("string"))).withColumn("source", F.col(c["source"]).cast("string"))
    rows = rows.withColumn("key", F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))).withColumn("range", F.substring("key", 1, 3))
    sums = saved(rows.groupBy("source", "range").agg(F.sum("size").alias("size")), "sizes")
    target = saved(targets(sums.select("source", "size")), "targets").withColumnRenamed("source", "s")
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    table = sums.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(bounded(target), F.expr("source <=> s"))
    table = table.select("s", F.col("range").alias("r"), "ahead", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "range").orderBy("key", doc_id, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("upto", F.sum("size").over(within)).join(bounded(saved(table, "ranges")), F.expr("source <=> s and range = r"))
    middle = F.col("ahead") + F.col("upto") - F.col("size") / 2
    tilt, flat = F.col("tilt"), 1 - F.col("tilt")
    # where the cumulative demand of the source reaches a word's place; beyond the whole demand the place itself, past 1
    share = lambda m: m / F.nullif(F.col("target"), F.lit(0.0))
    invert = lambda m: F.when((tilt == 0) | (share(m) >= 1), share(m)).otherwise((F.sqrt(flat * flat + 4 * tilt * share(m)) - flat) / (2 * tilt))
    passes = F.transform(F.array(*[middle + k * F.col("source_size") for k in range(MOST)]), invert)
    positions = F.when(F.col("size") > 0, F.filter(passes, lambda t: t < 1)).otherwise(F.array().cast("array<double>"))
    return out.withColumn("positions", positions)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and positions (of each pass taken, ascending), for each row."""
    c = numbered(docs)[1]
    taken = (F.size("positions") * F.col("size")).alias("taken")
    return _placed(docs).select(F.col(c["doc_id"]).alias("doc_id"), "source", "size", "source_size", "target", taken, "positions")


def curriculum(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, a row for each pass; the columns of docs."""
    doc_id = numbered(docs)[1]["doc_id"]
    out = _placed(docs).withColumn("position", F.explode("positions"))
    return out.repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id).select(*named(docs))
