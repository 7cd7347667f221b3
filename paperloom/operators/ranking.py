"""Places and quantiles in groups of any size: rows are dealt into ranges of (group, order), never a group into one task.

Spark samples the range borders; the ranges are checkpointed with their number, so that a row's range cannot change. The
rows of each range are counted, those counts accumulated by group (a row for each range of a group), and a row's place is
what lies before its range plus its place inside. Ties beyond the order given are broken arbitrarily."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.resolve import cut


def placed(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """rows with place (from 0, in the order given inside the group) and members (rows of the group)."""
    ranged = cut(rows.repartitionByRange(*group, *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "range").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*group)
    before = F.sum("n").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(of).alias("members"))
    inside = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order)) - 1
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*group, "range")]
    out = ranged.withColumn("inside", inside).alias("r").join(counts.alias("c"), same)
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("c.before") + F.col("r.inside")).alias("place"), F.col("c.members").alias("members"))


def share(place: Column, members: Column) -> Column:
    """1 for the first of a group, 0 for the last, 1 for a lone row."""
    return F.when(members <= 1, 1.0).otherwise((members - 1 - place) / (members - 1))


def order_statistics(rows: DataFrame, group: list[str], value: str, at: dict[str, float], up: Column) -> DataFrame:
    """rows with members, and up, a row's place in ascending order of value -> by group: members and a column for each
    share of `at`, linearly interpolated between the two values around it."""
    position = {k: (F.col("members") - 1) * q for k, q in at.items()}
    ends = [F.max(F.when(up == end(p), F.col(value))).alias(f"{k}_{n}") for k, p in position.items() for n, end in (("lo", F.floor), ("hi", F.ceil))]
    out = rows.groupBy(*group).agg(F.max("members").alias("members"), *ends)
    between = lambda k, p: F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (p - F.floor(p))
    return out.select(*group, "members", *[between(k, p).alias(k) for k, p in position.items()])


def quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the values that are not null; groups without any have no row."""
    some = rows.where(F.col(value).isNotNull()).select(*group, value)
    return order_statistics(placed(some, group, F.col(value).asc()), group, value, at, F.col("place"))
