"""Vector arithmetic on array<double> Columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def safe_cosine(product: Column, norms: Column) -> Column:
    """From an inner product and the product of both norms; 0 where there is no number."""
    c = product / (norms + F.lit(1e-12))
    return F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)


def cosine(a: Column, b: Column) -> Column:
    return safe_cosine(dot(a, b), norm(a) * norm(b))


def mean_vector(df: DataFrame, key: str, vector: str, out: str) -> DataFrame:
    """Element-wise mean by key, not normalised: long form, so that a group of any size is only partial sums."""
    long = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(out))
