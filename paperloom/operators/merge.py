"""Upserts, de-duplication and entity resolution as joins and windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """A new snapshot of old with new merged in. Rules by column: new (replaces), keep (old wins), fill (new unless null),
    fill_missing (old unless null), text (new unless null or empty). `is_new` tells rows that old did not have."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in rules], F.lit(True).alias("o_there"))
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in rules], F.lit(True).alias("n_there"))
    pick = {
        "new": lambda a, b: F.when(F.col("n_there"), b).otherwise(a),
        "keep": lambda a, b: F.when(F.col("o_there"), a).otherwise(b),
        "fill": lambda a, b: F.coalesce(b, a),
        "fill_missing": lambda a, b: F.coalesce(a, b),
        "text": lambda a, b: F.coalesce(F.nullif(b, F.lit("")), a),
    }
    out = o.join(n, keys, "full_outer")
    return out.select(*keys, *[pick[r](F.col(f"o_{c}"), F.col(f"n_{c}")).alias(c) for c, r in rules.items()], F.col("o_there").isNull().alias("is_new"))


def first_of(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row by `order` for each key; rows with a null or empty key all stay."""
    lone = key.isNull() | (key == "")
    r = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    keyed = df.where(~lone).withColumn("_key", key).withColumn("_r", r).where("_r = 1").drop("_key", "_r")
    return keyed.unionByName(df.where(lone))


def versions(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Number and count of the copies of one work, for works with several."""
    w = Window.partitionBy(group)
    return df.withColumn("version", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count("*").over(w)).where("copies > 1")


def unused(rows: DataFrame, key: str, *uses: DataFrame) -> DataFrame:
    """Rows that no other table refers to."""
    used = uses[0].select(key)
    for u in uses[1:]:
        used = used.unionByName(u.select(key))
    return rows.join(used, key, "left_anti")


def swapped(rows: DataFrame, draft: DataFrame, key: str) -> DataFrame:
    """rows with those of the keys that draft has taken out and the draft's own put in."""
    return rows.join(draft.select(key).distinct(), key, "left_anti").unionByName(draft)


def opened(rows: DataFrame, key: str, drafts: DataFrame) -> DataFrame:
    """rows and, for each of drafts (key, draft), a copy of the key's rows under the draft: what an edit begins from."""
    copies = rows.join(drafts, key).withColumn(key, F.col("draft")).drop("draft")
    return rows.unionByName(copies)


def version_rank(claimed: Column, doi: Column, abstract: Column, cited: Column) -> Column:
    """What makes a copy the better one: claimed by its author over unknown over not claimed, then a DOI, an abstract, citations."""
    return F.struct(
        F.when(claimed, 2).when(~claimed, 0).otherwise(1).alias("claim"),
        (F.coalesce(doi, F.lit("")) != "").alias("doi"),
        F.coalesce(abstract, F.lit(False)).alias("abstract"),
        F.coalesce(cited.cast("long"), F.lit(0).cast("long")).alias("cited"),
    )


def marked_copies(rows: DataFrame, keys: list[str], place: str, rank: Column) -> DataFrame:
    """rows (paper_id and others) with duplicate_of: the best copy of the same keys by rank, the first by place of equal
    ones; null for that one itself and where a key is null. Best copies are aggregated before the join."""
    best = rows.withColumn("rank", rank).dropna(subset=keys).groupBy(*keys).agg(F.max_by("paper_id", F.struct("rank", -F.col(place))).alias("best"))
    return rows.join(best, keys, "left").withColumn("duplicate_of", F.when(F.col("best") != F.col("paper_id"), F.col("best"))).drop("best")
