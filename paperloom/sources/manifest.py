"""CSV manifests of a user's papers, resolved against known works."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T

COLUMNS = ("doi", "title", "year", "path", "abstract")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files, each of COLUMNS optional, all as text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    there = {c.strip().lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{there[c]}`") if c in there else F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def _clean(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def from_manifest(rows: DataFrame, works: DataFrame) -> DataFrame:
    """rows (COLUMNS) as papers, with what works (work, doi, title, year, abstract) know of them: found by DOI, else by
    title and year. A row's own DOI and abstract stand in where the work has none; what nobody knows stays as `user_csv`."""
    r = rows.select(F.monotonically_increasing_id().alias("row"), _clean("doi").alias("doi"), _clean("title").alias("title"), F.expr("try_cast(trim(year) as int)").alias("year"), _clean("path").alias("path"), _clean("abstract").alias("abstract"))
    r = r.withColumn("dk", T.doi_key(F.col("doi"))).withColumn("tk", F.nullif(T.normalize_title(F.coalesce("title", F.lit(""))), F.lit("")))
    known = F.struct("work", F.col("doi").alias("w_doi"), F.col("title").alias("w_title"), F.col("year").alias("w_year"), F.col("abstract").alias("w_abstract"))
    by_doi = works.groupBy(T.doi_key(F.col("doi")).alias("dk")).agg(F.min_by(known, "work").alias("a")).where("dk is not null")
    by_title = works.groupBy(T.normalize_title(F.col("title")).alias("tk"), F.col("year").alias("ty")).agg(F.min_by(known, "work").alias("b"))
    any_year = works.groupBy(T.normalize_title(F.col("title")).alias("tk")).agg(F.min_by(known, "work").alias("c"))
    j = r.join(by_doi, "dk", "left").join(by_title, (r["tk"] == by_title["tk"]) & (r["year"] == F.col("ty")), "left").drop(by_title["tk"])
    j = j.join(any_year, "tk", "left")
    w = F.coalesce("a", "b", F.when(F.col("year").isNull(), F.col("c")))
    j = j.withColumn("w", w)
    found = F.col("w").isNotNull()
    pick = lambda work, own: F.when(found, F.coalesce(F.nullif(work, F.lit("")), own)).otherwise(own)
    return j.select(
        "row",
        "w.work",
        pick(F.col("w.w_doi"), F.col("doi")).alias("doi"),
        F.coalesce(F.when(found, F.col("w.w_title")).otherwise(F.col("title")), F.lit("")).alias("title"),
        F.when(found, F.col("w.w_year")).otherwise(F.col("year")).alias("year"),
        F.coalesce(pick(F.col("w.w_abstract"), F.col("abstract")), F.lit("")).alias("abstract"),
        "path",
        F.when(found, "openalex").otherwise("user_csv").alias("source"),
    )
