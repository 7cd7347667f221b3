"""Whether an interest's fit is of the seeds that it has now, and which runs a restart has to close."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale_fits(fits: DataFrame, fitted: DataFrame, seeds: DataFrame) -> DataFrame:
    """fits (profile, is_draft, recorded, n_matrix), fitted and seeds (profile, paper_id) -> profile, stale, added, removed.

    A fit that recorded its seeds is stale if they are others than now; an older one, which did not, if it embedded another
    number than there are now, or tells none. Drafts are never stale. Rows are counted by profile, never collected; repeats
    count once."""
    both = fitted.distinct().withColumn("was", F.lit(1)).join(seeds.distinct().withColumn("is", F.lit(1)), ["profile", "paper_id"], "full_outer")
    n = both.groupBy("profile").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"), F.count("is").alias("now"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = fits.join(n, "profile", "left")
    changed = zero(F.col("added")) + zero(F.col("removed")) > 0
    legacy = F.col("n_matrix").isNull() | (F.col("n_matrix") != zero(F.col("now")))
    stale = ~F.coalesce("is_draft", F.lit(False)) & F.when(F.col("recorded"), changed).otherwise(legacy)
    return out.select("profile", stale.alias("stale"), zero(F.col("added")).alias("added"), zero(F.col("removed")).alias("removed"))


def closed(runs: DataFrame, now: Column, error: str) -> DataFrame:
    """runs (run, profile, kind, started, finished, error) with every open one finished now with an error."""
    is_open = F.col("finished").isNull()
    return runs.withColumn("error", F.when(is_open, F.lit(error)).otherwise(F.col("error"))).withColumn("finished", F.coalesce("finished", now))


def to_rescan(runs: DataFrame, not_scans: list[str]) -> DataFrame:
    """The profiles with an open run that is a scan: no kind of `not_scans`; a null kind is one. To be asked before closed()."""
    scan = ~F.coalesce(F.col("kind"), F.lit("")).isin(not_scans)
    return runs.where(F.col("finished").isNull() & F.col("profile").isNotNull() & scan).select("profile").distinct()
