"""Scores over a profile's whole pool: selector and reranker brought to one scale, blended and ranked."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.ranking import placed, quantiles, share

ALPHA, BETA = 0.4, 0.6


def rescored(pool: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """pool (profile, paper_id, score_raw, logit) plus sel_norm, rr_norm, blended, pct.

    A flat pool has span 1. A missing logit counts as the median of the normalised logits, and without any logit the
    selector ranks alone. Statistics are aggregated by profile and joined back; median and percentile are read off ranges.
    """
    stats = pool.groupBy("profile").agg(F.min("score_raw").alias("s0"), F.max("score_raw").alias("s1"), F.min("logit").alias("r0"), F.max("logit").alias("r1")).join(quantiles(pool, ["profile"], "logit", {"rm": 0.5}).drop("members"), "profile", "left")
    span = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0)
    out = pool.join(stats, "profile").withColumn("sel_norm", F.coalesce((F.col("score_raw") - F.col("s0")) / span("s0", "s1"), F.lit(0.0)))
    out = out.withColumn("rr_norm", (F.col("logit") - F.col("r0")) / span("r0", "r1"))
    out = out.withColumn("blended", alpha * F.col("sel_norm") + beta * F.coalesce("rr_norm", (F.col("rm") - F.col("r0")) / span("r0", "r1")))
    out = placed(out.drop("s0", "s1", "r0", "r1", "rm"), ["profile"], F.round(F.coalesce("blended", "sel_norm"), 9).desc(), F.col("paper_id").asc())
    return out.withColumn("pct", share(F.col("place"), F.col("members"))).drop("place", "members")


def rescored_members(rows: DataFrame, member: str, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """rows with the scores of rescored() over the rows where `member` is true, and nulls in the others."""
    pool = rescored(rows.where(member), alpha, beta)
    return pool.unionByName(rows.where(~F.coalesce(F.col(member), F.lit(False))), allowMissingColumns=True)


def rank_changes(pool: DataFrame) -> DataFrame:
    """Ranks by selector and by blend, and how far each row moved (positive: up)."""
    by = lambda df, c, name: placed(df, ["profile"], F.round(c, 9).desc(), F.col("paper_id").asc()).withColumn(name, F.col("place") + 1).drop("place", "members")
    return by(by(pool, "score_raw", "old_rank"), "blended", "new_rank").withColumn("moved", F.col("old_rank") - F.col("new_rank"))


def fair_shares(sizes: DataFrame, limit: int) -> DataFrame:
    """(profile, n) -> (profile, n, share): equal shares of `limit`, and what small profiles leave goes to the others.

    Water filling: with profiles in order of size, the level at a profile is what the smaller ones leave, divided by the
    profiles from it on; those above the level share it, and the remainder goes one each to the first of them.
    """
    up = Window.orderBy("n", "profile")
    total = sizes.where("n > 0").withColumn("i", F.row_number().over(up)).withColumn("before", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rest", F.count("*").over(Window.partitionBy()) - F.col("i") + 1)
    total = total.withColumn("level", F.floor((limit - F.col("before")) / F.col("rest"))).withColumn("over", F.col("n") > F.col("level"))
    first = total.where("over").agg(F.min("i").alias("i0"))
    cut = total.join(F.broadcast(first), F.col("i") == F.col("i0")).select(F.col("level").alias("l"), ((limit - F.col("before")) - F.col("level") * F.col("rest")).alias("extra"), "i0")
    cut = F.broadcast(cut)  # one row at most
    out = total.join(cut, F.lit(True), "left")
    nth = F.row_number().over(Window.partitionBy(F.coalesce(F.col("i") >= F.col("i0"), F.lit(False))).orderBy("profile"))
    return out.withColumn("nth", nth).select("profile", "n", F.when(F.col("i0").isNull() | (F.col("i") < F.col("i0")), F.col("n")).otherwise(F.col("l") + (F.col("nth") <= F.col("extra")).cast("int")).cast("long").alias("share"))
