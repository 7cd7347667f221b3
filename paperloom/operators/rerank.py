"""The second stage and its relatives: queries against articles, batch blends, and scores out of chunks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import dot, mean_vector, norm
from paperloom.operators.pool import ALPHA, BETA
from paperloom.operators.ranking import placed, share

#: Chunks whose best similarities are averaged, share of the pooled score, queries of a profile.
TOP_CHUNKS, POOLED, MOST_QUERIES = 3, 0.5, 30


def aggregated(logits: DataFrame, how: str = "max") -> DataFrame:
    """logits (profile, paper_id, query_no, logit) of every query and article -> logit and the first best query of each."""
    by = logits.groupBy("profile", "paper_id")
    value = F.max("logit") if how == "max" else F.avg("logit")
    return by.agg(value.alias("logit"), F.max_by("query_no", F.struct("logit", -F.col("query_no"))).alias("best_query"), F.count("*").alias("queries"))


def batch_blend(rows: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """rows (profile, batch, paper_id, score_raw, logit) with both scores brought to [0, 1] over the batch, blended, and the
    percentile within the batch. A flat batch has span 1."""
    s = rows.groupBy("profile", "batch").agg(F.min("score_raw").alias("s0"), F.max("score_raw").alias("s1"), F.min("logit").alias("r0"), F.max("logit").alias("r1"))
    span = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0)
    out = rows.join(s, ["profile", "batch"])
    out = out.withColumn("sel_norm", (F.col("score_raw") - F.col("s0")) / span("s0", "s1")).withColumn("rr_norm", (F.col("logit") - F.col("r0")) / span("r0", "r1"))
    out = out.withColumn("blended", alpha * F.col("sel_norm") + beta * F.col("rr_norm")).drop("s0", "s1", "r0", "r1")
    out = placed(out, ["profile", "batch"], F.round("blended", 9).desc(), F.col("paper_id").asc())
    return out.withColumn("pct", share(F.col("place"), F.col("members"))).drop("place", "members")


def unit_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("u", F.transform("v", lambda x: x / (norm(F.col("v")) + 1e-12)))


def chunk_weights(seeds: DataFrame) -> DataFrame:
    """Seed chunks (profile, paper_id, chunk_id, v) with u and weight: 1 less the best cosine to a chunk of another paper of
    the profile, within [0, 1]; all 1 where these come to nothing. Seeds are few, so are their pairs."""
    u = unit_chunks(seeds)
    other = u.select("profile", F.col("paper_id").alias("p2"), F.col("u").alias("w"))
    best = u.join(other, "profile").where("p2 <> paper_id").groupBy("profile", "chunk_id").agg(F.max(dot(F.col("u"), F.col("w"))).alias("best"))
    out = u.join(best, ["profile", "chunk_id"], "left")
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("best", F.lit(0.0))))
    total = F.sum(raw).over(Window.partitionBy("profile"))
    return out.withColumn("weight", F.when(total < 1e-9, 1.0).otherwise(raw)).drop("best")


def full_text_scores(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """candidates (profile, paper_id, chunk_id, v) -> pooled, maxsim, score and n_chunks of each paper: its mean chunk
    against the weighted centroid of the seeds' chunks, and the mean of its chunks' three best similarities to any."""
    w = chunk_weights(seeds)
    centre = mean_vector(w.withColumn("wu", F.transform("u", lambda x: x * F.col("weight"))), "profile", "wu", "c")
    every = w.groupBy("profile").agg(F.collect_list("u").alias("seeds"))
    u = unit_chunks(candidates)
    near = u.join(every, "profile").select("profile", "paper_id", F.array_max(F.transform("seeds", lambda s: dot(F.col("u"), s))).alias("m"))
    top = near.groupBy("profile", "paper_id").agg(F.slice(F.sort_array(F.collect_list("m"), False), 1, TOP_CHUNKS).alias("t"), F.count("*").alias("n_chunks"))
    maxsim = top.select("profile", "paper_id", "n_chunks", (F.aggregate("t", F.lit(0.0), lambda s, x: s + x) / F.size("t")).alias("maxsim"))
    keyed = u.withColumn("k", F.struct("profile", "paper_id"))
    mean = mean_vector(keyed, "k", "u", "m").select("k.*", "m").join(centre, "profile")
    pooled = mean.select("profile", "paper_id", (dot(F.col("m"), F.col("c")) / ((norm(F.col("m")) + 1e-12) * (norm(F.col("c")) + 1e-12))).alias("pooled"))
    out = pooled.join(maxsim, ["profile", "paper_id"])
    return out.withColumn("score", POOLED * F.col("pooled") + (1 - POOLED) * F.col("maxsim"))
