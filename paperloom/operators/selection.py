"""Profiles from seeds, similarity of candidates to them, and the statistics that describe both.

Vectors carry (paper_id, profile, v). Seeds are few for each profile by definition (a person picks them), hence pairs of
one profile's seeds, and joins of candidates with their profile's seeds, grow with the candidates alone.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import bar_floor
from paperloom.functions.vectors import cosine, dot, mean_vector, norm, safe_cosine
from paperloom.operators.ranking import order_statistics, placed, quantiles, share

#: Fixed values of the threshold rule.
MARGIN, LEAST_PCT, MOST_PCT, ALONE_PCT, ENOUGH, FALLBACK = 0.01, 0.75, 0.98, 0.90, 10, 0.90


def seeds_of(vectors: DataFrame, k: Column, most: int) -> DataFrame:
    """The vectors of the k least paper_ids of each profile; k may depend on the profile and is at most `most`.

    Only ids are ranked, of which a task keeps no more than `most` a profile before any shuffle."""
    r = F.row_number().over(Window.partitionBy("profile").orderBy("paper_id"))
    first = vectors.select("profile", "paper_id").withColumn("r", r).where(F.col("r") <= most).where(F.col("r") <= k)
    return vectors.join(first.select("profile", "paper_id"), ["profile", "paper_id"])


def centroids(seeds: DataFrame) -> DataFrame:
    return mean_vector(seeds, "profile", "v", "centroid")


def scored(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """candidates with score (to the centroid), max_seed, median_seed in place of their vectors.

    A profile's seeds, few, lie with their norms in one array beside its centroid, so that a candidate meets them in its
    own row; the join with these rows, one a profile, is broadcast or shuffled by their measured size."""
    own = seeds.groupBy("profile").agg(F.collect_list(F.struct("v", norm(F.col("v")).alias("n"))).alias("seeds"))
    own = own.join(centroids(seeds), "profile")
    at = candidates.join(own, "profile").withColumn("n", norm(F.col("v")))
    sims = F.sort_array(F.transform("seeds", lambda s: safe_cosine(dot(F.col("v"), s["v"]), F.col("n") * s["n"])))
    keep = [c for c in candidates.columns if c != "v"]
    at = at.select(*keep, cosine(F.col("v"), F.col("centroid")).alias("score"), sims.alias("sims"))
    k = F.size("sims")
    middle = (F.element_at("sims", F.floor((k + 1) / 2).cast("int")) + F.element_at("sims", F.floor((k + 2) / 2).cast("int"))) / 2
    return at.select(*keep, "score", F.element_at("sims", -1).alias("max_seed"), middle.alias("median_seed"))


def by_score(scores: DataFrame) -> DataFrame:
    """scores with place and members of the profile's rows from the best to the least, and score_pct; this precedes any
    threshold. Scores count up to nine digits, ties go by paper_id."""
    out = placed(scores, ["profile"], F.round("score", 9).desc(), F.col("paper_id").asc())
    return out.withColumn("score_pct", share(F.col("place"), F.col("members")))


def seed_pairs(seeds: DataFrame) -> DataFrame:
    a, b = seeds.select("profile", F.col("paper_id").alias("a"), F.col("v").alias("av")), seeds.select("profile", F.col("paper_id").alias("b"), F.col("v").alias("bv"))
    return a.join(b, "profile").where("a < b").select("profile", "a", "b", cosine(F.col("av"), F.col("bv")).alias("c"))


def coherence(seeds: DataFrame) -> DataFrame:
    """Median and spread of pairwise cosines, linearly interpolated, the least similar pair, and two peaks with a gap."""
    pairs = seed_pairs(seeds)
    q = F.percentile("c", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    least = F.min(F.struct(F.round("c", 9).alias("c"), "a", "b"))
    return pairs.groupBy("profile").agg(q.alias("q"), F.count("*").alias("pairs"), least.alias("l")).select("profile", "pairs", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.col("l.a").alias("least_a"), F.col("l.b").alias("least_b"))


def two_peaks(pairs: DataFrame, bins: int = 10, least: int = 20, gap: float = 0.1) -> DataFrame:
    """Bimodality over equal bins of the observed range; of equal bins the later counts as taller."""
    of = Window.partitionBy("profile")
    p = pairs.withColumn("lo", F.min("c").over(of)).withColumn("hi", F.max("c").over(of)).withColumn("n", F.count("*").over(of))
    p = p.withColumn("bin", F.least(F.floor((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = p.groupBy("profile", "n", "bin").agg(F.count("*").alias("k"))
    filled = counts.groupBy("profile", "n").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m")).select("profile", "n", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.col("m")[i.cast("long")], F.lit(0))).alias("h"))
    tall = F.slice(F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("k"), i.alias("i"))), False), 1, 2)
    filled = filled.withColumn("t", tall).withColumn("left", F.least(F.col("t")[0]["i"], F.col("t")[1]["i"])).withColumn("right", F.greatest(F.col("t")[0]["i"], F.col("t")[1]["i"]))
    trough = F.array_min(F.slice("h", F.col("left") + 2, F.greatest(F.col("right") - F.col("left") - 1, F.lit(0))))
    peak = F.least(F.col("t")[0]["k"], F.col("t")[1]["k"])
    return filled.select("profile", ((F.col("n") >= least) & (F.col("right") - F.col("left") >= 2) & (peak > 0) & F.coalesce(trough / peak < gap, F.lit(False))).alias("bimodal"))


def seed_band(seeds: DataFrame) -> DataFrame:
    """Leave-one-out cosine of each seed to the mean of the other unit vectors: one sum, less the seed's own part.

    Profiles with fewer than two seeds have no band."""
    unit = seeds.withColumn("u", F.transform("v", lambda x: x / norm(F.col("v"))))
    mean = mean_vector(unit, "profile", "u", "m").join(unit.groupBy("profile").agg(F.count("*").alias("n")).where("n > 1"), "profile")
    loo = unit.join(mean, "profile").withColumn("o", F.zip_with(F.transform("m", lambda x: x * F.col("n")), F.col("u"), lambda s, x: s - x))
    one = loo.select("profile", (dot(F.col("u"), F.col("o")) / (norm(F.col("o")) + 1e-12)).alias("c"))
    return one.groupBy("profile").agg(bar_floor(F.min("c")).alias("seed_min"), F.percentile("c", 0.5).alias("seed_median"), F.max("c").alias("seed_max"))


def suggested_threshold(profiles: DataFrame, scores: DataFrame, band: DataFrame) -> DataFrame:
    """seed_min and threshold for each of profiles: a little under the least typical seed, within the range where it
    parts the candidates; from the candidates alone without a band; a fixed value with neither."""
    at = {"least": LEAST_PCT, "most": MOST_PCT, "lone": ALONE_PCT}
    up = F.col("members") - 1 - F.col("place")
    q = order_statistics(scores, ["profile"], "score", at, up) if "place" in scores.columns else quantiles(scores, ["profile"], "score", at)
    raw, enough = F.col("seed_min") - MARGIN, F.coalesce(F.col("members") >= ENOUGH, F.lit(False))
    by_band = bar_floor(F.when(enough, F.least(F.greatest(raw, F.col("least")), F.col("most"))).otherwise(raw))
    alone = F.when(enough, bar_floor(F.col("lone"))).otherwise(FALLBACK)
    out = profiles.select("profile").distinct().join(q, "profile", "left").join(band, "profile", "left")
    return out.select("profile", "seed_min", F.when(F.col("seed_min").isNotNull(), by_band).otherwise(alone).alias("threshold"))


def score_axis(scores: DataFrame, band: DataFrame) -> DataFrame:
    """The range a threshold slider covers: scores and seed band, a little padded; profiles with neither are left out."""
    s = scores.groupBy("profile").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).join(band, "profile", "full_outer")
    s = s.select("profile", F.least("lo", "seed_min").alias("lo"), F.greatest("hi", "seed_max").alias("hi"))
    pad = F.greatest(F.lit(0.005), (F.col("hi") - F.col("lo")) * 0.05)
    return s.select("profile", F.round(F.greatest(F.lit(0.0), F.col("lo") - pad), 3).alias("axis_from"), F.round(F.least(F.lit(1.0), F.col("hi") + pad), 3).alias("axis_to"))
