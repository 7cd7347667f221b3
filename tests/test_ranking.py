"""Places and quantiles of groups that no task holds, and the feed that is scored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import pool, ranking, selection
from paperloom.plans import catalog, interest

D = "/root/testdata/sf0.001"


def skewed(spark, n=6000):
    """One profile has nearly all rows, half of them of one score; another has a lone row, a third nothing but nulls."""
    i = F.col("id")
    rows = spark.range(n).select(F.lit("big").alias("profile"), i.alias("paper_id"), F.when(i % 2 == 0, 0.5).otherwise(F.pmod(F.xxhash64(i), F.lit(1000)) / 1000).alias("score"))
    return rows.unionByName(spark.createDataFrame([("lone", 1, 0.3), (None, 1, None), (None, 2, None)], "profile string, paper_id long, score double"))


def test_places(spark):
    rows = skewed(spark)
    got = ranking.placed(rows, ["profile"], F.round("score", 9).desc(), F.col("paper_id").asc()).collect()
    big = [(r["score"], r["paper_id"], r["place"], r["members"]) for r in got if r["profile"] == "big"]
    assert len(got) == 6003 and {m for *_, m in big} == {6000}
    assert [p for *_, p, _ in sorted(big, key=lambda r: (-r[0], r[1]))] == list(range(6000))
    assert sorted((r["place"], r["members"]) for r in got if r["profile"] is None) == [(0, 2), (1, 2)]


def test_no_window_holds_a_profile(spark):
    """Without small partitions put together, the large profile's ranges lie in many, and places are the same."""
    rows, order = skewed(spark), (F.round("score", 9).desc(), F.col("paper_id").asc())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = rows.repartitionByRange("profile", *order).where("profile = 'big'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        got = sorted((r["place"], -r["score"], r["paper_id"]) for r in ranking.placed(rows, ["profile"], *order).where("profile = 'big'").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranged) >= 6 and max(r["count"] for r in ranged) < 3000
    assert [p for p, *_ in got] == list(range(6000)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_quantiles(spark):
    rows = skewed(spark)
    at = {"a": 0.0, "b": 0.25, "c": 0.755, "d": 1.0}
    got = {r["profile"]: r for r in ranking.quantiles(rows, ["profile"], "score", at).collect()}
    values = np.array([r["score"] for r in rows.where("profile = 'big'").collect()])
    assert set(got) == {"big", "lone"} and [got["lone"][k] for k in at] == [0.3] * 4
    assert [got["big"][k] for k in at] == pytest.approx([float(np.quantile(values, q)) for q in at.values()], abs=1e-12)


def test_pool_of_one_profile(spark):
    rows = skewed(spark).where("profile = 'big'").select("profile", "paper_id", F.col("score").alias("score_raw"), F.when(F.col("paper_id") % 3 > 0, F.col("score") * 2).alias("logit"))
    out = pool.rescored(rows).toPandas().sort_values("paper_id")
    span = out.score_raw.max() - out.score_raw.min()
    rr = ((out.logit - out.logit.min()) / (out.logit.max() - out.logit.min())).to_numpy()
    want = 0.4 * (out.score_raw - out.score_raw.min()) / span + 0.6 * np.where(np.isnan(rr), np.nanmedian(rr), rr)
    assert np.allclose(out.blended, want)
    order = sorted(zip(-want.round(9), out.paper_id, out.pct, strict=True))
    assert [p for *_, p in order] == pytest.approx([(5999 - i) / 5999 for i in range(6000)])


def test_seeds_without_a_sort_of_vectors(spark):
    v = spark.range(500).select((F.col("id") % 3).alias("profile"), F.col("id").alias("paper_id"), F.array(F.lit(1.0), F.col("id") * 0.1).alias("v"))
    got = selection.seeds_of(v, F.when(F.col("profile") == 2, 1).otherwise(4), 4)
    assert sorted((r["profile"], r["paper_id"]) for r in got.collect()) == [(0, 0), (0, 3), (0, 6), (0, 9), (1, 1), (1, 4), (1, 7), (1, 10), (2, 2)]


@pytest.mark.parametrize("name", ["flagship_feed", "a23_pool_rescore"])
def test_feed_is_scored_once(spark, name):
    read = []
    before = interest.table
    interest.table = lambda *a: read.append(a[-1]) or before(*a)
    try:
        plan = catalog.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    finally:
        interest.table = before
    assert len(read) <= 4 and "embeddings.parquet" not in plan
