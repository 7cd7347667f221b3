"""Queries on profiles, similarity, pools and the feed, over `embeddings`: a profile for each label, with eight
seeds, but one seed in profile 8 and none in profile 9."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import cosine, doubles
from paperloom.operators import pool, predicates, selection
from paperloom.operators.labels import nearest_topics
from paperloom.operators.resolve import cut
from paperloom.plans.registry import query, table

SEEDS = "CASE profile WHEN 8 THEN 1 WHEN 9 THEN 0 ELSE 8 END"
#: The topics of a profile's list that are on, as a condition on topic and profile.
ON = "(topic + profile) % 3 = 0"


def cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-12))"


BASE = f"""WITH e AS (SELECT vec_id AS paper_id, label AS profile, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY paper_id) <= {SEEDS} AS seed FROM e),
sd AS (SELECT * FROM r WHERE seed), cand AS (SELECT * FROM r WHERE NOT seed),
lg AS (SELECT profile, t.i AS i, avg(v[t.i]) AS x FROM sd, range(1, 65) t(i) GROUP BY 1, 2),
cen AS (SELECT profile, list(x ORDER BY i) AS c FROM lg GROUP BY profile),
nr AS (SELECT c.profile, c.paper_id, max({cos('c.v', 's.v')}) AS max_seed, quantile_cont({cos('c.v', 's.v')}, 0.5) AS median_seed FROM cand c JOIN sd s ON s.profile = c.profile GROUP BY 1, 2),
md AS (SELECT c.profile, c.paper_id, c.v, {cos('c.v', 'cen.c')} AS score FROM cand c JOIN cen ON cen.profile = c.profile),
sc AS (SELECT md.*, max_seed, median_seed, CASE WHEN count(*) OVER (PARTITION BY md.profile) <= 1 THEN 1.0 ELSE (count(*) OVER (PARTITION BY md.profile) - row_number() OVER (PARTITION BY md.profile ORDER BY round(score, 9) DESC, md.paper_id)) / (count(*) OVER (PARTITION BY md.profile) - 1)::DOUBLE END AS score_pct FROM md JOIN nr ON nr.profile = md.profile AND nr.paper_id = md.paper_id),
pr AS (SELECT a.profile, a.paper_id AS a, b.paper_id AS b, {cos('a.v', 'b.v')} AS c FROM sd a JOIN sd b ON a.profile = b.profile AND a.paper_id < b.paper_id),
un AS (SELECT profile, paper_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM sd),
loo AS (SELECT a.profile, a.paper_id, t.i AS i, any_value(a.u) AS u, avg(b.u[t.i]) AS x FROM un a JOIN un b ON a.profile = b.profile AND a.paper_id <> b.paper_id, range(1, 65) t(i) GROUP BY 1, 2, 3),
lo2 AS (SELECT profile, paper_id, any_value(u) AS u, list(x ORDER BY i) AS o FROM loo GROUP BY 1, 2),
lo3 AS (SELECT profile, list_dot_product(u, o) / (sqrt(list_dot_product(o, o)) + 1e-12) AS c FROM lo2),
bd AS (SELECT profile, floor(min(c) * 1000 + 1e-9) / 1000 AS seed_min, quantile_cont(c, 0.5) AS seed_median, max(c) AS seed_max FROM lo3 GROUP BY profile),
qs AS (SELECT profile, quantile_cont(score, 0.75) AS q75, quantile_cont(score, 0.98) AS q98, quantile_cont(score, 0.9) AS q90, count(*) AS n FROM sc GROUP BY profile),
th AS (SELECT p.profile, seed_min, CASE WHEN seed_min IS NOT NULL THEN floor((CASE WHEN n >= 10 THEN least(greatest(seed_min - {selection.MARGIN}, q75), q98) ELSE seed_min - {selection.MARGIN} END) * 1000 + 1e-9) / 1000
  WHEN n >= 10 THEN floor(q90 * 1000 + 1e-9) / 1000 ELSE 0.9 END AS threshold FROM (SELECT DISTINCT profile FROM e) p LEFT JOIN qs ON qs.profile = p.profile LEFT JOIN bd ON bd.profile = p.profile),
q0 AS (SELECT v AS qv FROM e WHERE paper_id = 0),
att AS (SELECT *, CASE WHEN paper_id % 11 <> 0 THEN 1990 + paper_id % 37 END AS year, CASE WHEN paper_id % 4 <> 0 THEN paper_id % 7 END AS source_topic, [paper_id % 5, paper_id % 6] AS own, paper_id % 450 AS doi, CASE WHEN paper_id % 3 = 0 THEN paper_id + 20 END AS canonical_id FROM e),
pa AS (SELECT DISTINCT profile, CASE WHEN profile % 3 <> 0 THEN 1995 END AS year_from, CASE WHEN profile % 4 <> 0 THEN 2022 END AS year_to, profile % 5 <> 4 AS listed FROM e),
el AS (SELECT sc.profile, sc.paper_id, coalesce(score >= threshold, TRUE) AND (year IS NULL OR ((year_from IS NULL OR year >= year_from) AND (year_to IS NULL OR year <= year_to)))
  AND (source_topic IS NULL OR NOT listed OR (source_topic + sc.profile) % 3 = 0 OR (own[1] + sc.profile) % 3 = 0 OR (own[2] + sc.profile) % 3 = 0)
  AND NOT EXISTS (SELECT 1 FROM sd JOIN att sa ON sa.paper_id = sd.paper_id WHERE sd.profile = sc.profile AND (sd.paper_id = sc.paper_id OR sa.canonical_id = sc.paper_id OR sa.doi = att.doi)) AS in_pool
  FROM sc JOIN att ON att.paper_id = sc.paper_id JOIN pa ON pa.profile = sc.profile JOIN th ON th.profile = sc.profile),
al0 AS (SELECT sc.profile, sc.paper_id, sc.score AS score_raw, CASE WHEN sc.paper_id % 5 = 0 THEN NULL ELSE {cos('sc.v', 'q0.qv')} END AS logit, in_pool FROM sc JOIN el ON el.profile = sc.profile AND el.paper_id = sc.paper_id, q0),
pl0 AS (SELECT * FROM al0 WHERE in_pool),
st AS (SELECT profile, min(score_raw) s0, max(score_raw) s1, min(logit) r0, max(logit) r1, quantile_cont(logit, 0.5) rm FROM pl0 GROUP BY profile),
pl1 AS (SELECT pl0.*, (score_raw - s0) / (CASE WHEN s1 > s0 THEN s1 - s0 ELSE 1 END) AS sel_norm, (logit - r0) / (CASE WHEN r1 > r0 THEN r1 - r0 ELSE 1 END) AS rr_norm, (rm - r0) / (CASE WHEN r1 > r0 THEN r1 - r0 ELSE 1 END) AS mid FROM pl0 JOIN st ON st.profile = pl0.profile),
pl2 AS (SELECT *, 0.4 * sel_norm + 0.6 * coalesce(rr_norm, mid) AS blended FROM pl1),
pl3 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY profile) <= 1 THEN 1.0 ELSE (count(*) OVER (PARTITION BY profile) - row_number() OVER (PARTITION BY profile ORDER BY round(coalesce(blended, sel_norm), 9) DESC, paper_id)) / (count(*) OVER (PARTITION BY profile) - 1)::DOUBLE END AS pct FROM pl2),
pl AS (SELECT al0.*, sel_norm, rr_norm, blended, pct FROM al0 LEFT JOIN pl3 ON pl3.profile = al0.profile AND pl3.paper_id = al0.paper_id)
"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").alias("profile"), doubles(F.col("embedding")).alias("v"))


def split(spark, d):
    """Seeds, written once (a few a profile), and the other vectors."""
    v = vectors(spark, d)
    seeds = cut(selection.seeds_of(v, F.expr(SEEDS), 8))
    return seeds, v.join(seeds.select("profile", "paper_id"), ["profile", "paper_id"], "left_anti")


class Study:
    """What the feed's questions share, written once: seeds, and each candidate's scores, logit and place."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.seeds, candidates = split(spark, d)
        query_vector = table(spark, d, "embeddings").where("vec_id = 0").select(doubles(F.col("embedding")).alias("qv"))
        logit = F.when(F.col("paper_id") % 5 != 0, cosine(F.col("v"), F.col("qv")))
        candidates = candidates.crossJoin(F.broadcast(query_vector)).withColumn("logit", logit).drop("qv")  # one row
        self.scores = cut(selection.by_score(selection.scored(candidates, self.seeds)))
        self.profiles = self.scores.select("profile").union(self.seeds.select("profile")).union(vectors(spark, d).select("profile")).distinct()
        self.band = selection.seed_band(self.seeds)
        self.thresholds = cut(selection.suggested_threshold(self.profiles, self.scores, self.band))

    def pooled(self) -> DataFrame:
        """Every candidate with its scores over the pool of its profile; those outside the pool have nulls."""
        pool_of = eligible(self.scores, self.seeds, self.thresholds).withColumn("in_pool", F.lit(True))
        rows = self.scores.select("profile", "paper_id", F.col("score").alias("score_raw"), "logit").join(pool_of, ["profile", "paper_id"], "left")
        return pool.rescored_members(cut(rows.withColumn("in_pool", F.coalesce("in_pool", F.lit(False)))), "in_pool")

    def feed(self) -> DataFrame:
        f = self.pooled().join(self.thresholds, "profile")
        return f.withColumn("bucket", predicates.bucket(F.col("score_raw"), F.col("threshold"), F.col("seed_min"), F.col("pct")))


def scores(spark, d):
    seeds, cand = split(spark, d)
    return selection.scored(cand, seeds)


def thresholds(spark, d):
    return Study(spark, d).thresholds


def pooled(spark, d):
    return Study(spark, d).pooled()


def feed(spark, d):
    return Study(spark, d).feed()


def attributes(papers):
    """What a paper brings to the feed's predicates: year, the topic that brought it in, its own topics, DOI, public record."""
    i = F.col("paper_id")
    return papers.withColumns({"year": F.when(i % 11 != 0, 1990 + i % 37), "source_topic": F.when(i % 4 != 0, i % 7), "own": F.array(i % 5, i % 6), "doi": (i % 450).cast("string"), "canonical_id": F.when(i % 3 == 0, i + 20)})


def profile_settings(bars):
    """Threshold, years and topics of each profile."""
    p = F.col("profile")
    on = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda t: (t + p) % 3 == 0).cast("array<bigint>")
    return bars.select("profile", "seed_min", "threshold", F.when(p % 3 != 0, 1995).alias("year_from"), F.when(p % 4 != 0, 2022).alias("year_to"), on.alias("on"), (p % 5 != 4).alias("listed"))


def eligible(scored, seeds, bars):
    """profile, paper_id of the candidates that the feed can show: passing, in years, with a topic on, no seeds."""
    c = attributes(scored.select("profile", "paper_id", "score")).join(profile_settings(bars), "profile")
    c = c.where(predicates.passes(F.col("score"), F.col("threshold")) & predicates.in_years(F.col("year"), F.col("year_from"), F.col("year_to")) & predicates.topic_on(F.col("source_topic"), F.col("own"), F.col("on"), F.col("listed")))
    return predicates.not_seed(c, attributes(seeds.select("profile", "paper_id"))).select("profile", "paper_id")


R = lambda c, n=6: F.round(c, n).alias(c)


@query("a10_centroid", BASE + "SELECT profile, t.i AS dim, round(c[t.i + 1], 9) AS x FROM cen, range(0, 64) t(i)")
def a10(spark, d):
    return selection.centroids(split(spark, d)[0]).select("profile", F.posexplode("centroid").alias("dim", "x")).select("profile", F.col("dim").cast("long").alias("dim"), F.round("x", 9).alias("x"))


@query("v01_centroid_selector", BASE + "SELECT profile, paper_id, round(score, 6) AS score, round(max_seed, 6) AS max_seed, round(median_seed, 6) AS median_seed, round(score_pct, 6) AS score_pct FROM sc")
def v01(spark, d):
    return selection.by_score(scores(spark, d)).select("profile", "paper_id", R("score"), R("max_seed"), R("median_seed"), R("score_pct"))


@query("v02_max_seed_selector", BASE + "SELECT profile, paper_id, round(max_seed, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(max_seed, 9) DESC, paper_id) AS k FROM sc) WHERE k <= 20")
def v02(spark, d):
    k = F.row_number().over(Window.partitionBy("profile").orderBy(F.round("max_seed", 9).desc(), "paper_id"))
    return scores(spark, d).withColumn("k", k).where("k <= 20").select("profile", "paper_id", F.round("max_seed", 6).alias("score"))


@query("a12_coherence", BASE + """, l AS (SELECT profile, a, b, row_number() OVER (PARTITION BY profile ORDER BY round(c, 9), a, b) AS k FROM pr)
SELECT pr.profile, count(*) AS pairs, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.75) - quantile_cont(c, 0.25), 6) AS iqr, any_value(l.a) AS least_a, any_value(l.b) AS least_b FROM pr JOIN l ON l.profile = pr.profile AND l.k = 1 GROUP BY pr.profile""")
def a12(spark, d):
    return selection.coherence(split(spark, d)[0]).select("profile", "pairs", R("median"), R("iqr"), "least_a", "least_b")


@query("a15_bimodality", BASE + """, rg AS (SELECT profile, min(c) lo, max(c) hi, count(*) n FROM pr GROUP BY profile),
bn AS (SELECT pr.profile, least(floor((c - lo) / (hi - lo) * 10), 9)::BIGINT AS bin FROM pr JOIN rg ON rg.profile = pr.profile),
h AS (SELECT rg.profile, rg.n, t.i AS i, count(bn.bin) AS k FROM rg CROSS JOIN range(0, 10) t(i) LEFT JOIN bn ON bn.profile = rg.profile AND bn.bin = t.i GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY k DESC, i DESC) AS p FROM h),
t2 AS (SELECT profile, min(i) AS l, max(i) AS r, min(k) AS peak FROM o WHERE p <= 2 GROUP BY profile),
tr AS (SELECT h.profile, min(h.k) AS trough FROM h JOIN t2 ON t2.profile = h.profile AND h.i > t2.l AND h.i < t2.r GROUP BY h.profile)
SELECT rg.profile, rg.n >= 20 AND r - l >= 2 AND peak > 0 AND coalesce(trough / peak < 0.1, false) AS bimodal FROM rg JOIN t2 ON t2.profile = rg.profile LEFT JOIN tr ON tr.profile = rg.profile""")
def a15(spark, d):
    return selection.two_peaks(selection.seed_pairs(split(spark, d)[0]))


@query("a17_seed_band", BASE + "SELECT profile, seed_min, round(seed_median, 6) AS seed_median, round(seed_max, 6) AS seed_max FROM bd")
def a17(spark, d):
    return selection.seed_band(split(spark, d)[0]).select("profile", "seed_min", R("seed_median"), R("seed_max"))


@query("a19_threshold", BASE + "SELECT * FROM th")
def a19(spark, d):
    return thresholds(spark, d)


@query("a13_histogram", BASE + """, b AS (SELECT profile, least(floor(greatest(score, 0) * 16), 15)::INT AS bin FROM sc)
SELECT p.profile, t.i::INT AS bin, count(b.bin) AS n FROM (SELECT DISTINCT profile FROM sc) p CROSS JOIN range(0, 16) t(i) LEFT JOIN b ON b.profile = p.profile AND b.bin = t.i GROUP BY 1, 2""")
def a13(spark, d):
    b = scores(spark, d).select("profile", F.least(F.floor(F.greatest("score", F.lit(0.0)) * 16), F.lit(15)).cast("int").alias("bin"))
    n = b.groupBy("profile", "bin").agg(F.count("*").alias("n"))
    grid = n.select("profile").distinct().select("profile", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("bin"))
    return grid.join(n, ["profile", "bin"], "left").select("profile", "bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("a20_threshold_sweep", BASE + """, t AS (SELECT unnest([0.0, 0.1, 0.2, 0.3]) AS theta)
SELECT profile, CAST(theta AS DOUBLE) AS theta, count(*) AS n, min_by(paper_id, -round(score, 9) * 1000000000 + paper_id / 1000000.0) AS top FROM sc JOIN t ON score >= theta GROUP BY 1, 2""")
def a20(spark, d):
    s = scores(spark, d).withColumn("theta", F.explode(F.filter(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3))), lambda t: t <= F.col("score"))))
    return s.groupBy("profile", "theta").agg(F.count("*").alias("n"), F.min_by("paper_id", F.struct(-F.round("score", 9), "paper_id")).alias("top"))


@query("a21_score_axis", BASE + """, x AS (SELECT coalesce(s.profile, bd.profile) AS profile, least(lo, seed_min) AS lo, greatest(hi, seed_max) AS hi FROM (SELECT profile, min(score) lo, max(score) hi FROM sc GROUP BY profile) s FULL JOIN bd ON bd.profile = s.profile)
SELECT profile, round(greatest(0, lo - greatest(0.005, (hi - lo) * 0.05)), 3) AS axis_from, round(least(1, hi + greatest(0.005, (hi - lo) * 0.05)), 3) AS axis_to FROM x""")
def a21(spark, d):
    return selection.score_axis(scores(spark, d), selection.seed_band(split(spark, d)[0]))


@query("a23_pool_rescore", BASE + "SELECT profile, paper_id, round(sel_norm, 6) AS sel_norm, round(rr_norm, 6) AS rr_norm, round(blended, 6) AS blended, round(pct, 6) AS pct FROM pl")
def a23(spark, d):
    return pooled(spark, d).select("profile", "paper_id", R("sel_norm"), R("rr_norm"), R("blended"), R("pct"))


@query("a26_rank_changes", BASE + """, rk AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY round(score_raw, 9) DESC, paper_id) - row_number() OVER (PARTITION BY profile ORDER BY round(blended, 9) DESC, paper_id) AS moved FROM pl WHERE in_pool)
SELECT profile, round(avg(abs(moved)), 6) AS mean_move, max(moved) AS most_up, min(moved) AS most_down FROM rk GROUP BY profile""")
def a26(spark, d):
    m = pool.rank_changes(pooled(spark, d).where("in_pool"))
    return m.groupBy("profile").agg(F.round(F.avg(F.abs("moved")), 6).alias("mean_move"), F.max("moved").cast("long").alias("most_up"), F.min("moved").cast("long").alias("most_down"))


FEED = BASE + """, f AS (SELECT pl.*, th.threshold, th.seed_min, CASE WHEN score_raw < threshold THEN 'low' WHEN score_raw >= seed_min THEN 'high' ELSE 'medium' END AS bucket FROM pl JOIN th ON th.profile = pl.profile)
"""


@query("flagship_feed", FEED + "SELECT profile, paper_id, bucket, round(score_raw, 6) AS score, round(pct, 6) AS pct, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY paper_id % 13 = 5, round(blended, 9) DESC, paper_id) AS k FROM f WHERE in_pool) WHERE k <= 20")
def flagship(spark, d):
    """T-01, P-06: the best papers of each profile's pool, those that were unsaved again last."""
    unsaved = F.col("paper_id") % 13 == 5
    k = F.row_number().over(Window.partitionBy("profile").orderBy(unsaved, F.round("blended", 9).desc(), "paper_id"))
    f = feed(spark, d).where("in_pool").withColumn("rank", k).where("rank <= 20")
    return f.select("profile", "paper_id", "bucket", F.round("score_raw", 6).alias("score"), R("pct"), F.col("rank").cast("long").alias("rank"))


@query("t02_below_the_bar", FEED + "SELECT profile, paper_id, round(score_raw - threshold, 6) AS gap FROM f WHERE bucket = 'low' ORDER BY round(score_raw - threshold, 9) DESC, paper_id LIMIT 50")
def t02(spark, d):
    f = feed(spark, d).where("bucket = 'low'").orderBy(F.round(F.col("score_raw") - F.col("threshold"), 9).desc(), "paper_id").limit(50)
    return f.select("profile", "paper_id", F.round(F.col("score_raw") - F.col("threshold"), 6).alias("gap"))


@query("a03_bucket_counts", FEED + "SELECT profile, sum((bucket = 'high')::INT)::BIGINT AS high, sum((bucket = 'medium')::INT)::BIGINT AS medium, sum((bucket = 'low')::INT)::BIGINT AS low FROM f GROUP BY profile")
def a03(spark, d):
    return feed(spark, d).groupBy("profile").agg(*[F.sum((F.col("bucket") == b).cast("long")).alias(b) for b in ("high", "medium", "low")])


@query("t03_fair_shares")
def t03(spark, d):
    """Shares of 60 cards among profiles by their passing rows; compared with a loop in the tests."""
    n = feed(spark, d).where("bucket <> 'low'").groupBy("profile").agg(F.count("*").alias("n"))
    return pool.fair_shares(n, 60)


@query("j08_topic_neighbours", BASE + f"SELECT paper_id, profile AS topic, sim, k AS rank FROM (SELECT e.paper_id, cen.profile, round(round({cos('e.v', 'cen.c')}, 9), 6) AS sim, row_number() OVER (PARTITION BY e.paper_id ORDER BY round({cos('e.v', 'cen.c')}, 9) DESC, cen.profile) AS k FROM e, cen WHERE {cos('e.v', 'cen.c')} >= 0.05) WHERE k <= 3")
def j08(spark, d):
    """Each paper's nearest topics, by blocks of the index."""
    v = vectors(spark, d)
    index = selection.centroids(split(spark, d)[0]).select(F.col("profile").alias("topic_id"), F.col("centroid").alias("v"))
    near = nearest_topics(v.select("paper_id", "v"), index, 3, 0.05)
    return near.select("paper_id", F.col("topic_id").alias("topic"), F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))
