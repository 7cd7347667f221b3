"""Queries on gathering, resolution, the second stage, and topic lists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.vectors import cosine, doubles
from paperloom.operators import calibration, matching, matchpairs, ranking, rerank, resolve, titles, topiclists
from paperloom.operators.resolve import cut
from paperloom.plans.interest import BASE, R, cos, feed, pooled, scores, split
from paperloom.plans.library import P, papers
from paperloom.plans.registry import query, table

# resolution


@query("k05_gather_persist")
def k05(spark, d):
    """No SQL: whether a row stays depends on those kept before it; compared with a loop in the tests."""
    i = F.col("paper_id")
    p = papers(spark, d).select((i % 4).alias("profile"), "paper_id", "title", T.doi_key(F.col("doi")).alias("doi"), "cited")
    keys = T.paper_keys(F.col("doi"), F.col("title"))
    stored = p.where(i % 5 == 0).select("profile", "paper_id", keys.alias("keys"))
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("cited"), "paper_id"))
    new = p.where(i % 3 != 0).select("profile", "paper_id", rank.alias("rank"), F.when(i % 17 == 0, float("nan")).otherwise(F.col("cited") / 101).alias("score"), T.title_key(F.col("title")).alias("title_key"), keys.alias("keys"))
    return resolve.persisted(new, stored, 200)


@query("j09_fuzzy_titles")
def j09(spark, d):
    """No SQL: the ratio is that of matching blocks; compared with all pairs in plain Python in the tests."""
    i = F.col("paper_id")
    p = papers(spark, d)
    rec = p.select(i.alias("record"), F.when(i % 3 == 0, F.upper("title")).when(i % 3 == 1, F.concat("title", F.lit(" a"))).otherwise(F.reverse("title")).alias("title"), F.when(i % 7 != 0, F.col("year")).alias("year"), F.col("source").alias("author"))
    works = p.select(i.alias("work"), F.col("title").alias("w_title"), (F.col("year") + F.when(i % 11 == 0, 2).otherwise(0)).alias("w_year"), F.col("source").alias("w_author"), "cited")
    found = titles.matched_titles(rec, works.withColumnRenamed("cited", "place"))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("j11_full_ladder", P + """, x AS (SELECT paper_id AS work, 'W' || paper_id AS work_id, dk AS doi, CASE WHEN paper_id % 4 = 0 THEN 'PMC' || paper_id END AS pmcid, CASE WHEN length(norm) >= 30 THEN norm END AS title FROM k WHERE paper_id % 2 = 0),
r AS (SELECT paper_id AS record, CASE WHEN paper_id % 6 = 0 THEN 'W' || paper_id END AS work_id, CASE WHEN paper_id % 3 <> 2 THEN dk END AS doi, CASE WHEN paper_id % 5 = 1 THEN 'PMC' || (paper_id + 3) END AS pmcid, CASE WHEN length(norm) >= 30 THEN norm END AS title FROM k),
a AS (SELECT work_id, min(work) AS i FROM x GROUP BY 1), b AS (SELECT doi, min(work) AS i FROM x WHERE doi IS NOT NULL GROUP BY 1), c AS (SELECT pmcid, min(work) AS i FROM x WHERE pmcid IS NOT NULL GROUP BY 1), t AS (SELECT title, min(work) AS i FROM x WHERE title IS NOT NULL GROUP BY 1)
SELECT record, coalesce(a.i, b.i, c.i, t.i) AS resolved, CASE WHEN a.i IS NOT NULL THEN 'work_id' WHEN b.i IS NOT NULL THEN 'doi' WHEN c.i IS NOT NULL THEN 'pmcid' WHEN t.i IS NOT NULL THEN 'title' ELSE 'synthetic' END AS rung
FROM r LEFT JOIN a ON a.work_id = r.work_id LEFT JOIN b ON b.doi = r.doi LEFT JOIN c ON c.pmcid = r.pmcid LEFT JOIN t ON t.title = r.title""")
def j11_full(spark, d):
    """S-06 as well: by work id, DOI, PMCID, title."""
    return _ladder(spark, d)


def _ladder(spark, d):
    i = F.col("paper_id")
    title = F.nullif(T.title_key(F.col("title")), F.lit(""))
    p = papers(spark, d).withColumn("doi", T.doi_key(F.col("doi")))
    works = p.where(i % 2 == 0).select(i.alias("work"), F.concat(F.lit("W"), i).alias("work_id"), "doi", F.when(i % 4 == 0, F.concat(F.lit("PMC"), i)).alias("pmcid"), title.alias("title"))
    rec = p.select(i.alias("record"), F.when(i % 6 == 0, F.concat(F.lit("W"), i)).alias("work_id"), F.when(i % 3 != 2, F.col("doi")).alias("doi"), F.when(i % 5 == 1, F.concat(F.lit("PMC"), i + 3)).alias("pmcid"), title.alias("title"))
    return resolve.ladder(rec, [(n, works) for n in ("work_id", "doi", "pmcid", "title")])


@query("a28_rung_counts", P + """, x AS (SELECT dk AS doi, norm AS title FROM k WHERE paper_id % 2 = 0), r AS (SELECT paper_id, CASE WHEN paper_id % 6 = 0 THEN 'work_id' WHEN paper_id % 3 <> 2 AND dk IN (SELECT doi FROM x WHERE doi IS NOT NULL) THEN 'doi' WHEN paper_id % 5 = 1 AND (paper_id + 3) % 4 = 0 AND paper_id + 3 IN (SELECT paper_id FROM k) THEN 'pmcid' WHEN length(norm) >= 30 AND norm IN (SELECT title FROM x) THEN 'title' ELSE 'synthetic' END AS rung FROM k)
SELECT g.rung, count(r.rung) AS n FROM (SELECT unnest(['work_id', 'doi', 'pmcid', 'title', 'synthetic', 'unresolved']) AS rung) g LEFT JOIN r ON r.rung = g.rung GROUP BY g.rung""")
def a28(spark, d):
    n = _ladder(spark, d).groupBy("rung").agg(F.count("*").alias("n"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ("work_id", "doi", "pmcid", "title", "synthetic", "unresolved")))).alias("rung"))
    return names.join(n, "rung", "left").select("rung", F.coalesce("n", F.lit(0)).alias("n"))


@query("j15_redirected_lookups", """WITH m AS (SELECT o_orderkey AS old_id, o_orderkey + 1 AS new_id FROM orders WHERE o_orderkey % 9 = 0), w AS (SELECT o_orderkey AS work FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 1), q AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT q.id, w.work AS found, coalesce(m.new_id, q.id) <> q.id AS redirected FROM q LEFT JOIN m ON m.old_id = q.id LEFT JOIN w ON w.work = coalesce(m.new_id, q.id)""")
def j15(spark, d):
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    moved = orders.where(o % 9 == 0).select(o.alias("old_id"), (o + 1).alias("new_id"))
    works = orders.where((o % 9 != 0) & (o % 4 != 1)).select(o.alias("work"))
    return resolve.looked_up(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct(), works, moved)


@query("s05_level_fallback", P + """, q AS (SELECT unnest(range(0, 30)) AS q), v AS (SELECT q.q, 1 AS variant, paper_id FROM q JOIN p ON p.source = 'src' || q % 25 AND p.lang = 'es' AND p.year = 2000 + q % 20 UNION ALL SELECT q.q, 2, paper_id FROM q JOIN p ON p.source = 'src' || q % 25 AND p.lang = 'es' UNION ALL SELECT q.q, 3, paper_id FROM q JOIN p ON p.source = 'src' || q % 25)
SELECT q, variant, count(*) AS n, min(paper_id) AS first FROM v QUALIFY variant = min(variant) OVER (PARTITION BY q) GROUP BY q, variant""".replace("SELECT q, variant, count(*) AS n, min(paper_id) AS first FROM v QUALIFY variant = min(variant) OVER (PARTITION BY q) GROUP BY q, variant", "SELECT q, variant, count(*) AS n, min(paper_id) AS first FROM (SELECT *, min(variant) OVER (PARTITION BY q) AS lo FROM v) WHERE variant = lo GROUP BY q, variant"))
def s05(spark, d):
    """A search with its full filter, then with one level less at a time: the first variant that finds anything."""
    p = papers(spark, d)
    asked = spark.range(30).select(F.col("id").alias("q"), F.concat(F.lit("src"), F.col("id") % 25).alias("source"), (2000 + F.col("id") % 20).alias("y"))
    hits = p.join(asked, "source")
    es = F.col("lang") == "es"
    variants = F.array_compact(F.array(F.when(es & (F.col("year") == F.col("y")), 1), F.when(es, 2), F.lit(3)))
    v = hits.select("q", "paper_id", F.explode(variants).alias("variant"))
    least = v.groupBy("q").agg(F.min("variant").alias("variant"))
    return v.join(least, ["q", "variant"]).groupBy("q", "variant").agg(F.count("*").alias("n"), F.min("paper_id").alias("first"))


@query("w10_candidate_merge", """WITH c AS (SELECT o_custkey % 50 AS profile, o_orderkey AS paper_id, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate END AS saved, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS dismissed, o_totalprice AS score, o_orderdate AS fetched, o_custkey % 11 AS key FROM orders)
SELECT profile, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY profile, key ORDER BY saved IS NULL, dismissed IS NULL, score DESC, fetched, paper_id) AS n FROM c) WHERE n = 1 OR saved IS NOT NULL OR dismissed IS NOT NULL""")
def w10(spark, d):
    """Of a work's candidates the first by triage, score and age stays; only untriaged copies go."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("profile"), k.alias("paper_id"), F.when(k % 9 == 0, F.col("o_orderdate")).alias("saved"), F.when(k % 10 == 0, F.col("o_orderdate")).alias("dismissed"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("fetched"), (F.col("o_custkey") % 11).alias("key"))
    n = F.row_number().over(Window.partitionBy("profile", "key").orderBy(F.col("saved").isNull(), F.col("dismissed").isNull(), F.desc("score"), "fetched", "paper_id"))
    return c.withColumn("n", n).where((F.col("n") == 1) | F.col("saved").isNotNull() | F.col("dismissed").isNotNull()).select("profile", "paper_id")


@query("k03_missing_vectors", P + """, m AS (SELECT unnest([0, 1, 2]) AS model) SELECT paper_id, model::INT AS model FROM p, m WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = paper_id AND label % 3 = model)""")
def k03(spark, d):
    """K-03, V-18: the vectors that a backfill would make, for each model and paper without one."""
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"), (F.col("label") % 3).cast("int").alias("model"))
    want = papers(spark, d).select("paper_id", F.explode(F.array(*map(F.lit, range(3)))).alias("model"))
    return want.join(have, ["paper_id", "model"], "left_anti")


@query("k02_stale_concepts", P + """, o AS (SELECT paper_id, CASE WHEN trim(lang) <> '' THEN title || lang ELSE title END AS t FROM p), n AS (SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN title || 'new' WHEN trim(lang) <> '' THEN title || lang ELSE title END AS t FROM p) SELECT o.paper_id, CASE WHEN o.t = n.t THEN o.paper_id % 7 END AS concepts FROM o JOIN n ON n.paper_id = o.paper_id""")
def k02(spark, d):
    """Concepts of a paper are cleared when the text they were read from changes."""
    p = papers(spark, d)
    i, old = F.col("paper_id"), F.when(F.trim("lang") != "", F.concat("title", "lang")).otherwise(F.col("title"))
    new = F.when(i % 4 == 0, F.concat("title", F.lit("new"))).otherwise(old)
    return p.select("paper_id", F.when(old.eqNullSafe(new), i % 7).alias("concepts"))


@query("a35_extraction_counts", P + "SELECT source, count(*) FILTER (paper_id % 5 < 3) AS done, count(*) FILTER (paper_id % 5 = 3) AS pending, count(*) FILTER (paper_id % 5 = 4) AS failed FROM p GROUP BY source")
def a35(spark, d):
    s = F.when(F.col("paper_id") % 5 < 3, "done").when(F.col("paper_id") % 5 == 3, "pending").otherwise("failed")
    return papers(spark, d).withColumn("s", s).groupBy("source").agg(*[F.count_if(F.col("s") == x).alias(x) for x in ("done", "pending", "failed")])


@query("a27_topic_credits", P + """, r AS (SELECT source, paper_id, row_number() OVER (PARTITION BY source ORDER BY cited DESC, paper_id) AS rank FROM p QUALIFY rank <= 10), d AS (SELECT * FROM r ORDER BY rank, source LIMIT 60) SELECT source, count(*) AS n FROM d GROUP BY source""")
def a27(spark, d):
    """What each topic is credited with after the deal was cut at its limit."""
    from paperloom.operators import topics

    r = topics.most_cited(papers(spark, d), "source", 10).withColumn("topic_pos", F.col("source"))
    return topics.dealt(r, 60).groupBy("source").agg(F.count("*").alias("n"))


@query("a29_top_institutions", """SELECT c_nationkey AS person, o_orderpriority || '/' || o_orderstatus AS institution, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, institution) <= 3""")
def a29(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n = j.groupBy(F.col("c_nationkey").alias("person"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("institution")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "institution"))
    return n.withColumn("k", k).where("k <= 3").drop("k")


# scores


@query("a16_agreement", BASE + """, m AS (SELECT profile, quantile_cont(c, 0.5) * 0.14 + 0.86 AS median, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS iqr FROM pr GROUP BY profile), n AS (SELECT profile, count(*) FILTER (seed) AS n FROM r GROUP BY profile),
a AS (SELECT n.profile, n, median, coalesce(iqr, 0) AS iqr, CASE WHEN median IS NOT NULL THEN CAST(round_even(100 * least(1, greatest(0, (median - 0.82) / (0.95 - 0.82))), 0) AS INT) END AS agreement FROM n LEFT JOIN m ON m.profile = n.profile)
SELECT profile, agreement, CASE WHEN n < 1 THEN 'none' WHEN n < 2 THEN 'single' WHEN median >= 0.9 AND (iqr < 0.07 OR agreement >= 80) THEN 'focused' WHEN median >= 0.86 THEN 'broad' ELSE 'mixed' END AS label, CASE WHEN n >= 2 AND median >= 0.9 THEN 'ok' WHEN n < 2 OR median >= 0.86 THEN 'warn' ELSE 'err' END AS health FROM a""")
def a16(spark, d):
    """The test vectors' medians are moved to where the scale lies."""
    from paperloom.operators import selection
    from paperloom.plans.interest import vectors

    seeds, _ = split(spark, d)
    n = vectors(spark, d).select("profile").distinct().join(seeds.groupBy("profile").agg(F.count("*").alias("n")), "profile", "left").fillna(0)
    c = selection.coherence(seeds).select("profile", (F.col("median") * 0.14 + 0.86).alias("median"), "iqr")
    a = n.join(c, "profile", "left")
    score = calibration.agreement(F.col("median"))
    return a.select("profile", score.alias("agreement"), calibration.label(F.col("median"), F.col("iqr"), F.col("n")).alias("label"), calibration.health(F.col("median"), F.col("n")).alias("health"))


@query("a37_populated_bins", BASE + "SELECT profile, min(least(floor(greatest(score, 0) * 16), 15))::INT AS first_bin, max(least(floor(greatest(score, 0) * 16), 15))::INT AS last_bin FROM sc GROUP BY profile")
def a37(spark, d):
    b = F.least(F.floor(F.greatest("score", F.lit(0.0)) * 16), F.lit(15)).cast("int")
    return scores(spark, d).groupBy("profile").agg(F.min(b).alias("first_bin"), F.max(b).alias("last_bin"))


@query("a36_reproduced_ranks", BASE + """, s AS (SELECT profile, paper_id, score, score + CASE WHEN paper_id % 9 = 0 THEN 0.01 ELSE 0 END AS stored FROM sc), k AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(score, 9) DESC, paper_id) AS now, row_number() OVER (PARTITION BY profile ORDER BY round(stored, 9) DESC, paper_id) AS was FROM s)
SELECT profile, count(*) FILTER (now <> was) AS moved, round(max(abs(score - stored)), 6) AS drift FROM k GROUP BY profile""")
def a36(spark, d):
    """Stored against recomputed scores: how many ranks differ, and the largest drift."""
    s = scores(spark, d).withColumn("stored", F.col("score") + F.when(F.col("paper_id") % 9 == 0, 0.01).otherwise(0.0))
    k = ranking.placed(s, ["profile"], F.round("score", 9).desc(), F.col("paper_id").asc()).withColumn("now", F.col("place")).drop("place", "members")
    k = ranking.placed(k, ["profile"], F.round("stored", 9).desc(), F.col("paper_id").asc()).withColumn("was", F.col("place"))
    return k.groupBy("profile").agg(F.count_if(F.col("now") != F.col("was")).alias("moved"), F.round(F.max(F.abs(F.col("score") - F.col("stored"))), 6).alias("drift"))


@query("v07_rescored_rows", BASE + """, c AS (SELECT profile, v, paper_id % 21 = 0 AS none FROM e)
SELECT c.profile, count(*) FILTER (none) AS skipped, count(*) FILTER (NOT none) AS rescored, round(max(CASE WHEN NOT none THEN """ + cos("c.v", "cen.c") + """ END), 6) AS best FROM c JOIN cen ON cen.profile = c.profile GROUP BY c.profile""")
def v07(spark, d):
    """Every stored row against the current fit of its profile; those without a vector are counted and skipped."""
    from paperloom.operators import selection
    from paperloom.plans.interest import vectors

    fit = selection.centroids(split(spark, d)[0])
    c = vectors(spark, d).withColumn("v", F.when(F.col("paper_id") % 21 != 0, F.col("v"))).join(fit, "profile")
    return c.groupBy("profile").agg(F.count_if(F.col("v").isNull()).alias("skipped"), F.count("v").alias("rescored"), F.round(F.max(F.when(F.col("v").isNotNull(), cosine(F.col("v"), F.col("centroid")))), 6).alias("best"))


LOGITS = """, qs3 AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY paper_id) - 1 AS query_no, v AS w FROM sd QUALIFY query_no < 3),
lo AS (SELECT sc.profile, sc.paper_id, query_no, round(""" + cos("sc.v", "w") + """ * 10, 9) AS logit FROM sc JOIN qs3 ON qs3.profile = sc.profile),
ag AS (SELECT profile, paper_id, max(logit) AS logit, avg(logit) AS mean, min_by(query_no, -logit * 1000000 + query_no / 1000.0) AS best_query FROM lo GROUP BY 1, 2)
"""


def logits(spark, d):
    """J-07: each article against each of its profile's queries, three seeds; a cosine stands for the cross-encoder."""
    seeds, cand = split(spark, d)
    n = F.row_number().over(Window.partitionBy("profile").orderBy("paper_id")) - 1
    queries = seeds.select("profile", n.alias("query_no"), F.col("v").alias("w")).where("query_no < 3")
    return cand.join(queries, "profile").select("profile", "paper_id", F.col("query_no").cast("long").alias("query_no"), F.round(cosine(F.col("v"), F.col("w")) * 10, 9).alias("logit"))


@query("a22_query_logits", BASE + LOGITS + "SELECT profile, paper_id, round(logit, 6) AS logit, round(mean, 6) AS mean, best_query FROM ag")
def a22(spark, d):
    lo = logits(spark, d)
    mean = rerank.aggregated(lo, "mean").select("profile", "paper_id", F.round("logit", 6).alias("mean"))
    return rerank.aggregated(lo).select("profile", "paper_id", R("logit"), "best_query").join(mean, ["profile", "paper_id"])


@query("a24_batch_blend", BASE + LOGITS + """, b AS (SELECT ag.profile, ag.paper_id % 4 AS batch, ag.paper_id, sc.score AS s, logit FROM ag JOIN sc ON sc.profile = ag.profile AND sc.paper_id = ag.paper_id), x AS (SELECT profile, batch, min(s) s0, max(s) s1, min(logit) r0, max(logit) r1 FROM b GROUP BY 1, 2),
y AS (SELECT b.*, 0.4 * (s - s0) / (CASE WHEN s1 > s0 THEN s1 - s0 ELSE 1 END) + 0.6 * (logit - r0) / (CASE WHEN r1 > r0 THEN r1 - r0 ELSE 1 END) AS blended FROM b JOIN x ON x.profile = b.profile AND x.batch = b.batch)
SELECT profile, batch, paper_id, round(blended, 6) AS blended, round(CASE WHEN count(*) OVER (PARTITION BY profile, batch) <= 1 THEN 1.0 ELSE (count(*) OVER (PARTITION BY profile, batch) - row_number() OVER (PARTITION BY profile, batch ORDER BY round(blended, 9) DESC, paper_id)) / (count(*) OVER (PARTITION BY profile, batch) - 1)::DOUBLE END, 6) AS pct FROM y""")
def a24(spark, d):
    """V-05, V-06: the blend over each gathered batch."""
    rows = scores(spark, d).select("profile", "paper_id", F.col("score").alias("score_raw")).join(rerank.aggregated(logits(spark, d)), ["profile", "paper_id"])
    return rerank.batch_blend(rows.withColumn("batch", F.col("paper_id") % 4)).select("profile", "batch", "paper_id", R("blended"), R("pct"))


@query("v03_full_text_selector", """WITH e AS (SELECT label AS profile, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
u AS (SELECT profile, vec_id, n, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM e), sd AS (SELECT profile, n % 4 AS paper_id, vec_id, u FROM u WHERE n <= 12), ca AS (SELECT profile, vec_id // 60 AS paper_id, vec_id, u FROM u WHERE n > 12),
mo AS (SELECT a.profile, a.vec_id, any_value(a.u) AS u, greatest(0, least(1, 1 - coalesce(max(CASE WHEN b.paper_id <> a.paper_id THEN list_dot_product(a.u, b.u) END), 0))) AS w FROM sd a JOIN sd b ON b.profile = a.profile GROUP BY 1, 2),
wt AS (SELECT profile, u, CASE WHEN sum(w) OVER (PARTITION BY profile) < 1e-9 THEN 1 ELSE w END AS w FROM mo),
cl AS (SELECT profile, t.i AS i, avg(w * u[t.i]) AS x FROM wt, range(1, 65) t(i) GROUP BY 1, 2), ce AS (SELECT profile, list(x ORDER BY i) AS c FROM cl GROUP BY profile),
pl AS (SELECT profile, paper_id, t.i AS i, avg(u[t.i]) AS x FROM ca, range(1, 65) t(i) GROUP BY 1, 2, 3), pm AS (SELECT profile, paper_id, list(x ORDER BY i) AS m FROM pl GROUP BY 1, 2),
ms AS (SELECT ca.profile, ca.paper_id, ca.vec_id, max(list_dot_product(ca.u, sd.u)) AS m FROM ca JOIN sd ON sd.profile = ca.profile GROUP BY 1, 2, 3),
tp AS (SELECT profile, paper_id, avg(m) AS maxsim FROM (SELECT *, row_number() OVER (PARTITION BY profile, paper_id ORDER BY m DESC) AS k FROM ms) WHERE k <= 3 GROUP BY 1, 2),
nc AS (SELECT profile, paper_id, count(*) AS n_chunks FROM ca GROUP BY 1, 2)
SELECT pm.profile, pm.paper_id, round(list_dot_product(m, c) / ((sqrt(list_dot_product(m, m)) + 1e-12) * (sqrt(list_dot_product(c, c)) + 1e-12)), 6) AS pooled, round(maxsim, 6) AS maxsim, round(0.5 * list_dot_product(m, c) / ((sqrt(list_dot_product(m, m)) + 1e-12) * (sqrt(list_dot_product(c, c)) + 1e-12)) + 0.5 * maxsim, 6) AS score, n_chunks
FROM pm JOIN ce ON ce.profile = pm.profile JOIN tp ON tp.profile = pm.profile AND tp.paper_id = pm.paper_id JOIN nc ON nc.profile = pm.profile AND nc.paper_id = pm.paper_id""")
def v03(spark, d):
    """A-11, T-06: twelve chunks of four seed papers a profile; the other vectors are chunks of candidates."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("profile"), F.col("vec_id").alias("chunk_id"), doubles(F.col("embedding")).alias("v"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy("chunk_id")))
    seeds = e.where("n <= 12").select("profile", (F.col("n") % 4).alias("paper_id"), "chunk_id", "v")
    cand = e.where("n > 12").select("profile", F.floor(F.col("chunk_id") / 60).alias("paper_id"), "chunk_id", "v")
    return rerank.full_text_scores(cand, seeds).select("profile", "paper_id", R("pooled"), R("maxsim"), R("score"), "n_chunks")


@query("t04_hidden_counts", BASE + """, f AS (SELECT pl.*, th.seed_min, CASE WHEN score_raw >= seed_min THEN 'high' ELSE 'medium' END AS bucket FROM pl JOIN th ON th.profile = pl.profile WHERE in_pool), k AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(blended, 9) DESC, paper_id) <= 5 AS kept FROM f)
SELECT profile, greatest(count(*) FILTER (bucket = 'high') - count(*) FILTER (bucket = 'high' AND kept), 0) AS high, greatest(count(*) FILTER (bucket = 'medium') - count(*) FILTER (bucket = 'medium' AND kept), 0) AS medium FROM k GROUP BY profile""")
def t04(spark, d):
    """What each bucket holds beyond the five cards shown."""
    f = feed(spark, d).where("in_pool")
    k = F.row_number().over(Window.partitionBy("profile").orderBy(F.round("blended", 9).desc(), "paper_id")) <= 5
    f = f.withColumn("kept", k)
    hidden = lambda b: F.greatest(F.count_if(F.col("bucket") == b) - F.count_if((F.col("bucket") == b) & F.col("kept")), F.lit(0)).alias(b)
    return f.groupBy("profile").agg(hidden("high"), hidden("medium"))


@query("p21_stale_logits", BASE + """, f AS (SELECT *, CASE WHEN paper_id % 3 = 0 THEN 'old' ELSE 'now' END AS key FROM pl WHERE in_pool) SELECT profile, paper_id FROM f WHERE logit IS NULL OR key <> 'now' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY round(score_raw, 9) DESC, paper_id) <= 600""")
def p21(spark, d):
    """ST-07: the feed's rows whose logit is missing or of other queries, best first, at most 600 a call."""
    f = pooled(spark, d).where("in_pool").withColumn("key", F.when(F.col("paper_id") % 3 == 0, "old").otherwise("now"))
    n = F.row_number().over(Window.partitionBy("profile").orderBy(F.round("score_raw", 9).desc(), "paper_id"))
    return f.where(F.col("logit").isNull() | (F.col("key") != "now")).withColumn("n", n).where("n <= 600").select("profile", "paper_id")


@query("a39_pool_report", BASE + """, k AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(blended, 9) DESC, paper_id) AS n FROM pl WHERE in_pool) SELECT profile, count(*) AS rows, round(max(blended), 6) AS best, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 3) AS top FROM k GROUP BY profile""")
def a39(spark, d):
    """A dry run of the rescore over every profile: its size, its best score and its top three."""
    n = F.row_number().over(Window.partitionBy("profile").orderBy(F.round("blended", 9).desc(), "paper_id"))
    k = pooled(spark, d).where("in_pool").withColumn("n", n)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "paper_id")))), lambda x: x["paper_id"].cast("string")), ",")
    return k.groupBy("profile").agg(F.count("*").alias("rows"), F.round(F.max("blended"), 6).alias("best"), top.alias("top"))


# topic lists


@query("a25_group_names", P + """, x AS (SELECT paper_id % 6 AS g, source AS t, 2 AS w FROM p UNION ALL SELECT paper_id % 6, 'src' || paper_id % 9, 1 FROM p), i AS (SELECT g, t, sum(w) AS n FROM x GROUP BY 1, 2), a AS (SELECT t, sum(n) AS total FROM i GROUP BY t), s AS (SELECT paper_id % 6 AS g, count(*) AS k FROM p GROUP BY 1),
y AS (SELECT i.g, i.t, i.n, i.n / s.k::DOUBLE - 0.5 * (a.total - i.n) / ((SELECT count(*) FROM p) - s.k) AS score FROM i JOIN a ON a.t = i.t JOIN s ON s.g = i.g)
SELECT g, t AS name, n::BIGINT AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, n DESC, t) AS rank FROM y) WHERE rank <= 3""")
def a25(spark, d):
    """V-13: three names of each group, by what its papers have more than the others."""
    i, p = F.col("paper_id"), papers(spark, d)
    said = p.select((i % 6).alias("g"), F.explode(F.array(F.struct(F.col("source").alias("t"), F.lit(2).alias("w")), F.struct(F.concat(F.lit("src"), i % 9).alias("t"), F.lit(1).alias("w")))).alias("x")).select("g", "x.*")
    return topiclists.names(said, p.groupBy((i % 6).alias("g")).agg(F.count("*").alias("k"))).select("g", "name", "count", F.col("rank").cast("long").alias("rank"))


@query("a38_concepts", """WITH m AS (SELECT l_suppkey AS paper_id, l_partkey % 200 AS cui, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS mention FROM lineitem),
b AS (SELECT paper_id, cui, max(confidence) AS confidence, min_by(mention, -confidence * 1000000000000 + mention) AS mention, count(*) AS mentions FROM m GROUP BY 1, 2)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, cui) <= 30""")
def a38(spark, d):
    """Of a paper's mentions each concept once, with its surest one; the thirty surest concepts."""
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("paper_id"), (F.col("l_partkey") % 200).alias("cui"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention"))
    b = m.groupBy("paper_id", "cui").agg(F.max("confidence").alias("confidence"), F.max_by("mention", F.struct("confidence", -F.col("mention"))).alias("mention"), F.count("*").alias("mentions"))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("confidence"), "cui"))
    return b.withColumn("n", n).where("n <= 30").drop("n")


@query("f40_interest_reading", """WITH a AS (SELECT p_partkey % 20 AS profile, p_size AS topic, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'declared' ELSE 'inferred' END AS method, CASE p_partkey % 4 WHEN 0 THEN -p_retailprice WHEN 1 THEN NULL ELSE p_retailprice END AS weight FROM part),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY profile, topic ORDER BY (method = 'declared') DESC, (coalesce(weight, 0) < 0) DESC, pos) = 1)
SELECT profile, 'Topic ' || topic AS name, coalesce(weight, 0) >= 0 AS wanted, method, round(weight, 6) AS weight FROM b
UNION ALL SELECT l.profile, l.label, true, 'label', NULL FROM (SELECT DISTINCT p_partkey % 20 AS profile, 'topic ' || p_partkey % 60 AS label FROM part WHERE p_partkey % 7 = 0) l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.profile = l.profile AND lower('Topic ' || b.topic) = lower(l.label))""")
def f40(spark, d):
    """S-14: a declared assertion beats an inferred one, then a negative a positive one; labels that topics cover go."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    said = part.select((k % 20).alias("profile"), F.concat(F.lit("Topic "), "p_size").alias("name"), k.alias("pos"), F.when(k % 3 == 0, "declared").otherwise("inferred").alias("method"), F.when(k % 4 == 0, -F.col("p_retailprice")).when(k % 4 != 1, F.col("p_retailprice")).alias("weight"))
    labels = part.where(k % 7 == 0).select((k % 20).alias("profile"), F.concat(F.lit("topic "), k % 60).alias("label"))
    out = topiclists.interests(said, labels)
    return out.withColumn("weight", F.round("weight", 6))


TL = """WITH st AS (SELECT c_custkey % 40 AS profile, c_custkey % 37 AS topic, c_custkey % 3 <> 0 AS is_on, c_custkey % 4 AS seeds FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 40, c_custkey % 37 ORDER BY c_custkey) = 1),
rb AS (SELECT DISTINCT s_suppkey % 40 AS profile, s_suppkey % 41 AS topic, s_suppkey % 2 = 0 AS is_on FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 40, s_suppkey % 41 ORDER BY s_suppkey) = 1)
"""


def lists(spark, d):
    """A stored and a rebuilt topic list of each profile."""
    one = lambda df, k: df.withColumn("n", F.row_number().over(Window.partitionBy("profile", "topic").orderBy(k))).where("n = 1").drop("n")
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    stored = one(table(spark, d, "customer").select((c % 40).alias("profile"), (c % 37).alias("topic"), (c % 3 != 0).alias("is_on"), (c % 4).alias("seeds"), c), "c_custkey").drop("c_custkey")
    rebuilt = one(table(spark, d, "supplier").select((s % 40).alias("profile"), (s % 41).alias("topic"), (s % 2 == 0).alias("is_on"), s), "s_suppkey").drop("s_suppkey")
    return stored, rebuilt


@query("m05_rebuilt_lists", TL + """SELECT coalesce(rb.profile, st.profile) AS profile, coalesce(rb.topic, st.topic) AS topic, coalesce(st.is_on, rb.is_on) AS is_on, CASE WHEN rb.profile IS NULL THEN CASE WHEN st.seeds > 0 THEN 'seed_removed' ELSE 'no_seed' END END AS mark FROM rb FULL JOIN st ON st.profile = rb.profile AND st.topic = rb.topic""")
def m05(spark, d):
    return topiclists.rebuilt(*lists(spark, d))


@query("m06_pruned_lists", TL + """SELECT st.profile, st.topic, st.is_on AND rb.profile IS NOT NULL AS is_on FROM st LEFT JOIN rb ON rb.profile = st.profile AND rb.topic = st.topic""")
def m06(spark, d):
    """Topics that were not selected are switched off, never deleted."""
    stored, chosen = lists(spark, d)
    return topiclists.pruned(stored.drop("seeds"), chosen.select("profile", "topic"))


@query("m07_carried_ticks", TL + """SELECT st.profile, st.topic, CASE WHEN rb.is_on IS NOT NULL AND rb.is_on <> (st.seeds % 2 = 0) THEN rb.is_on ELSE st.is_on END AS is_on FROM st LEFT JOIN rb ON rb.profile = st.profile AND rb.topic = st.topic""")
def m07(spark, d):
    """A tick that somebody changed in the meantime, against the list that a rebuild began from, is carried over."""
    stored, now = lists(spark, d)
    base = stored.select("profile", "topic", (F.col("seeds") % 2 == 0).alias("is_on"))
    return topiclists.carried(stored.drop("seeds"), base, now)


@query("m04_interest_marks", TL + """SELECT st.profile, st.topic, count(d.name) AS marks, string_agg(d.name, ',' ORDER BY d.name) AS names FROM st LEFT JOIN (SELECT DISTINCT p_partkey % 40 AS profile, p_size % 37 AS topic, p_brand AS name FROM part WHERE p_partkey % 3 = 0) d ON d.profile = st.profile AND d.topic = st.topic GROUP BY 1, 2""")
def m04(spark, d):
    """Which kept profile documents want a topic of the list."""
    k = F.col("p_partkey")
    docs = table(spark, d, "part").where(k % 3 == 0).select((k % 40).alias("profile"), (F.col("p_size") % 37).alias("topic"), F.col("p_brand").alias("name"))
    return topiclists.marked(lists(spark, d)[0].select("profile", "topic"), docs)


@query("p20_outdated", TL + """, a AS (SELECT profile, list_sort(list(topic) FILTER (is_on)) AS on_now FROM st GROUP BY 1), b AS (SELECT profile, list(topic) AS scanned FROM rb GROUP BY 1) SELECT a.profile, NOT list_has_all(coalesce(b.scanned, []), coalesce(on_now, [])) AS outdated FROM a LEFT JOIN b ON b.profile = a.profile""")
def p20(spark, d):
    """ST-08: whether a profile has topics on that its last scan did not look at."""
    stored, scanned = lists(spark, d)
    a = stored.groupBy("profile").agg(F.collect_set(F.when(F.col("is_on"), F.col("topic"))).alias("now"))
    b = scanned.groupBy("profile").agg(F.collect_set("topic").alias("then"))
    return a.join(b, "profile", "left").select("profile", (F.size(F.array_except("now", F.coalesce("then", F.array().cast("array<bigint>")))) > 0).alias("outdated"))


@query("m01_concept_votes")
def m01(spark, d):
    """No SQL: the choice within a seed is one by one; compared with a loop in the tests. Votes are counted over all seeds."""
    li = table(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    mapped = li.select((k % 30).alias("profile"), (k % 300).alias("paper_id"), (F.col("l_partkey") % 50).alias("concept"), (F.col("l_suppkey") % 80).alias("topic_id"), F.concat(F.lit("Topic "), F.col("l_suppkey") % 70).alias("name"), F.round(F.col("l_discount") * 5 + F.col("l_tax"), 4).alias("similarity"), (1 - F.col("l_tax")).alias("confidence"), n.alias("rank"))
    have = li.select((k % 30).alias("profile"), (F.col("l_suppkey") % 9).alias("topic_id")).distinct()
    return topiclists.voted(mapped, have)


@query("v14_concept_topics", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id // 3 AS concept, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM e), ml AS (SELECT concept, t.i AS i, avg(u[t.i]) AS x FROM u, range(1, 65) t(i) GROUP BY 1, 2), m AS (SELECT concept, list(x ORDER BY i) AS v FROM ml GROUP BY concept),
tl AS (SELECT label, t.i AS i, avg(v[t.i]) AS x FROM e, range(1, 65) t(i) GROUP BY 1, 2), tp AS (SELECT label AS topic_id, list(x ORDER BY i) AS v FROM tl GROUP BY label)
SELECT concept, topic_id, round(sim, 6) AS sim, k AS rank FROM (SELECT concept, topic_id, sim, row_number() OVER (PARTITION BY concept ORDER BY sim DESC, topic_id) AS k FROM (SELECT concept, topic_id, round(""" + cos("m.v", "tp.v") + """, 9) AS sim FROM m, tp)) WHERE k <= 3""")
def v14(spark, d):
    """A concept's mentions as the mean of their unit vectors, and its three nearest topics."""
    from paperloom.functions.vectors import mean_vector
    from paperloom.operators.labels import nearest_topics

    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("topic_id"), doubles(F.col("embedding")).alias("v"))
    mentions = rerank.unit_chunks(e).select(F.floor(F.col("vec_id") / 3).alias("concept"), "u")
    concepts = mean_vector(mentions, "concept", "u", "v")
    near = nearest_topics(concepts, mean_vector(e, "topic_id", "v", "v"), 3, -2.0)
    return near.select("concept", "topic_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("v16_nearest_labels", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), tl AS (SELECT label, t.i AS i, avg(v[t.i]) AS x FROM e, range(1, 65) t(i) GROUP BY 1, 2), tp AS (SELECT label AS topic_id, list(x ORDER BY i) AS v FROM tl GROUP BY label),
n AS (SELECT vec_id AS label_id, topic_id, round(""" + cos("e.v", "tp.v") + """, 9) AS sim FROM e, tp QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic_id) = 1) SELECT label_id, CASE WHEN sim >= 0.25 THEN topic_id END AS topic_id, sim >= 0.25 AS found FROM n""")
def v16(spark, d):
    """A label's nearest topic, and those that have none, which are remembered as well."""
    from paperloom.functions.vectors import mean_vector
    from paperloom.operators.labels import nearest_topics

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("label_id"), F.col("label").alias("topic_id"), doubles(F.col("embedding")).alias("v"))
    near = nearest_topics(e.select("label_id", "v"), mean_vector(e, "topic_id", "v", "v"), 1, 0.25).select("label_id", "topic_id")
    return e.select("label_id").join(near, "label_id", "left").select("label_id", "topic_id", F.col("topic_id").isNotNull().alias("found"))


@query("v19_label_support", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), tl AS (SELECT label, t.i AS i, avg(v[t.i]) AS x FROM e, range(1, 65) t(i) GROUP BY 1, 2), tp AS (SELECT label AS topic_id, list(x ORDER BY i) AS v FROM tl GROUP BY label),
n AS (SELECT topic_id, vec_id, round(""" + cos("tp.v", "e.v") + """, 9) AS sim FROM tp, e QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY sim DESC, vec_id) <= 5) SELECT topic_id, count(DISTINCT vec_id // 8) AS papers, string_agg(DISTINCT CAST(vec_id // 8 AS VARCHAR), ',' ORDER BY CAST(vec_id // 8 AS VARCHAR)) AS ids FROM n GROUP BY topic_id""")
def v19(spark, d):
    """The five chunks nearest to each label, and the papers they are of."""
    from paperloom.functions.vectors import mean_vector
    from paperloom.operators.labels import nearest_topics

    e = table(spark, d, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    labels = mean_vector(e, "label", "v", "v")
    near = nearest_topics(labels, e.select(F.col("vec_id").alias("topic_id"), "v"), 5, -2.0)
    paper = F.floor(F.col("topic_id") / 8).cast("string")
    return near.groupBy(F.col("label").alias("topic_id")).agg(F.countDistinct(paper).alias("papers"), F.array_join(F.array_sort(F.collect_set(paper)), ",").alias("ids"))


@query("v10_collection_choice", """WITH c AS (SELECT o_custkey % 100 AS "user", count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS chat, count(*) FILTER (o_orderstatus = 'O') AS vault FROM orders GROUP BY 1) SELECT "user", CASE WHEN chat > 0 THEN 'chat' WHEN vault > 0 THEN 'vault' END AS collection, CASE WHEN chat > 0 THEN chat ELSE vault END AS chunks FROM c""")
def v10(spark, d):
    """S-12: the chat index of a user if it holds anything, else the vault's."""
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("user")).agg(F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("chat"), F.count_if(F.col("o_orderstatus") == "O").alias("vault"))
    return o.select("user", F.when(F.col("chat") > 0, "chat").when(F.col("vault") > 0, "vault").alias("collection"), F.when(F.col("chat") > 0, F.col("chat")).otherwise(F.col("vault")).alias("chunks"))


@query("st06_backlog", P + """SELECT paper_id FROM p WHERE paper_id % 5 <> 0 AND NOT (paper_id % 7 = 0 AND paper_id % 48 < 6)""")
def st06(spark, d):
    """What a sweep would take: papers without concepts, but for failures of the last six hours."""
    i, p = F.col("paper_id"), papers(spark, d).select("paper_id")
    done = p.where(i % 5 == 0)
    failed = p.where(i % 7 == 0).withColumn("hours_ago", i % 48).where("hours_ago < 6")
    return p.join(done, "paper_id", "left_anti").join(failed, "paper_id", "left_anti")


ADOPTION = """WITH s AS (SELECT c_nationkey AS profile, c_custkey % 97 AS topic, any_value(CASE WHEN c_custkey % 97 % 3 = 0 THEN 'labels' WHEN c_custkey % 97 % 3 = 1 THEN 'researcher' END) AS source, min(c_acctbal) > 0 AS is_on FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2),
p AS (SELECT c_nationkey AS profile, c_custkey % 131 AS topic, max((c_acctbal > 4000)::INT) AS want, min((c_acctbal > 4000)::INT) AS every FROM customer GROUP BY 1, 2),
ch AS (SELECT n_nationkey AS profile, t.i AS topic, ['filter', 'keep', 'add', 'odd'][(n_nationkey + t.i) % 4 + 1] AS choice FROM nation, range(0, 131) t(i) WHERE (n_nationkey * t.i) % 5 = 1 AND (n_nationkey + t.i) % 4 < 3),
x AS (SELECT coalesce(s.profile, p.profile) AS profile, coalesce(s.topic, p.topic) AS topic, source, is_on, s.profile IS NOT NULL AS before, want, every FROM s FULL JOIN p ON p.profile = s.profile AND p.topic = s.topic),
y AS (SELECT x.*, CASE WHEN every = 0 THEN coalesce(ch.choice, CASE WHEN (before AND coalesce(source, 'seeds') <> 'researcher') OR want = 1 THEN 'keep' ELSE 'filter' END) END AS choice FROM x LEFT JOIN ch ON ch.profile = x.profile AND ch.topic = x.topic),
z AS (SELECT profile, topic, CASE WHEN before THEN source ELSE 'researcher' END AS source, coalesce(is_on, TRUE) AS is_on, CASE WHEN choice = 'add' THEN 'interest' WHEN choice = 'filter' AND before THEN 'not_interest' WHEN want = 1 THEN 'interest' END AS mark, choice, before FROM y)
"""


def adoption(spark, d):
    """Lists, proposals and choices over customers: topics of a nation, the wish of an account, choices by a rule."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    t = k % 97
    stored = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_nationkey").alias("profile"), t.alias("topic"), F.when(t % 3 == 0, "labels").when(t % 3 == 1, "researcher").alias("source"), "c_acctbal")
    stored = stored.groupBy("profile", "topic").agg(F.min("source").alias("source"), (F.min("c_acctbal") > 0).alias("is_on"))
    proposed = c.select(F.col("c_nationkey").alias("profile"), (k % 131).alias("topic"), (F.col("c_acctbal") > 4000).alias("wanted"))
    n = F.col("n_nationkey")
    ways = F.element_at(F.array(*map(F.lit, ("filter", "keep", "add", "odd"))), (n + F.col("topic")).cast("int") % 4 + 1)
    choices = table(spark, d, "nation").withColumn("topic", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(130).cast("long")))).where("(n_nationkey * topic) % 5 = 1").select(n.alias("profile"), "topic", ways.alias("choice"))
    return stored, proposed, choices


@query("m03_adopted_profile", ADOPTION + "SELECT profile, topic, source, is_on, mark, choice, before FROM z WHERE before OR mark IS NOT NULL")
def m03(spark, d):
    return topiclists.adopted(*adoption(spark, d))


@query("m03_stripped_profile", ADOPTION + "SELECT profile, topic, source, is_on FROM s WHERE coalesce(source, 'seeds') <> 'researcher'")
def m03_strip(spark, d):
    """Stripping what was adopted gives the stored lists again, but for rows of an earlier adoption."""
    return topiclists.stripped(topiclists.adopted(*adoption(spark, d)))


FOLD = "trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"
SQUASH = "regexp_replace({0}, '[^a-z]+', '', 'g')"


def _named_sql(g: str, f: str, group: str, token: str) -> str:
    return f"CASE WHEN {group} THEN length({token}) >= 4 AND contains(head, {token}) ELSE length({f}) >= 2 AND {g} <> '' AND (regexp_matches(head, {g} || '[a-z]{{0,4}}' || {f}) OR (length({f}) >= 3 AND regexp_matches(spaced, '(^|[^a-z])' || left({g}, 1) || '( [a-z]){{0,2}} ' || {f} || '[a-z]?([^a-z]|$)'))) END"


MATCHES = P + f""", a AS (SELECT *, string_split_regex(trim(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g')), ' ') AS wd FROM p),
x AS (SELECT paper_id AS work, dk, CASE WHEN paper_id % 5 = 0 THEN title || ': more' WHEN paper_id % 5 = 1 THEN 'Else' ELSE title END AS w_title, coalesce(wd[2], '') AS g1, coalesce(wd[3], '') AS f1, coalesce(wd[5], '') AS g2, coalesce(wd[6], '') AS f2 FROM a JOIN k USING (paper_id, text, title) WHERE dk IS NOT NULL),
r AS (SELECT paper_id AS record, dk, CASE WHEN paper_id % 7 = 0 THEN 'Other' ELSE title END AS title, CASE paper_id % 3 WHEN 0 THEN 'doi' ELSE 'title' END AS way, text FROM k WHERE dk IS NOT NULL),
h AS (SELECT record, work, way, {FOLD.format('title')} AS own, {FOLD.format("split_part(title, ':', 1)")} AS own_main, {FOLD.format('w_title')} AS of, {FOLD.format("split_part(w_title, ':', 1)")} AS of_main,
  {SQUASH.format(FOLD.format("left(text, 3000)"))} AS page, {SQUASH.format(FOLD.format("left(text, 6000)"))} AS head, regexp_replace({FOLD.format("left(text, 6000)")}, '[0-9]+', ' ', 'g') AS spaced,
  CASE work % 4 WHEN 1 THEN left({SQUASH.format(FOLD.format('g1'))}, 1) WHEN 2 THEN '' ELSE {SQUASH.format(FOLD.format('g1'))} END AS ag, {SQUASH.format(FOLD.format('f1'))} AS af, work % 4 = 2 OR (work % 4 <> 0 AND g1 = '') AS grp, {SQUASH.format(FOLD.format('g2'))} AS bg, {SQUASH.format(FOLD.format('f2'))} AS bf, g2 = '' OR f2 = '' AS lone FROM r JOIN x USING (dk)),
v AS (SELECT *, own <> '' AND of <> '' AND (own = of OR own_main = of OR own = of_main OR contains(page, {SQUASH.format('of')})) AS title_ok, head <> '' AND {_named_sql('ag', 'af', 'grp', 'af')} AS first_ok, {_named_sql('bg', 'bf', 'FALSE', 'bf')} AS second_ok FROM h)
"""


@query("j12_verified_matches", MATCHES + "SELECT record, work, title_ok, first_ok AND (lone OR grp OR second_ok) AS authors_ok, CASE WHEN way = 'doi' THEN title_ok OR first_ok ELSE title_ok AND first_ok AND (lone OR grp OR second_ok) END AS verified FROM v")
def j12(spark, d):
    """F-20: papers of one DOI as hits of each other; words of a work's text stand for its authors' names, in four forms."""
    i = F.col("paper_id")
    p = papers(spark, d).withColumn("dk", T.doi_key(F.col("doi"))).where("dk is not null")
    # texts are read once; of their words the first alone are cut off, what follows them stays one piece
    p = p.withColumn("wd", F.split(F.regexp_replace("text", r"^[^\p{L}]+", ""), r"[^\p{L}]+", 8))
    fold, page = matching.folded(F.substring("text", 1, matching.HEAD)), F.length(matching.page_letters(F.col("text")))
    p = cut(p.select("paper_id", F.col("dk").alias("key"), "title", F.slice("wd", 1, 6).alias("wd"), fold.alias("fold"), page.alias("page")))
    at = lambda n: F.coalesce(F.get("wd", F.lit(n)), F.lit(""))
    name = F.when(i % 4 == 0, F.concat(at(2), F.lit(", "), at(1))).when(i % 4 == 1, F.concat(F.substring(at(1), 1, 1), F.lit(" "), at(2))).when(i % 4 == 2, at(2)).otherwise(F.concat(at(1), F.lit(" "), at(2)))
    w_title = F.when(i % 5 == 0, F.concat("title", F.lit(": more"))).when(i % 5 == 1, "Else").otherwise(F.col("title"))
    n = F.when((at(4) == "") | (at(5) == ""), 1).otherwise(2)
    works = p.select(i.alias("work"), "key", n.alias("n"), matching.title_keys(w_title).alias("of"), matching.name_keys(name).alias("first"), matching.name_keys(F.concat(at(4), F.lit(" "), at(5))).alias("second"))
    title = F.when(i % 7 == 0, "Other").otherwise(F.col("title"))
    rec = p.select(i.alias("record"), "key", matching.title_keys(title).alias("own"), "fold", "page")
    h = matchpairs.paired(rec, works).withColumn("authors_ok", matching.with_others(F.col("first_ok"), F.col("group"), F.col("second_ok"), F.col("n")))
    way = F.when(F.col("record") % 3 == 0, "doi").otherwise("title")
    return h.select("record", "work", "title_ok", "authors_ok", matching.verified(F.col("title_ok"), F.col("authors_ok"), F.col("first_ok"), way).alias("verified"))
