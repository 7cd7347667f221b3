"""Queries on feedback events and runs, over `events` and `orders`."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import fits, logits, merge, state
from paperloom.plans.registry import query, table

E = """WITH e AS (SELECT event_id, ts, user_id % 10 AS profile, event_id % 300 AS paper_id, value, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'dismissed' WHEN 'click' THEN 'unsaved' WHEN 'view' THEN 'shown' ELSE 'snoozed' END AS action FROM events)
"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    a = F.create_map(*[F.lit(x) for kv in (("purchase", "saved"), ("error", "dismissed"), ("click", "unsaved"), ("view", "shown")) for x in kv])
    return table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("profile"), (F.col("event_id") % 300).alias("paper_id"), "value", F.coalesce(a[F.col("event_type")], F.lit("snoozed")).alias("action"))


@query("k07_triage_state", E + """, l AS (SELECT profile, paper_id, max_by(action, epoch_us(ts)::HUGEINT * 10000000 + event_id) FILTER (action IN ('saved', 'dismissed', 'unsaved')) AS s,
  min(ts) FILTER (action = 'saved') AS vaulted_at, min(ts) FILTER (action = 'shown') AS first_shown, max(ts) FILTER (action = 'shown') AS last_shown FROM e GROUP BY 1, 2)
SELECT profile, paper_id, coalesce(s = 'saved', false) AS saved, coalesce(s = 'dismissed', false) AS dismissed, coalesce(s = 'unsaved', false) AS unsaved, vaulted_at, first_shown, last_shown FROM l""")
def k07(spark, d):
    """K-07, K-08 and ST-03."""
    return state.triage(feedback(spark, d))


@query("a02_action_counts", E + "SELECT profile, sum((action = 'saved')::INT)::BIGINT AS saves, sum((action = 'dismissed')::INT)::BIGINT AS dismisses, count(*) AS events FROM e WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY profile")
def a02(spark, d):
    f = feedback(spark, d).where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return f.groupBy("profile").agg(*[F.sum((F.col("action") == a).cast("long")).alias(n) for a, n in (("saved", "saves"), ("dismissed", "dismisses"))], F.count("*").alias("events"))


@query("a01_topic_yield", E + """, t AS (SELECT label AS topic, vec_id AS paper_id FROM embeddings)
SELECT topic, count(action) AS events, count(DISTINCT e.paper_id) AS papers, coalesce(sum((action = 'saved')::INT), 0)::BIGINT AS saved, round(max(value), 6) AS best FROM t LEFT JOIN e ON e.paper_id = t.paper_id GROUP BY topic""")
def a01(spark, d):
    """Every topic is listed, those that brought nothing with zeros."""
    t = table(spark, d, "embeddings").select(F.col("label").alias("topic"), F.col("vec_id").alias("paper_id"))
    e = feedback(spark, d).groupBy("paper_id").agg(F.count("*").alias("n"), F.sum((F.col("action") == "saved").cast("long")).alias("s"), F.max("value").alias("v"))
    j = t.join(e, "paper_id", "left")
    return j.groupBy("topic").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("n").alias("papers"), F.coalesce(F.sum("s"), F.lit(0)).alias("saved"), F.round(F.max("v"), 6).alias("best"))


@query("k04_candidate_upsert", E + """, a AS (SELECT profile, paper_id, max(value) AS score, min(ts) AS shown_at FROM e WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2), b AS (SELECT profile, paper_id, max(value) AS score, min(ts) AS shown_at FROM e WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2)
SELECT coalesce(a.profile, b.profile) AS profile, coalesce(a.paper_id, b.paper_id) AS paper_id, round(CASE WHEN b.profile IS NOT NULL THEN b.score ELSE a.score END, 6) AS score, CASE WHEN a.profile IS NOT NULL THEN a.shown_at ELSE b.shown_at END AS shown_at, a.profile IS NULL AS is_new FROM a FULL JOIN b ON a.profile = b.profile AND a.paper_id = b.paper_id""")
def k04(spark, d):
    """Scores are refreshed, the triage of stored rows stays."""
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    agg = lambda f: f.groupBy("profile", "paper_id").agg(F.max("value").alias("score"), F.min("ts").alias("shown_at"))
    f = feedback(spark, d)
    out = merge.merged(agg(f.where(F.col("ts") < cut)), agg(f.where(F.col("ts") >= cut)), ["profile", "paper_id"], {"score": "new", "shown_at": "keep"})
    return out.withColumn("score", F.round("score", 6))


@query("j13_latest_run", "SELECT o_custkey AS profile, max_by(o_orderkey, epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey) AS run, max(o_orderdate) AS started, count(*) AS runs FROM orders GROUP BY o_custkey")
def j13(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("profile")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"), F.max("o_orderdate").alias("started"), F.count("*").alias("runs"))


@query("f29_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') IN ('0') AS off FROM events")
def f29(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("int").alias("k"), (k == "0").alias("off"))


@query("st12_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st12(spark, d):
    g = table(spark, d, "events").groupBy(F.window(F.col("ts"), "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("st12_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '12 hours' AND ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12 hours' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def st12s(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts"), "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


U = E + """, g AS (SELECT profile, paper_id, ts < TIMESTAMP '2024-01-15 00:00:00' AS early, max(value) AS score, min(value) AS score_raw, CASE WHEN min(event_id) % 3 <> 0 THEN max(value) * 2 END AS logit, CASE WHEN min(event_id) % 5 <> 0 THEN min(event_id) % 7 END AS topic, min(ts) AS shown_at FROM e GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN logit IS NOT NULL THEN 'first' END AS k FROM g WHERE early), n AS (SELECT *, 'second' AS k FROM g WHERE NOT early),
u AS (SELECT coalesce(o.profile, n.profile) AS profile, coalesce(o.paper_id, n.paper_id) AS paper_id, CASE WHEN n.profile IS NOT NULL THEN n.score ELSE o.score END AS score, CASE WHEN n.profile IS NOT NULL THEN n.score_raw ELSE o.score_raw END AS score_raw, CASE WHEN o.profile IS NOT NULL THEN o.shown_at ELSE n.shown_at END AS shown_at,
  coalesce(n.logit, o.logit) AS logit, CASE WHEN n.logit IS NOT NULL THEN n.k ELSE o.k END AS query_key, coalesce(o.topic, n.topic) AS topic, o.profile IS NULL AS is_new FROM o FULL JOIN n ON o.profile = n.profile AND o.paper_id = n.paper_id)
"""


def candidates(spark, d):
    """What events before a day stored, with what those after it found merged in."""
    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    f = feedback(spark, d).groupBy("profile", "paper_id", early.alias("early")).agg(F.max("value").alias("score"), F.min("value").alias("score_raw"), F.min("event_id").alias("i"), F.min("ts").alias("shown_at"))
    f = f.withColumn("logit", F.when(F.col("i") % 3 != 0, F.col("score") * 2)).withColumn("topic", F.when(F.col("i") % 5 != 0, F.col("i") % 7)).drop("i")
    stored = f.where("early").drop("early").withColumn("query_key", F.when(F.col("logit").isNotNull(), "first"))
    return logits.upserted(stored, f.where("not early").drop("early").withColumn("query_key", F.lit("second")))


@query("k04_logit_upsert", U + "SELECT profile, paper_id, round(score, 6) AS score, round(score_raw, 6) AS score_raw, shown_at, round(logit, 6) AS logit, query_key, topic, is_new FROM u")
def k04_logits(spark, d):
    """The logit and its key stay where a find has none, the first topic stays."""
    return candidates(spark, d).select("profile", "paper_id", *[F.round(c, 6).alias(c) for c in ("score", "score_raw", "logit")], "shown_at", "query_key", "topic", "is_new")


@query("st07_set_logits", U + """, y AS (SELECT *, CASE WHEN profile % 2 = 0 THEN 'second' ELSE 'third' END AS key FROM u), l AS (SELECT * FROM y WHERE logit IS NULL OR query_key IS DISTINCT FROM key QUALIFY row_number() OVER (PARTITION BY profile ORDER BY score_raw DESC NULLS LAST, paper_id) <= 600),
c AS (SELECT profile, paper_id, key, score_raw * 3 AS x FROM l WHERE paper_id % 11 <> 0 AND paper_id % 13 <> 0)
SELECT u.profile, u.paper_id, round(coalesce(x, logit), 6) AS logit, CASE WHEN u.paper_id % 13 = 0 THEN 'theirs' ELSE coalesce(key, query_key) END AS query_key FROM u LEFT JOIN c ON c.profile = u.profile AND c.paper_id = u.paper_id""")
def st07_set(spark, d):
    """A pass over stale logits, best 600 a profile. A model had no number for some rows; others got another writer's key
    while it ran, and keep that."""
    rows = candidates(spark, d)
    p = F.col("profile")
    keys = rows.select("profile").distinct().withColumn("key", F.when(p % 2 == 0, "second").otherwise("third"))
    late = logits.stale(rows, keys)
    scored = late.select("profile", "paper_id", F.col("query_key").alias("seen_key"), F.when(F.col("paper_id") % 11 != 0, F.col("score_raw") * 3).alias("new_logit"), "key")
    since = rows.withColumn("query_key", F.when(F.col("paper_id") % 13 == 0, "theirs").otherwise(F.col("query_key")))
    return logits.set_logits(since, scored).select("profile", "paper_id", F.round("logit", 6).alias("logit"), "query_key")


@query("st08_stale_fits", """WITH s AS (SELECT DISTINCT l_suppkey AS profile, l_partkey AS paper_id FROM lineitem WHERE l_returnflag <> 'R'), f AS (SELECT DISTINCT l_suppkey AS profile, l_partkey AS paper_id FROM lineitem WHERE l_returnflag <> 'R' AND (l_suppkey % 2 = 0 OR l_quantity < 50) OR l_suppkey % 8 = 0 AND l_tax > 0.07),
t AS (SELECT s_suppkey AS profile, s_suppkey % 9 = 1 AS is_draft, s_suppkey % 3 <> 0 AS recorded, CASE WHEN s_suppkey % 15 <> 0 THEN (SELECT count(*) FROM f WHERE f.profile = s_suppkey) END AS n_matrix FROM supplier),
n AS (SELECT coalesce(s.profile, f.profile) AS profile, count(*) FILTER (f.profile IS NULL) AS added, count(*) FILTER (s.profile IS NULL) AS removed, count(s.profile) AS now FROM s FULL JOIN f ON s.profile = f.profile AND s.paper_id = f.paper_id GROUP BY 1)
SELECT t.profile, NOT is_draft AND CASE WHEN recorded THEN coalesce(added, 0) + coalesce(removed, 0) > 0 ELSE n_matrix IS NULL OR n_matrix <> coalesce(now, 0) END AS stale, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM t LEFT JOIN n ON n.profile = t.profile""")
def st08(spark, d):
    """Suppliers as interests, the parts they ship as seeds; fits made before some of them, and of some no more."""
    s, k = F.col("l_suppkey"), F.col("s_suppkey")
    here = F.col("l_returnflag") != "R"
    before = (here & ((s % 2 == 0) | (F.col("l_quantity") < 50))) | ((s % 8 == 0) & (F.col("l_tax") > 0.07))
    of = lambda c: table(spark, d, "lineitem").where(c).select(s.alias("profile"), F.col("l_partkey").alias("paper_id")).distinct()
    fitted = of(before)
    counts = fitted.groupBy("profile").agg(F.count("*").alias("n"))
    t = table(spark, d, "supplier").select(k.alias("profile"), (k % 9 == 1).alias("is_draft"), (k % 3 != 0).alias("recorded"))
    t = t.join(counts, "profile", "left").withColumn("n_matrix", F.when(F.col("profile") % 15 != 0, F.coalesce("n", F.lit(0)))).drop("n")
    return fits.stale_fits(t, fitted, of(here))


R = """WITH r AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS profile, CASE WHEN o_orderpriority = '1-URGENT' THEN 'dry_run' WHEN o_orderpriority = '2-HIGH' THEN 'import' WHEN o_orderpriority <> '5-LOW' THEN 'scan' END AS kind, o_orderdate AS started, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished FROM orders)
"""


def runs(spark, d):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "dry_run").when(p == "2-HIGH", "import").when(p != "5-LOW", "scan")
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("run"), F.when(k % 17 != 0, F.col("o_custkey")).alias("profile"), kind.alias("kind"), F.col("o_orderdate").alias("started"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished"), F.lit(None).cast("string").alias("error"))


@query("st11_closed_runs", R + "SELECT run, started, coalesce(finished, (SELECT max(started) FROM r)) AS finished, CASE WHEN finished IS NULL THEN 'interrupted' END AS error FROM r")
def st11(spark, d):
    """Orders as runs; those open are closed at the last start that is known."""
    r = runs(spark, d)
    last = r.agg(F.max("started").alias("now"))  # one row
    return fits.closed(r.crossJoin(last), F.col("now"), "interrupted").select("run", "started", "finished", "error")


@query("st11_to_rescan", R + "SELECT DISTINCT profile FROM r WHERE finished IS NULL AND profile IS NOT NULL AND coalesce(kind, '') NOT IN ('dry_run', 'import')")
def st11_rescan(spark, d):
    return fits.to_rescan(runs(spark, d), ["dry_run", "import"])
