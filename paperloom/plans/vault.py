"""Queries on vaults, versions, runs and schedules, over `documents`, `embeddings`, `events`, `orders` and `customer`.

User = profile % 3. A paper with id % 10 = 3 is a private version of the next one, and so on; see the functions below."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import merge, vault
from paperloom.plans.library import papers
from paperloom.plans.registry import query, table
from paperloom.plans.triage import feedback

V = """WITH pp AS (SELECT doc_id AS paper_id, n_chars // 3000 + 1 AS n_pages, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 60) AS first_seen, string_split(text, chr(10))[1] AS title, text, lang, source FROM documents),
sd AS (SELECT label AS profile, vec_id AS paper_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 8),
sv AS (SELECT user_id % 10 AS profile, event_id % 300 AS paper_id, min(ts) AS vaulted_at FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
vs AS (SELECT paper_id AS version_id, paper_id + 1 AS canonical_id, paper_id % 3 AS owner FROM pp WHERE paper_id % 10 = 3),
up AS (SELECT paper_id % 3 AS "user", paper_id, first_seen + INTERVAL 90 DAY AS "at" FROM pp WHERE paper_id % 12 = 1 OR paper_id % 10 = 3),
rs AS (SELECT paper_id % 5 % 3 AS "user", paper_id, first_seen AS "at", paper_id % 5 AS researcher FROM pp WHERE paper_id % 6 = 2),
kp AS (SELECT paper_id % 3 AS "user", paper_id, first_seen AS "at" FROM pp WHERE paper_id % 25 = 7),
vp AS (SELECT "user", paper_id, max("at") AS "at" FROM (SELECT "user", paper_id, "at" FROM up UNION ALL SELECT "user", paper_id, "at" FROM rs UNION ALL SELECT "user", paper_id, "at" FROM kp UNION ALL SELECT sv.profile % 3, sv.paper_id, vaulted_at FROM sv JOIN pp ON pp.paper_id = sv.paper_id
  UNION ALL SELECT sd.profile % 3, sd.paper_id, first_seen FROM sd JOIN pp ON pp.paper_id = sd.paper_id) GROUP BY 1, 2),
vl AS (SELECT * FROM vp WHERE NOT EXISTS (SELECT 1 FROM vp m JOIN vs ON vs.version_id = m.paper_id WHERE m."user" = vp."user" AND vs.canonical_id = vp.paper_id)),
tg AS (SELECT DISTINCT profile % 3 AS "user", 'p' || profile AS slug, paper_id FROM (SELECT profile, paper_id FROM sd UNION ALL SELECT profile, paper_id FROM sv) x),
tv AS (SELECT * FROM tg UNION SELECT "user", slug, version_id FROM tg JOIN vs ON vs.canonical_id = tg.paper_id AND vs.owner = tg."user")
"""


class Base:
    """The tables of a vault, out of the test tables."""

    def __init__(self, spark, d):
        i = F.col("paper_id")
        day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(paper_id % 60 as int))")
        docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), (F.floor(F.col("n_chars") / 3000) + 1).alias("n_pages"))
        self.papers = docs.withColumn("first_seen", day)
        self.versions = self.papers.where(i % 10 == 3).select(i.alias("version_id"), (i + 1).alias("canonical_id"), (i % 3).alias("owner"))
        w = Window.partitionBy("label").orderBy("vec_id")
        self.seeds = table(spark, d, "embeddings").withColumn("n", F.row_number().over(w)).where("n <= 8").select(F.col("label").cast("long").alias("profile"), F.col("vec_id").alias("paper_id"))
        self.saved = feedback(spark, d).where("action = 'saved'").groupBy("profile", "paper_id").agg(F.min("ts").alias("vaulted_at"))
        own = self.papers.select((i % 3).alias("user"), "paper_id", F.col("first_seen").alias("at"))
        self.uploads = own.where((i % 12 == 1) | (i % 10 == 3)).withColumn("at", F.col("at") + F.expr("interval 90 days"))
        self.researched = self.papers.where(i % 6 == 2).select((i % 5 % 3).alias("user"), "paper_id", F.col("first_seen").alias("at"), (i % 5).alias("researcher"))
        self.kept = own.where(i % 25 == 7)
        user = (F.col("profile") % 3).alias("user")
        there = self.papers.select("paper_id", "first_seen")
        by_save = self.saved.join(there, "paper_id").select(user, "paper_id", F.col("vaulted_at").alias("at"))
        by_seed = self.seeds.join(there, "paper_id").select(user, "paper_id", F.col("first_seen").alias("at"))
        self.members = vault.members(self.uploads, self.researched.drop("researcher"), self.kept, by_save, by_seed)
        direct = self.seeds.unionByName(self.saved.drop("vaulted_at"))
        self.tags = direct.select(user, F.concat(F.lit("p"), "profile").alias("slug"), "paper_id").distinct()


@query("a05_vault_stats", V + """SELECT "user", count(*) AS docs, sum(n_pages)::BIGINT AS pages, max("at") AS last_ingest FROM vl JOIN pp ON pp.paper_id = vl.paper_id GROUP BY "user" """)
def a05(spark, d):
    """Documents, pages and last event of each user's vault, from five ways in."""
    b = Base(spark, d)
    rows = vault.without_shadowed(b.members, b.versions, "user").join(b.papers, "paper_id")
    return rows.groupBy("user").agg(F.count("*").alias("docs"), F.sum("n_pages").alias("pages"), F.max("at").alias("last_ingest"))


@query("a06_tag_counts", V + """SELECT "user", slug, count(*) AS n FROM tv WHERE NOT EXISTS (SELECT 1 FROM tv m JOIN vs ON vs.version_id = m.paper_id WHERE m."user" = tv."user" AND m.slug = tv.slug AND vs.canonical_id = tv.paper_id) GROUP BY 1, 2""")
def a06(spark, d):
    b = Base(spark, d)
    rows = vault.without_shadowed(vault.with_versions(b.tags, b.versions), b.versions, "user", "slug")
    return rows.groupBy("user", "slug").agg(F.count("*").alias("n"))


@query("u08_vault_list", V + """SELECT "user", paper_id, "at" FROM vl""")
def u08(spark, d):
    b = Base(spark, d)
    return vault.without_shadowed(b.members, b.versions, "user").select("user", "paper_id", "at")


@query("u09_paper_tags", V + """SELECT "user", paper_id, string_agg(slug, ',' ORDER BY slug) AS slugs FROM tv GROUP BY 1, 2""")
def u09(spark, d):
    """The slugs of each paper, those of its public record included."""
    b = Base(spark, d)
    return vault.with_versions(b.tags, b.versions).groupBy("user", "paper_id").agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("slugs"))


@query("u07_refresh_sets", V + """SELECT rs.researcher, rs.paper_id, CASE WHEN EXISTS (SELECT 1 FROM vl WHERE vl."user" = rs."user" AND vl.paper_id = rs.paper_id) THEN 'saved' WHEN EXISTS (SELECT 1 FROM vl JOIN vs ON vs.version_id = vl.paper_id WHERE vl."user" = rs."user" AND vs.canonical_id = rs.paper_id) THEN 'version' ELSE 'new' END AS state FROM rs""")
def u07(spark, d):
    """A researcher's listed works: in the vault by id, by a version of theirs, or new."""
    b = Base(spark, d)
    there = vault.without_shadowed(b.members, b.versions, "user").select("user", "paper_id")
    own = there.join(b.versions, F.col("paper_id") == F.col("version_id")).select("user", F.col("canonical_id").alias("paper_id")).distinct().withColumn("v", F.lit(True))
    out = b.researched.join(there.withColumn("s", F.lit(True)), ["user", "paper_id"], "left").join(own, ["user", "paper_id"], "left")
    return out.select("researcher", "paper_id", F.when(F.col("s"), "saved").when(F.col("v"), "version").otherwise("new").alias("state"))


@query("p19_owned_papers", V + """SELECT u."user", pp.paper_id FROM pp, (SELECT unnest([0, 1, 2]) AS "user") u WHERE EXISTS (SELECT 1 FROM up WHERE up."user" = u."user" AND up.paper_id = pp.paper_id) OR EXISTS (SELECT 1 FROM rs WHERE rs."user" = u."user" AND rs.paper_id = pp.paper_id) OR EXISTS (SELECT 1 FROM sd WHERE sd.profile % 3 = u."user" AND sd.paper_id = pp.paper_id) OR EXISTS (SELECT 1 FROM sv WHERE sv.profile % 3 = u."user" AND sv.paper_id = pp.paper_id)""")
def p19(spark, d):
    b = Base(spark, d)
    each = b.papers.select("paper_id", F.explode(F.array(*[F.lit(u).cast("long") for u in range(3)])).alias("user"))
    by = lambda t: t.select((F.col("profile") % 3).alias("user"), "paper_id")
    return vault.owned(each, b.uploads, b.researched, by(b.seeds), by(b.saved)).select(F.col("user").cast("int").alias("user"), "paper_id")


@query("k06_insert_ignore", V + """SELECT "user", paper_id, "at", false AS is_new FROM kp UNION ALL SELECT "user", paper_id, "at", true FROM up WHERE NOT EXISTS (SELECT 1 FROM kp WHERE kp."user" = up."user" AND kp.paper_id = up.paper_id)""")
def k06(spark, d):
    b = Base(spark, d)
    return vault.insert_ignore(b.kept, b.uploads, ["user", "paper_id"])


@query("k16_retention", V + """SELECT "user", paper_id FROM kp UNION SELECT profile % 3, paper_id FROM sd WHERE profile = 1 UNION SELECT profile % 3, paper_id FROM sv WHERE profile = 1""")
def k16(spark, d):
    """Before an interest goes, its seeds and saves are kept for its user."""
    b = Base(spark, d)
    going = b.seeds.unionByName(b.saved.drop("vaulted_at")).where("profile = 1").select((F.col("profile") % 3).alias("user"), "paper_id")
    return b.kept.select("user", "paper_id").unionByName(going).distinct()


@query("k17_follow_public", V + """SELECT v.version_id, coalesce(nullif(c.title, ''), o.title) AS title, coalesce(c.lang, o.lang) AS lang, coalesce(c.source, o.source) AS source FROM vs v JOIN pp o ON o.paper_id = v.version_id LEFT JOIN pp c ON c.paper_id = v.canonical_id""")
def k17(spark, d):
    """Private versions with the bibliographic columns of their public records, where those have them."""
    b, p = Base(spark, d), papers(spark, d).select("paper_id", F.nullif("title", F.lit("")).alias("t"), "title", "lang", "source")
    own = b.versions.join(p.drop("t").withColumnRenamed("paper_id", "version_id"), "version_id")
    public = p.select(F.col("paper_id").alias("canonical_id"), "t", F.col("lang").alias("l"), F.col("source").alias("s"))
    return own.join(public, "canonical_id", "left").select("version_id", F.coalesce("t", "title").alias("title"), F.coalesce("l", "lang").alias("lang"), F.coalesce("s", "source").alias("source"))


@query("k18_edit_copy", V + """, dr AS (SELECT profile, paper_id FROM sd WHERE profile = 2 AND paper_id % 2 = 0 UNION SELECT 2, paper_id FROM sv WHERE profile = 2 AND paper_id % 7 = 0) SELECT profile, paper_id FROM sd WHERE profile <> 2 UNION ALL SELECT profile, paper_id FROM dr""")
def k18(spark, d):
    """Saving an edited copy: the rows of the interest are swapped for those of its draft."""
    b = Base(spark, d)
    draft = b.seeds.where("profile = 2 and paper_id % 2 = 0").unionByName(b.saved.where("profile = 2 and paper_id % 7 = 0").drop("vaulted_at")).distinct()
    return merge.swapped(b.seeds, draft, "profile")


@query("k19_tombstones", V + """, gone AS (SELECT profile, paper_id FROM sv WHERE paper_id % 4 = 0), scan AS (SELECT profile, max(vaulted_at) AS clean FROM sv WHERE paper_id % 5 = 0 GROUP BY 1)
SELECT g.profile, g.paper_id FROM gone g JOIN sv ON sv.profile = g.profile AND sv.paper_id = g.paper_id LEFT JOIN scan ON scan.profile = g.profile WHERE scan.clean IS NULL OR scan.clean <= sv.vaulted_at""")
def k19(spark, d):
    """Marks of deleted seeds stay until a later clean scan of their interest."""
    b = Base(spark, d)
    clean = b.saved.where("paper_id % 5 = 0").groupBy("profile").agg(F.max("vaulted_at").alias("clean"))
    marks = b.saved.where("paper_id % 4 = 0").join(clean, "profile", "left")
    return marks.where(F.col("clean").isNull() | (F.col("clean") <= F.col("vaulted_at"))).select("profile", "paper_id")


@query("k20_fill_missing", V + """SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN source || '!' ELSE lang END AS lang, coalesce(CASE WHEN paper_id % 3 <> 0 THEN first_seen END, first_seen + INTERVAL 1 DAY) AS date FROM pp""")
def k20(spark, d):
    """Authors and dates are filled in only where there are none."""
    b = Base(spark, d)
    p = papers(spark, d).join(b.papers.select("paper_id", "first_seen"), "paper_id")
    old = p.select("paper_id", F.when(F.col("paper_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("paper_id") % 3 != 0, F.col("first_seen")).alias("date"))
    new = p.select("paper_id", F.when(F.col("paper_id") % 4 == 0, F.concat("source", F.lit("!"))).alias("lang"), (F.col("first_seen") + F.expr("interval 1 day")).alias("date"))
    return merge.merged(old, new, ["paper_id"], {"lang": "fill_missing", "date": "fill_missing"}).drop("is_new")


@query("k21_rewritten_scores", """SELECT event_id, round(2 * ((value % 1.0 + 1.0) / 2) - 1, 9) AS score_raw, round(((event_id * 37) % 1000) / 1000.0 + 0.0004, 3) AS bar FROM events""")
def k21(spark, d):
    """Legacy scores as raw ones, and bars on their grid of three places."""
    e = table(spark, d, "events")
    legacy = (F.col("value") % 1.0 + 1.0) / 2
    return e.select("event_id", F.round(2 * legacy - 1, 9).alias("score_raw"), F.round((F.col("event_id") * 37 % 1000) / 1000.0 + 0.0004, 3).alias("bar"))


@query("t08_saved_lists", V + """SELECT sv.profile, sv.paper_id, vaulted_at FROM sv JOIN pp ON pp.paper_id = sv.paper_id WHERE contains(lower(title), 'a') QUALIFY row_number() OVER (PARTITION BY sv.profile ORDER BY vaulted_at DESC, sv.paper_id) <= 200""")
def t08(spark, d):
    """Saved papers whose title holds a text, case aside, latest first."""
    b = Base(spark, d)
    s = b.saved.join(papers(spark, d).select("paper_id", "title"), "paper_id").where(F.lower("title").contains("a"))
    n = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("vaulted_at"), "paper_id"))
    return s.withColumn("n", n).where("n <= 200").select("profile", "paper_id", "vaulted_at")


@query("w11_custom_order", """SELECT c_nationkey AS "user", c_custkey AS researcher, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 END ASC NULLS LAST, c_custkey % 5 <> 0, lower(c_name), c_custkey) - 1 AS place FROM customer""")
def w11(spark, d):
    """A user's list: placed ones first, then themselves and followed ones, by name and id."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("position", F.when(k % 3 == 0, k % 10))
    out = vault.ordered(c, "c_nationkey", F.col("position").asc_nulls_last(), k % 5 != 0, F.lower("c_name"), k)
    return out.select(F.col("c_nationkey").alias("user"), k.alias("researcher"), F.col("place").cast("long").alias("place"))


@query("w13_moved_in_list", """WITH x AS (SELECT c_nationkey AS g, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer), m AS (SELECT CASE WHEN id % 10 = 0 THEN 3 ELSE g END AS g, id, id % 10 = 0 AND g <> 3 AS moved, place FROM x)
SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY moved, CASE WHEN NOT moved THEN place END, id) - 1 AS place FROM m""")
def w13(spark, d):
    """Elements that change group go to the end of the new one; places are dense again in both."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"))
    x = vault.ordered(c, "g", "id")
    move = F.col("id") % 10 == 0
    moved = move & (F.col("g") != 3)
    m = x.select(F.when(move, 3).otherwise(F.col("g")).alias("g"), "id", moved.alias("moved"), F.when(~moved, F.col("place")).alias("old"))
    return vault.ordered(m, "g", "moved", "old", "id").select("g", "id", F.col("place").cast("long").alias("place"))


@query("j18_seed_twins", V + """, x AS (SELECT paper_id, sha256(text) AS file, 'D' || paper_id % 400 AS doi FROM pp), s AS (SELECT profile, x.* FROM sd JOIN x ON x.paper_id = sd.paper_id),
t AS (SELECT s.profile, s.paper_id, x.paper_id AS twin, 'file' AS way FROM s JOIN x ON x.file = s.file UNION ALL SELECT s.profile, s.paper_id, x.paper_id, 'doi' FROM s JOIN x ON lower(x.doi) = lower(s.doi) UNION ALL SELECT s.profile, s.paper_id, version_id, 'work' FROM s JOIN vs ON vs.canonical_id = s.paper_id)
SELECT profile, paper_id, twin, min(way) AS way FROM t WHERE twin <> paper_id GROUP BY 1, 2, 3""")
def j18(spark, d):
    b = Base(spark, d)
    p = papers(spark, d).select("paper_id", F.sha2("text", 256).alias("file"), F.concat(F.lit("D"), F.col("paper_id") % 400).alias("doi"))
    return vault.twins(b.seeds, p, b.versions)


RUNS = """WITH r AS (SELECT o_orderkey AS run, o_custkey AS profile, o_orderdate AS started, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 20 MINUTE END AS finished, CASE o_orderkey % 5 WHEN 0 THEN 'orcid-import' WHEN 1 THEN 'dry-run-import' ELSE 'scan' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CAST(trunc(o_totalprice) AS BIGINT) % 500 AS n_fetched FROM orders),
ls AS (SELECT * FROM r WHERE kind NOT LIKE '%import' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY run DESC) = 1)
"""


def runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("run"), F.col("o_custkey").alias("profile"), F.col("o_orderdate").alias("started"), F.when(k % 4 != 0, F.col("o_orderdate") + F.expr("interval 20 minutes")).alias("finished"), F.when(k % 5 == 0, "orcid-import").when(k % 5 == 1, "dry-run-import").otherwise("scan").alias("kind"), F.when(k % 4 == 0, "running").when(k % 7 == 0, "failed").otherwise("done").alias("status"), (F.col("o_totalprice").cast("long") % 500).alias("n_fetched"))


def latest_scans(spark, d):
    """The last scan of each profile, imports aside."""
    r = runs(spark, d).where(~F.col("kind").like("%import"))
    return r.groupBy("profile").agg(F.max_by(F.struct("run", "finished", "status", "n_fetched"), "run").alias("r")).select("profile", "r.*")


@query("a07_scan_metrics", RUNS + "SELECT profile % 50 AS \"user\", max(finished) AS finished, sum(coalesce(n_fetched, 0))::BIGINT AS scored FROM ls GROUP BY 1")
def a07(spark, d):
    """P-07, J-13: over the latest scan of each of a user's profiles."""
    return latest_scans(spark, d).groupBy((F.col("profile") % 50).alias("user")).agg(F.max("finished").alias("finished"), F.sum(F.coalesce("n_fetched", F.lit(0))).alias("scored"))


@query("p08_in_flight", RUNS + "SELECT run, started > TIMESTAMP '1998-07-01 00:00:00' - CASE WHEN kind LIKE '%import' THEN INTERVAL 30 MINUTE ELSE INTERVAL 120 MINUTE END * 24 AS in_flight FROM r WHERE status = 'running'")
def p08(spark, d):
    """Whether a run that has not ended may still be at work; a day stands for an hour in the test tables."""
    now = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    slack = F.when(F.col("kind").like("%import"), F.expr("interval 720 minutes")).otherwise(F.expr("interval 2880 minutes"))
    return runs(spark, d).where("status = 'running'").select("run", (F.col("started") > now - slack).alias("in_flight"))


@query("j20_latest_status", RUNS + "SELECT c_custkey AS profile, (SELECT status FROM r WHERE r.profile = c_custkey ORDER BY run DESC LIMIT 1) AS status, (SELECT max(finished) FROM r WHERE r.profile = c_custkey AND status = 'done') AS last_done FROM customer")
def j20(spark, d):
    r = runs(spark, d).groupBy("profile").agg(F.max_by("status", "run").alias("status"), F.max(F.when(F.col("status") == "done", F.col("finished"))).alias("last_done"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("profile")).join(r, "profile", "left").select("profile", "status", "last_done")


@query("a34_draft_status", RUNS + ", s AS (SELECT o_custkey AS profile, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey AS profile, CASE WHEN i.status = 'running' THEN 'importing' WHEN coalesce(s.n, 0) > 0 THEN 'seeded' WHEN i.status = 'failed' THEN 'failed' ELSE 'empty' END AS phase FROM customer LEFT JOIN (SELECT * FROM r WHERE kind LIKE '%import' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY run DESC) = 1) i ON i.profile = c_custkey LEFT JOIN s ON s.profile = c_custkey")
def a34(spark, d):
    """The phase of a draft: its latest import, and whether it has seeds."""
    last = runs(spark, d).where(F.col("kind").like("%import")).groupBy("profile").agg(F.max_by("status", "run").alias("status"))
    seeds = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("profile")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("profile")).join(last, "profile", "left").join(seeds, "profile", "left")
    phase = F.when(F.col("status") == "running", "importing").when(F.coalesce("n", F.lit(0)) > 0, "seeded").when(F.col("status") == "failed", "failed").otherwise("empty")
    return c.select("profile", phase.alias("phase"))


@query("j19_enabled_schedules", "SELECT c_custkey AS profile, n_name AS \"user\", c_custkey % 24 AS hour FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 <> 0 AND c_acctbal > 0")
def j19(spark, d):
    c = table(spark, d, "customer").where((F.col("c_custkey") % 4 != 0) & (F.col("c_acctbal") > 0))
    n = table(spark, d, "nation")
    return c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("profile"), F.col("n_name").alias("user"), (F.col("c_custkey") % 24).alias("hour"))


@query("t12_resolved_cards", V + """, a AS (SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 END AS asked FROM documents)
SELECT a.paper_id, sv.profile FROM a JOIN sv ON sv.paper_id = a.paper_id AND (asked IS NULL OR sv.profile = asked) QUALIFY row_number() OVER (PARTITION BY a.paper_id ORDER BY vaulted_at DESC, sv.profile) = 1""")
def t12(spark, d):
    """A card's row: that of the interest asked for, else the one fetched last."""
    b, i = Base(spark, d), F.col("paper_id")
    asked = b.papers.select("paper_id", F.when(i % 3 == 0, i % 10).alias("asked"))
    rows = b.saved.join(asked, "paper_id").where(F.col("asked").isNull() | (F.col("asked") == F.col("profile")))
    return rows.groupBy("paper_id").agg(F.max_by("profile", F.struct("vaulted_at", -F.col("profile"))).alias("profile"))


@query("u02_needed_models", V + """SELECT DISTINCT version_id % 4 AS model FROM vs UNION SELECT profile % 3 + 2 FROM sd""")
def u02(spark, d):
    b = Base(spark, d)
    return b.versions.select((F.col("version_id") % 4).alias("model")).union(b.seeds.select(F.col("profile") % 3 + 2)).distinct()


@query("u06_in_use", V + """SELECT paper_id, EXISTS (SELECT 1 FROM (SELECT paper_id AS i FROM sd UNION ALL SELECT paper_id FROM sv UNION ALL SELECT paper_id FROM up UNION ALL SELECT paper_id FROM rs UNION ALL SELECT paper_id FROM kp) x WHERE x.i = pp.paper_id) AS in_use FROM pp""")
def u06(spark, d):
    """Whether any of five tables refers to a paper."""
    b = Base(spark, d)
    uses = b.seeds.select("paper_id").union(b.saved.select("paper_id")).union(b.uploads.select("paper_id")).union(b.researched.select("paper_id")).union(b.kept.select("paper_id"))
    return b.papers.select("paper_id").join(uses.distinct().withColumn("u", F.lit(True)), "paper_id", "left").select("paper_id", F.coalesce("u", F.lit(False)).alias("in_use"))


@query("a30_uploaders", V + """SELECT DISTINCT "user" FROM up WHERE "at" >= TIMESTAMP '2024-04-01 00:00:00'""")
def a30(spark, d):
    return Base(spark, d).uploads.where("at >= timestamp_ntz'2024-04-01 00:00:00'").select("user").distinct()


@query("a04_feedback_counts", """SELECT user_id % 10 AS profile, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS saved, count(*) FILTER (event_type = 'error') AS dismissed, count(*) FILTER (event_type = 'click') AS unsaved, count(*) FILTER (event_type = 'view') AS shown, count(*) FILTER (event_type NOT IN ('purchase', 'error', 'click', 'view')) AS snoozed FROM events GROUP BY 1""")
def a04(spark, d):
    f = feedback(spark, d)
    return f.groupBy("profile").agg(F.count("*").alias("total"), *[F.sum((F.col("action") == a).cast("long")).alias(a) for a in ("saved", "dismissed", "unsaved", "shown", "snoozed")])
