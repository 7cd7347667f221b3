"""Queries on records and their copies, drafts, refreshed sources, and what a reader is shown of profiles, seeds and topics."""

from pyspark.sql import functions as F

from paperloom.functions import projections
from paperloom.functions import text as T
from paperloom.operators import merge, topics, vault
from paperloom.plans.library import P, papers
from paperloom.plans.registry import query, table
from paperloom.plans.triage import E, feedback
from paperloom.plans.vault import Base, V

TOPIC_SQL = "CASE WHEN {0} IS NOT NULL THEN {{'id': 'T' || {0}, 'name': 'Topic ' || {0} || ' of ' || lang, 's': CASE WHEN {0} % 10 <> 9 THEN 'S' || {0} // 3 END, 'f': 'F' || {0} // 10, 'd': 'D' || {0} // 30}} END"


def topic(k):
    """A topic with its levels; one in ten has no subfield."""
    level = lambda letter, n: F.struct(F.concat(F.lit(letter), F.floor(k / n)).alias("id"), F.concat(F.lit(f"{letter} "), F.floor(k / n)).alias("display_name"))
    subfield = F.when(k % 10 != 9, level("S", 3))
    t = F.struct(F.concat(F.lit("T"), k).alias("id"), F.concat(F.lit("Topic "), k, F.lit(" of "), "lang").alias("display_name"), subfield.alias("subfield"), level("F", 10).alias("field"), level("D", 30).alias("domain"))
    return F.when(k.isNotNull(), t)


@query("a08_four_levels", f"""WITH p AS (SELECT doc_id AS paper_id, lang, doc_id % 60 AS a, n_chars % 60 AS b FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL),
m AS (SELECT paper_id, unnest([{TOPIC_SQL.format('CASE WHEN paper_id % 7 <> 0 THEN a END')}, {TOPIC_SQL.format('a')}, {TOPIC_SQL.format('b')}]) AS t, unnest([0, 1, 2]) AS pos FROM p),
n AS (SELECT paper_id, pos, 'topic' AS level, t.id AS id, t.name AS name FROM m WHERE t IS NOT NULL UNION ALL SELECT paper_id, pos, 'subfield', t.s, 'S ' || t.s[2:] FROM m WHERE t.s IS NOT NULL UNION ALL SELECT paper_id, pos, 'field', t.f, 'F ' || t.f[2:] FROM m WHERE t IS NOT NULL UNION ALL SELECT paper_id, pos, 'domain', t.d, 'D ' || t.d[2:] FROM m WHERE t IS NOT NULL),
c AS (SELECT level, id, min_by(name, paper_id * 10 + pos) AS name, count(*) AS count, count(DISTINCT paper_id) AS papers, min(paper_id * 10 + pos) AS f FROM n GROUP BY 1, 2)
SELECT level, id, name, count, papers, row_number() OVER (PARTITION BY level ORDER BY count DESC, f) AS rank FROM c QUALIFY rank <= 8""")
def a08_four_levels(spark, d):
    """Topics of the corpus at four levels: the primary topic counts again where it is listed, a paper once."""
    p = table(spark, d, "documents").where("lang is not null and n_chars is not null").withColumns({"a": F.col("doc_id") % 60, "b": F.col("n_chars") % 60})
    works = p.select(F.col("doc_id").alias("paper_id"), topic(F.when(F.col("doc_id") % 7 != 0, F.col("a"))).alias("primary_topic"), F.array(topic(F.col("a")), topic(F.col("b"))).alias("topics"))
    return topics.hierarchy_counts(topics.level_mentions(works)).withColumn("rank", F.col("rank").cast("long"))


@query("w06_marked_copies", P + """, c AS (SELECT paper_id, paper_id % 20 AS person, nullif(left(norm, 2), '') AS key, CASE paper_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS claim, (dk IS NOT NULL)::INT AS doi, (coalesce(length(text), 0) > 1000)::INT AS abstract, cited FROM k)
SELECT person, paper_id, CASE WHEN key IS NOT NULL AND best <> paper_id THEN best END AS duplicate_of FROM (SELECT *, first_value(paper_id) OVER (PARTITION BY person, key ORDER BY claim DESC, doi DESC, abstract DESC, cited DESC, paper_id) AS best FROM c) x""")
def w06_marked(spark, d):
    """Copies of a person's works by key: which one is kept, by claim, DOI, abstract and citations; all stay listed."""
    i = F.col("paper_id")
    c = papers(spark, d).select("paper_id", (i % 20).alias("person"), F.nullif(F.substring(T.normalize_title(F.col("title")), 1, 2), F.lit("")).alias("key"), F.when(i % 5 == 0, True).when(i % 5 == 1, False).alias("claimed"), T.doi_key(F.col("doi")).alias("doi"), (F.length("text") > 1000).alias("abstract"), "cited")
    return merge.marked_copies(c, ["person", "key"], "paper_id", merge.version_rank(*map(F.col, ("claimed", "doi", "abstract", "cited")))).select("person", "paper_id", "duplicate_of")


REFRESH = P + """, l AS (SELECT paper_id % 30 AS researcher, 'W' || paper_id AS work, dk AS doi, paper_id FROM k WHERE paper_id % 3 <> 2),
s AS (SELECT paper_id % 30 AS researcher, CASE WHEN paper_id % 4 = 1 THEN 'M' || paper_id ELSE 'W' || paper_id END AS paper_id, CASE WHEN paper_id % 9 = 4 THEN 'W' || paper_id END AS source_id, CASE WHEN paper_id % 8 <> 3 THEN dk END AS doi, paper_id % 11 <> 0 AS resolved, paper_id % 22 = 0 AS synthetic FROM k WHERE paper_id % 5 <> 0)
"""


@query("u07_refreshed_works", REFRESH + """SELECT researcher, work, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.researcher = l.researcher AND (resolved OR synthetic) AND (s.paper_id = l.work OR s.source_id = l.work OR s.doi = l.doi)) OR l.paper_id % 13 = 0 THEN 'saved' WHEN l.paper_id % 13 = 1 THEN 'skipped' ELSE 'new' END AS state FROM l""")
def u07_refreshed(spark, d):
    """A researcher's source read again: what is saved by id, source id or DOI, marked a duplicate or left out, and new."""
    i = F.col("paper_id")
    p = papers(spark, d).select((i % 30).alias("researcher"), F.concat(F.lit("W"), i).alias("work"), T.doi_key(F.col("doi")).alias("doi"), "paper_id")
    works = p.where(i % 3 != 2)
    stored = p.where(i % 5 != 0).select("researcher", F.when(i % 9 == 4, F.col("work")).alias("source_id"), F.when(i % 8 != 3, F.col("doi")).alias("doi"), (i % 11 != 0).alias("resolved"), (i % 22 == 0).alias("synthetic"), F.when(i % 4 == 1, F.concat(F.lit("M"), i)).otherwise(F.col("work")).alias("paper_id"))
    marks = works.where(i % 13 <= 1).select("researcher", "work", F.when(i % 13 == 0, "duplicate").otherwise("skipped").alias("mark"))
    return vault.refreshed(works.drop("paper_id"), stored, marks)


@query("k17_followed_columns", V + """, x AS (SELECT paper_id, CASE WHEN paper_id % 3 <> 0 THEN '10.1/' || paper_id END AS doi, CASE WHEN paper_id % 4 <> 0 THEN 2000 + paper_id % 25 END AS year, source AS venue, CASE WHEN paper_id % 2 = 0 THEN strftime(first_seen, '%Y-%m-%d') END AS publication_date, lang AS authors, CASE WHEN n_pages > 1 THEN 'https://x.org/' || paper_id END AS pdf_url, CASE WHEN paper_id % 8 = 4 THEN 'gold' END AS oa_status, sha256(title) AS title FROM pp)
SELECT o.paper_id, o.title, coalesce(c.doi, o.doi) AS doi, coalesce(c.year, o.year) AS year, coalesce(c.venue, o.venue) AS venue, coalesce(c.publication_date, o.publication_date) AS publication_date, coalesce(c.authors, o.authors) AS authors, coalesce(c.pdf_url, o.pdf_url) AS pdf_url, coalesce(c.oa_status, o.oa_status) AS oa_status FROM x o LEFT JOIN vs ON vs.version_id = o.paper_id LEFT JOIN x c ON c.paper_id = vs.canonical_id""")
def k17_followed(spark, d):
    """All papers, the private versions among them with the seven columns that follow their public records."""
    b, i = Base(spark, d), F.col("paper_id")
    p = papers(spark, d).join(b.papers.select("paper_id", "first_seen", "n_pages"), "paper_id")
    x = p.select("paper_id", F.sha2("title", 256).alias("title"), F.when(i % 3 != 0, F.concat(F.lit("10.1/"), i)).alias("doi"), F.when(i % 4 != 0, F.col("year")).alias("year"), F.col("source").alias("venue"), F.when(i % 2 == 0, F.date_format("first_seen", "yyyy-MM-dd")).alias("publication_date"), F.col("lang").alias("authors"), F.when(F.col("n_pages") > 1, F.concat(F.lit("https://x.org/"), i)).alias("pdf_url"), F.when(i % 8 == 4, "gold").alias("oa_status"))
    return vault.following(x, b.versions)


@query("k18_opened_copies", V + "SELECT profile, paper_id FROM sd UNION ALL SELECT profile + 1000, paper_id FROM sd WHERE profile % 3 = 1")
def k18_opened(spark, d):
    """Edits of some interests begin: their seeds stand under a draft as well."""
    b = Base(spark, d)
    drafts = b.seeds.where("profile % 3 = 1").select("profile", (F.col("profile") + 1000).alias("draft")).distinct()
    return merge.opened(b.seeds, "profile", drafts)


@query("k18_discarded_drafts", V + """, br AS (SELECT DISTINCT paper_id % 7 AS draft, paper_id FROM pp WHERE paper_id % 2 = 1 OR paper_id % 10 = 4 UNION SELECT 8, paper_id FROM pp WHERE paper_id % 21 = 1), us AS (SELECT paper_id FROM sd UNION SELECT paper_id FROM sv UNION SELECT paper_id FROM kp),
al AS (SELECT paper_id, min(draft) AS draft FROM br GROUP BY paper_id HAVING count(*) = 1), un AS (SELECT * FROM al WHERE paper_id NOT IN (SELECT paper_id FROM us)), gv AS (SELECT * FROM un WHERE paper_id IN (SELECT version_id FROM vs))
SELECT draft, paper_id FROM gv UNION ALL SELECT draft, paper_id FROM un WHERE paper_id NOT IN (SELECT version_id FROM vs) AND NOT EXISTS (SELECT 1 FROM vs LEFT JOIN gv ON gv.paper_id = vs.version_id WHERE vs.canonical_id = un.paper_id AND gv.draft IS DISTINCT FROM un.draft)""")
def k18_discarded(spark, d):
    """What goes with discarded drafts: papers that nothing else uses, a public record only if its versions go too."""
    b, i = Base(spark, d), F.col("paper_id")
    brought = b.papers.where((i % 2 == 1) | (i % 10 == 4)).select((i % 7).alias("draft"), "paper_id").unionByName(b.papers.where(i % 21 == 1).select(F.lit(8).cast("long").alias("draft"), "paper_id"))
    uses = b.seeds.select("paper_id").unionByName(b.saved.select("paper_id")).unionByName(b.kept.select("paper_id"))
    return vault.discarded(brought, uses, b.versions)


@query("p18_profiles", E + """, ac AS (SELECT profile, sum((action = 'saved')::INT)::BIGINT AS saves, sum((action = 'dismissed')::INT)::BIGINT AS dismisses FROM e WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY profile),
x AS (SELECT c_custkey AS profile, CASE WHEN c_custkey % 4 <> 0 THEN lower(replace(c_name, '#', '-')) END AS slug, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal / 10000, 6) END AS threshold, CASE WHEN c_custkey % 6 <> 0 THEN round(0.8 + (c_acctbal + 1000) / 60000, 6) END AS median, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 / 100.0 END AS iqr, c_custkey % 5 AS n, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS researcher_id FROM customer),
a AS (SELECT *, coalesce(slug, name) AS key, CASE WHEN median IS NOT NULL THEN CAST(round_even(100 * least(1, greatest(0, (median - 0.82) / (0.95 - 0.82))), 0) AS INT) END AS agreement FROM x)
SELECT a.profile, key, name, ('0x' || substr(sha1(key), 1, 4))::INT % 360 AS hue, CASE WHEN n >= 2 AND median >= 0.9 THEN 'ok' WHEN n < 2 OR median IS NULL OR median >= 0.86 THEN 'warn' ELSE 'err' END AS health, coalesce(threshold, 0) AS threshold, coalesce(median, 0) AS coherence, n::INT AS seeds, coalesce(saves, 0) AS saves30, coalesce(dismisses, 0) AS dismisses30, a.profile % 9 = 0 AS is_draft,
CASE WHEN n < 1 THEN 'none' WHEN n < 2 THEN 'single' WHEN median IS NULL THEN 'none' WHEN median >= 0.9 AND (coalesce(iqr, 0) < 0.07 OR agreement >= 80) THEN 'focused' WHEN median >= 0.86 THEN 'broad' ELSE 'mixed' END AS coherence_label, CASE WHEN n >= 2 THEN agreement END AS agreement, iqr AS seed_sim_min, median AS seed_sim_max, researcher_id, NULL::INT AS year_from, (2000 + n)::INT AS year_to FROM a LEFT JOIN ac ON ac.profile = a.profile""")
def p18_profiles(spark, d):
    """Profiles as a list shows them: key, hue, health, agreement, and the actions of thirty days."""
    k, n = F.col("c_custkey"), (F.col("c_custkey") % 5).alias("n_seed")
    median, iqr = F.when(k % 6 != 0, F.round(0.8 + (F.col("c_acctbal") + 1000) / 60000, 6)), F.when(k % 7 != 0, k % 10 / 100.0)
    rows = table(spark, d, "customer").select(k.alias("profile"), F.when(k % 4 != 0, F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("slug"), F.col("c_name").alias("name"), F.when(k % 5 != 0, F.round(F.col("c_acctbal") / 10000, 6)).alias("threshold"), median.alias("coherence_median"), iqr.alias("coherence_iqr"), n, iqr.alias("seed_sim_min"), median.alias("seed_sim_max"), (k % 9 == 0).cast("int").alias("is_draft"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("researcher_id"), F.lit(None).cast("int").alias("year_from"), (2000 + k % 5).cast("int").alias("year_to"))
    f = feedback(spark, d).where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    actions = f.groupBy("profile").agg(F.count_if(F.col("action") == "saved").alias("saves"), F.count_if(F.col("action") == "dismissed").alias("dismisses"))
    return projections.profiles(rows, actions)


@query("p18_seeds", V + """, ve AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id % 50 ORDER BY paper_id) AS version, first_seen AS "at" FROM pp WHERE paper_id % 50 < 10 QUALIFY count(*) OVER (PARTITION BY paper_id % 50) > 1)
SELECT sd.profile, sd.paper_id, canonical_id, (row_number() OVER (PARTITION BY sd.profile ORDER BY sd.paper_id) - 1)::INT AS idx, version, coalesce(up."at", ve."at") AS uploaded, sha256(coalesce(title, '')) AS title, CASE WHEN sd.paper_id % 6 = 0 THEN 0 ELSE 2000 + sd.paper_id % 25 END AS year, coalesce(CASE WHEN sd.paper_id % 4 <> 0 THEN n_pages / 100 END, 0)::DOUBLE AS coh
FROM sd JOIN pp ON pp.paper_id = sd.paper_id LEFT JOIN vs ON vs.version_id = sd.paper_id LEFT JOIN up ON up.paper_id = sd.paper_id LEFT JOIN ve ON ve.paper_id = sd.paper_id""")
def p18_seeds(spark, d):
    """Seeds with number, version and time of upload; a title's digest stands for it."""
    b, i = Base(spark, d), F.col("paper_id")
    p = papers(spark, d).select("paper_id", "title", F.when(i % 6 != 0, F.col("year")).alias("year")).join(b.papers, "paper_id")
    rows = b.seeds.join(p, "paper_id").join(b.versions.select(F.col("version_id").alias("paper_id"), "canonical_id"), "paper_id", "left").join(b.uploads.select("paper_id", F.col("at").alias("uploaded_at")), "paper_id", "left")
    files = b.papers.where(i % 50 < 10).select("paper_id", (i % 50).alias("work"), F.col("first_seen").alias("at"))
    versions = merge.versions(files, "work", [i]).select("paper_id", F.col("version").cast("long").alias("version"), "at")
    out = projections.seeds(rows.withColumn("coh", F.when(i % 4 != 0, F.col("n_pages") / 100)), versions)
    return out.withColumn("title", F.sha2("title", 256))


@query("p18_topics", r"""WITH x AS (SELECT c_custkey AS profile, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '{"fields": []}' ELSE '{"topics": [{"id": "T' || c_custkey || '", "display_name": "' || c_name || '", "count": ' || c_nationkey || ', "papers": ' || c_nationkey // 2 || ', "on": ' || CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'null' ELSE '[1]' END || '}, {"id": "", "on": true}, {"id": "U' || c_nationkey || '", "source": "' || CASE WHEN c_custkey % 2 = 0 THEN 'umls' ELSE 'llm' END || '", "concept": "' || c_mktsegment || '", "confidence": ' || c_nationkey % 4 / 4.0 || ', "llm_label": "l"}, {"display_name": "none"}, {"id": "V1", "unmatched": ' || CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END || CASE WHEN c_custkey % 3 = 1 THEN ', "unmatched_why": "seed_removed"' ELSE '' END || '}]}' END AS j FROM customer),
u AS (SELECT profile, unnest(json_extract(j, '$.topics[*]')) AS t, unnest(range(0, 5)) AS place FROM x WHERE json_extract(j, '$.topics') IS NOT NULL)
SELECT profile, place::INT AS place, t->>'id' AS id, coalesce(t->>'display_name', '') AS name, coalesce((t->>'count')::INT, 0) AS count, (t->>'papers')::INT AS papers, coalesce(json_extract(t, '$.on')::VARCHAR NOT IN ('null', 'false', '0', '""', '[]', '{}'), true) AS is_on, t->>'source' AS source, t->>'llm_label' AS llm_label, CASE WHEN t->>'source' = 'umls' THEN t->>'concept' END AS umls_concept, CASE WHEN t->>'source' = 'umls' THEN (t->>'confidence')::DOUBLE END AS umls_confidence, CASE WHEN t->>'source' = 'umls' THEN t->>'mention' END AS umls_mention,
CASE WHEN profile % 2 = 0 THEN (t->>'id' = 'V1')::INT END AS new, CASE WHEN t->>'unmatched' = 'true' THEN 1 END AS unmatched, CASE WHEN t->>'unmatched' = 'true' THEN coalesce(t->>'unmatched_why', 'no_seed') END AS unmatched_why FROM u WHERE coalesce(t->>'id', '') <> ''""")
def p18_topics(spark, d):
    """Stored topic lists (JSON) as rows: flags of any kind, marks, and which topics are new."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    on = F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").when(k % 4 == 2, "null").otherwise("[1]")
    first = F.concat(F.lit('{"id": "T'), k, F.lit('", "display_name": "'), "c_name", F.lit('", "count": '), n, F.lit(', "papers": '), F.floor(n / 2), F.lit(', "on": '), on, F.lit("}"))
    second = F.concat(F.lit('{"id": "U'), n, F.lit('", "source": "'), F.when(k % 2 == 0, "umls").otherwise("llm"), F.lit('", "concept": "'), "c_mktsegment", F.lit('", "confidence": '), (n % 4 / 4.0).cast("string"), F.lit(', "llm_label": "l"}'))
    third = F.concat(F.lit('{"id": "V1", "unmatched": '), F.when(k % 3 == 0, "false").otherwise("true"), F.when(k % 3 == 1, ', "unmatched_why": "seed_removed"').otherwise(""), F.lit("}"))
    j = F.concat(F.lit('{"topics": ['), F.concat_ws(", ", first, F.lit('{"id": "", "on": true}'), second, F.lit('{"display_name": "none"}'), third), F.lit("]}"))
    rows = table(spark, d, "customer").select(k.alias("profile"), F.when(k % 10 == 0, None).when(k % 10 == 1, '{"fields": []}').otherwise(j).alias("filters"), F.when(k % 2 == 0, F.array(F.lit("V1"))).alias("brought"))
    return projections.topics(rows).withColumns({c: F.col(c).cast("int") for c in ("new", "unmatched")})
