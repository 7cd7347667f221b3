"""Queries on papers (`documents`), chunks, topics and gathering."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.vectors import doubles
from paperloom.operators import merge, predicates, retrieval, topics
from paperloom.plans.interest import cos
from paperloom.operators.resolve import shared_folder
from paperloom.plans.registry import query, table
from paperloom.sources import vectorindex

P = """WITH p AS (SELECT doc_id AS paper_id, text, lang, source, string_split(text, chr(10))[1] AS title, 2000 + doc_id % 25 AS year, (doc_id * 37) % 101 AS cited,
  CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1000/' || CAST(doc_id % 400 AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'doi:10.1000/' || CAST(doc_id % 400 AS VARCHAR) || '.' END AS doi FROM documents),
k AS (SELECT *, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') AS norm, CASE WHEN doi IS NOT NULL THEN '10.1000/' || CAST(paper_id % 400 AS VARCHAR) END AS dk FROM p),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM k)
"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), (F.col("doc_id") % 400).cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("doi:10.1000/"), (F.col("doc_id") % 400).cast("string"), F.lit(".")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text", "lang", "source", F.split("text", "\n")[0].alias("title"), (2000 + F.col("doc_id") % 25).alias("year"), (F.col("doc_id") * 37 % 101).alias("cited"), doi.alias("doi"))


@query("f01_title_keys", P + "SELECT paper_id, norm, CASE WHEN length(norm) >= 30 THEN norm ELSE '' END AS key, dk AS doi_key FROM k")
def f01(spark, d):
    return papers(spark, d).select("paper_id", T.normalize_title(F.col("title")).alias("norm"), T.title_key(F.col("title")).alias("key"), T.doi_key(F.col("doi")).alias("doi_key"))


@query("f07_slug_hue", P + "SELECT paper_id, substr(trim(regexp_replace(lower(left(title, 60)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 1, 80) AS slug, ('0x' || substr(sha1(source), 1, 4))::INT % 360 AS hue FROM k")
def f07(spark, d):
    return papers(spark, d).select("paper_id", T.slugify(F.substring("title", 1, 60)).alias("slug"), T.hue(F.col("source")).alias("hue"))


@query("f16_sha256", P + "SELECT paper_id, sha256(text) AS digest, substr(sha256(source || '|' || lang), 1, 16) AS config FROM p")
def f16(spark, d):
    return papers(spark, d).select("paper_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2(F.concat_ws("|", "source", "lang"), 256), 1, 16).alias("config"))


@query("f22_name_overlap", P + """, t AS (SELECT paper_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS a FROM p)
SELECT x.paper_id, round(len(list_intersect(x.a, y.a))::DOUBLE / greatest(len(list_distinct(list_concat(x.a, y.a))), 1), 6) AS overlap FROM t x JOIN t y ON y.paper_id = x.paper_id + 1""")
def f22(spark, d):
    a = papers(spark, d).select("paper_id", F.lower("title").alias("title"))
    b = a.select((F.col("paper_id") - 1).alias("paper_id"), F.col("title").alias("other"))
    return a.join(b, "paper_id").select("paper_id", F.round(T.word_overlap(F.col("title"), F.col("other")), 6).alias("overlap"))


@query("f12_chunks", P + """, c AS (SELECT paper_id, unnest(range(0, greatest(0, ceil((len(ws) - 120) / 100.0))::BIGINT + 1)) AS i, ws FROM w WHERE len(ws) > 0)
SELECT paper_id, CAST(i AS INT) AS chunk_index, CAST(paper_id AS VARCHAR) || '::chunk::' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS chunk_id, array_to_string(ws[i * 100 + 1 : i * 100 + 120], ' ') AS body FROM c""")
def f12(spark, d):
    """V-09 and K-11: chunks of 120 words, 20 shared, with deterministic ids."""
    c = papers(spark, d).select("paper_id", F.posexplode(T.chunks(F.col("text"), 120, 20)).alias("chunk_index", "body"))
    return c.select("paper_id", "chunk_index", F.format_string("%d::chunk::%04d", F.col("paper_id"), F.col("chunk_index") + 1).alias("chunk_id"), "body")


@query("f23_read_minutes", P + "SELECT paper_id, greatest(2, round_even(len(ws) / 200.0, 0))::INT AS minutes, CASE WHEN year BETWEEN 1000 AND 2025 THEN year END AS year, floor(cited / 101.0 * 10000 + 1e-9) / 10000 AS cited4 FROM w")
def f23(spark, d):
    return papers(spark, d).select("paper_id", T.read_minutes(F.col("text")).alias("minutes"), predicates.plausible_year(F.col("year"), 2024).alias("year"), T.floor4(F.col("cited") / 101.0).alias("cited4"))


REDACTED = "regexp_replace(regexp_replace(c, '(https?://[^\\s?''\"<>]+)\\?[^\\s''\"<>]*', '\\1', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g')"


def _message(text):
    """An error text with a query and an address, before the document's own text."""
    i = F.col("paper_id").cast("string")
    return F.concat(F.lit("see https://x.org/a?key="), i, F.lit(" or mail a"), i, F.lit("@b.org "), text)


def _redaction_sql(text: str) -> str:
    return P + f", c AS (SELECT paper_id, 'see https://x.org/a?key=' || CAST(paper_id AS VARCHAR) || ' or mail a' || CAST(paper_id AS VARCHAR) || '@b.org ' || {text} AS c FROM p), x AS (SELECT paper_id, {REDACTED} AS x FROM c) SELECT paper_id, CASE WHEN length(x) <= 500 THEN x ELSE substr(x, 1, 499) || '…' END AS redacted FROM x"


@query("f33_redaction", _redaction_sql("coalesce(source, '')"))
def f33(spark, d):
    return papers(spark, d).select("paper_id", T.redact(_message(F.coalesce("source", F.lit("")))).alias("redacted"))


@query("f33_redaction_whole", _redaction_sql("coalesce(text, '')"))
def f33_whole(spark, d):
    """Over the whole text, up to the 500 characters of the feature itself."""
    return papers(spark, d).select("paper_id", T.redact(_message(F.coalesce("text", F.lit("")))).alias("redacted"))


@query("w09_title_dedupe", P + """, o AS (SELECT *, CASE WHEN length(norm) >= 30 THEN norm ELSE '' END AS tk FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN tk = '' THEN CAST(paper_id AS VARCHAR) ELSE tk END ORDER BY cited DESC, paper_id) AS k1 FROM o)
SELECT paper_id, cited FROM r WHERE k1 = 1""")
def w09(spark, d):
    p = papers(spark, d)
    return merge.first_of(p, T.title_key(F.col("title")), [F.desc("cited"), F.col("paper_id")]).select("paper_id", "cited")


@query("w05_versions", P + "SELECT paper_id, dk AS work, row_number() OVER (PARTITION BY dk ORDER BY paper_id) AS version, count(*) OVER (PARTITION BY dk) AS copies FROM k WHERE dk IS NOT NULL QUALIFY copies > 1")
def w05(spark, d):
    p = papers(spark, d).select("paper_id", T.doi_key(F.col("doi")).alias("work")).where("work is not null")
    return merge.versions(p, "work", [F.col("paper_id")]).select("paper_id", "work", F.col("version").cast("long").alias("version"), "copies")


@query("w06_best_copy", P + "SELECT dk AS work, paper_id, cited FROM k WHERE dk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dk ORDER BY (lang = 'en') DESC, cited DESC, paper_id) = 1")
def w06(spark, d):
    p = papers(spark, d).withColumn("work", T.doi_key(F.col("doi"))).where("work is not null")
    return merge.first_of(p, F.col("work"), [F.desc(F.col("lang") == "en"), F.desc("cited"), F.col("paper_id")]).select("work", "paper_id", "cited")


@query("w07_copies_under_original", P + ", g AS (SELECT paper_id, coalesce(dk, CAST(paper_id AS VARCHAR)) AS g FROM k) SELECT paper_id, f, row_number() OVER (PARTITION BY f ORDER BY paper_id) AS position FROM (SELECT paper_id, min(paper_id) OVER (PARTITION BY g) AS f FROM g)")
def w07(spark, d):
    """Every paper, each work's copies right below its first: the list is in the order of (f, position), range-sorted."""
    p = papers(spark, d).select("paper_id", F.coalesce(T.doi_key(F.col("doi")), F.col("paper_id").cast("string")).alias("g"))
    f = p.groupBy("g").agg(F.min("paper_id").alias("f"))
    position = F.row_number().over(Window.partitionBy("f").orderBy("paper_id")).cast("long")
    return p.join(f, "g").select("paper_id", "f", position.alias("position")).orderBy("f", "position")


@query("w07_all_copies_under_original", P + ", g AS (SELECT paper_id, coalesce(dk, CAST(paper_id AS VARCHAR)) AS g FROM k) SELECT paper_id, min(paper_id) OVER (PARTITION BY g) AS f, row_number() OVER (PARTITION BY g ORDER BY paper_id) AS position FROM g")
def w07_all(spark, d):
    """Every paper with the least paper of its work and its place in the work; the list's order is (f, position)."""
    p = papers(spark, d).select("paper_id", F.coalesce(T.doi_key(F.col("doi")), F.col("paper_id").cast("string")).alias("g"))
    w = Window.partitionBy("g")
    return p.select("paper_id", F.min("paper_id").over(w).alias("f"), F.row_number().over(w.orderBy("paper_id")).cast("long").alias("position"))


@query("j10_entity_keys", P + """, e AS (SELECT paper_id, 'doi:' || dk AS key FROM k WHERE dk IS NOT NULL UNION ALL SELECT paper_id, 'title:' || norm FROM k WHERE length(norm) >= 30)
SELECT paper_id, min(o) AS owner FROM (SELECT paper_id, min(paper_id) OVER (PARTITION BY key) AS o FROM e) GROUP BY paper_id""")
def j10(spark, d):
    """The least owner of any key of a paper; owners by key are aggregated before the join, so common keys do no harm."""
    e = papers(spark, d).select("paper_id", F.explode(T.paper_keys(T.doi_key(F.col("doi")), F.col("title"))).alias("key"))
    return e.join(e.groupBy("key").agg(F.min("paper_id").alias("o")), "key").groupBy("paper_id").agg(F.min("o").alias("owner"))


@query("j11_resolution_ladder", P + """, a AS (SELECT paper_id, dk, norm FROM k), b AS (SELECT dk, min(paper_id) AS i FROM k WHERE dk IS NOT NULL AND paper_id % 2 = 0 GROUP BY dk), c AS (SELECT norm, min(paper_id) AS i FROM k WHERE paper_id % 5 = 0 AND length(norm) >= 30 GROUP BY norm)
SELECT a.paper_id, coalesce(b.i, c.i) AS resolved, CASE WHEN b.i IS NOT NULL THEN 'doi' WHEN c.i IS NOT NULL THEN 'title' ELSE 'synthetic' END AS rung FROM a LEFT JOIN b ON a.dk = b.dk LEFT JOIN c ON a.norm = c.norm""")
def j11(spark, d):
    k = papers(spark, d).select("paper_id", T.doi_key(F.col("doi")).alias("dk"), T.normalize_title(F.col("title")).alias("norm"))
    by_doi = k.where("dk is not null and paper_id % 2 = 0").groupBy("dk").agg(F.min("paper_id").alias("i1"))
    by_title = k.where("length(norm) >= 30 and paper_id % 5 = 0").groupBy("norm").agg(F.min("paper_id").alias("i2"))
    rung = F.when(F.col("i1").isNotNull(), "doi").when(F.col("i2").isNotNull(), "title").otherwise("synthetic")
    return k.join(by_doi, "dk", "left").join(by_title, "norm", "left").select("paper_id", F.coalesce("i1", "i2").alias("resolved"), rung.alias("rung"))


@query("k15_unused_papers", P + "SELECT paper_id FROM p WHERE paper_id NOT IN (SELECT vec_id FROM embeddings) AND paper_id NOT IN (SELECT doc_id FROM labels)")
def k15(spark, d):
    e, lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id")), table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))
    return merge.unused(papers(spark, d).select("paper_id"), "paper_id", e, lab)


@query("k01_paper_upsert", P + """, o AS (SELECT paper_id, title, year FROM p WHERE paper_id % 3 <> 0), n AS (SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN '' ELSE 'new ' || left(title, 20) END AS title, NULL::BIGINT AS year FROM p WHERE paper_id % 2 = 0)
SELECT coalesce(o.paper_id, n.paper_id) AS paper_id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(n.year, o.year) AS year, o.paper_id IS NULL AS is_new FROM o FULL JOIN n ON o.paper_id = n.paper_id""")
def k01(spark, d):
    p = papers(spark, d)
    new = p.where("paper_id % 2 = 0").select("paper_id", F.when(F.col("paper_id") % 4 == 0, "").otherwise(F.concat(F.lit("new "), F.substring("title", 1, 20))).alias("title"), F.lit(None).cast("long").alias("year"))
    return merge.merged(p.where("paper_id % 3 <> 0"), new, ["paper_id"], {"title": "text", "year": "fill"})


@query("a08_topic_hierarchy", P + """, m AS (SELECT paper_id, 0 AS pos, 'topic' AS level, source AS id, source AS name FROM p UNION ALL SELECT paper_id, 1, 'topic', 'src' || CAST(paper_id % 20 AS VARCHAR), 'src' || CAST(paper_id % 20 AS VARCHAR) FROM p UNION ALL SELECT paper_id, 0, 'field', lang, upper(lang) FROM p),
c AS (SELECT level, id, min_by(name, paper_id * 10 + pos) AS name, count(*) AS count, count(DISTINCT paper_id) AS papers, min(paper_id * 10 + pos) AS f FROM m GROUP BY 1, 2)
SELECT level, id, name, count, papers, row_number() OVER (PARTITION BY level ORDER BY count DESC, f) AS rank FROM c QUALIFY rank <= 8""")
def a08(spark, d):
    p, n = papers(spark, d), F.concat(F.lit("src"), (F.col("paper_id") % 20).cast("string"))
    m = F.array(*[F.struct(F.lit(pos).alias("pos"), F.lit(level).alias("level"), i.alias("id"), name.alias("name")) for pos, level, i, name in ((0, "topic", F.col("source"), F.col("source")), (1, "topic", n, n), (0, "field", F.col("lang"), F.upper("lang")))])
    out = topics.hierarchy_counts(p.select("paper_id", F.inline(m)))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("a09_prevalence", P + "SELECT source, round(count(DISTINCT paper_id)::DOUBLE / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY source")
def a09(spark, d):
    p = papers(spark, d)
    n = F.broadcast(p.agg(F.count("*").alias("n")))  # one row
    return p.groupBy("source").agg(F.countDistinct("paper_id").alias("k")).join(n, F.lit(True)).select("source", F.round(F.col("k") / F.col("n"), 6).alias("share"))


@query("a14_tiers", P + """, t AS (SELECT 1 AS tier, paper_id FROM p WHERE lang = 'es' AND source = 'src1' UNION ALL SELECT 2, paper_id FROM p WHERE lang = 'es' UNION ALL SELECT 3, paper_id FROM p WHERE lang IN ('es', 'de')),
f AS (SELECT paper_id, min(tier) AS tier FROM t GROUP BY paper_id), n AS (SELECT tier, sum(count(*)) OVER (ORDER BY tier) - count(*) AS before FROM f GROUP BY tier)
SELECT f.tier, f.paper_id FROM f JOIN n ON n.tier = f.tier WHERE before < 50""")
def a14(spark, d):
    p = papers(spark, d)
    cond = [(1, (F.col("lang") == "es") & (F.col("source") == "src1")), (2, F.col("lang") == "es"), (3, F.col("lang").isin("es", "de"))]
    rows = p.select("paper_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in cond]))).alias("tier"))
    return topics.tiers(rows, 50).select("tier", "paper_id")


@query("t09_most_cited", P + "SELECT source, paper_id, cited, row_number() OVER (PARTITION BY source ORDER BY cited DESC, paper_id) AS rank FROM p QUALIFY rank <= 10")
def t09(spark, d):
    return topics.most_cited(papers(spark, d), "source", 10).select("source", "paper_id", "cited", F.col("rank").cast("long").alias("rank"))


@query("w04_round_robin", P + """, r AS (SELECT source, paper_id, row_number() OVER (PARTITION BY source ORDER BY cited DESC, paper_id) AS rank FROM p QUALIFY rank <= 10)
SELECT source, paper_id, rank FROM r ORDER BY rank, source LIMIT 60""")
def w04(spark, d):
    """Topics are disjoint here, where the set form and the one-by-one rule agree."""
    r = topics.most_cited(papers(spark, d), "source", 10).withColumn("topic_pos", F.col("source"))
    return topics.dealt(r, 60).select("source", "paper_id", F.col("rank").cast("long").alias("rank"))


@query("w04_round_robin_exact")
def w04x(spark, d):
    """The one-by-one rule, with title keys; compared with the set form in the tests."""
    r = topics.most_cited(papers(spark, d), "source", 10)
    pos = F.dense_rank().over(Window.partitionBy("lang").orderBy("source"))
    r = r.select(F.col("lang").alias("profile"), pos.alias("topic_pos"), "rank", "paper_id", T.title_key(F.col("title")).alias("title_key"))
    return topics.round_robin(r, 30).select("profile", "paper_id", "position")


COLLECTION = "WITH c AS (SELECT vec_id AS chunk_id, vec_id // 8 AS paper_id, CASE vec_id % 4 WHEN 0 THEN '|p' || label || '|' WHEN 1 THEN '|p' || label || '|extra|' ELSE '|p' || label % 5 || '|' END AS slugs, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)\n"


def collection(spark, d):
    """Stored chunks: eight vectors a paper, tagged with the slugs of its profiles."""
    i, own = F.col("vec_id"), F.concat(F.lit("|p"), F.col("label"), F.lit("|"))
    slugs = F.when(i % 4 == 0, own).when(i % 4 == 1, F.concat(own, F.lit("extra|"))).otherwise(F.concat(F.lit("|p"), F.col("label") % 5, F.lit("|")))
    return table(spark, d, "embeddings").select(i.alias("chunk_id"), F.floor(i / 8).alias("paper_id"), slugs.alias("slugs"), doubles(F.col("embedding")).alias("v"))


@query("v08_chunk_retrieval", COLLECTION[:-1] + f""", q AS (SELECT chunk_id AS question, v AS w FROM c WHERE chunk_id IN (0, 111, 222)),
s AS (SELECT question, c.chunk_id, paper_id, round(1 - {cos('v', 'w')}, 9) AS far FROM c, q WHERE slugs IN ('|p1|', '|p2|', '|p3|')),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question ORDER BY far, chunk_id) <= 80),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question, paper_id ORDER BY far, chunk_id) <= 4)
SELECT question, chunk_id, paper_id, round(greatest(0, least(1, 1 - far)), 6) AS score, row_number() OVER (PARTITION BY question ORDER BY far, chunk_id) AS rank FROM b QUALIFY rank <= 20""")
def v08(spark, d):
    """W-03, F-35, F-36: passages for three questions within the scope of three profiles."""
    c = collection(spark, d)
    questions = c.where(F.col("chunk_id").isin(0, 111, 222)).select(F.col("chunk_id").alias("question"), F.col("v").alias("w"))
    return retrieval.retrieved(c, questions, ["p1", "p2", "p3"], 20).select("question", "chunk_id", "paper_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("v09_stored_index", COLLECTION[:-1] + f""", q AS (SELECT chunk_id AS question, v AS w FROM c WHERE chunk_id % 50 = 0),
s AS (SELECT question, chunk_id, paper_id, round({cos('v', 'w')}, 9) AS score FROM c, q WHERE chunk_id % 9 <> 4 AND slugs <> '|p3|')
SELECT question, chunk_id, paper_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def v09(spark, d):
    """S-12, V-09: chunks stored as an index in two parts, some deleted, asked within a scope. All lists are looked at, since
    the test vectors have no clusters; how few lists do is a matter of the tests."""
    c, at = collection(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    later = F.col("chunk_id") % 7 == 3
    vectorindex.build(c.where(~later), at, "test", 16)
    vectorindex.add(c.where(later), at, "test")
    vectorindex.delete(c.where(F.col("chunk_id") % 9 == 4).select("chunk_id"), at)
    questions = c.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("question"), F.col("v").alias("w"))
    out = vectorindex.nearest(spark, at, questions, 10, 16, F.col("slugs") != "|p3|")
    return out.select("question", "chunk_id", "paper_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("s11_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def s11(spark, d):
    """T-07: the last three turns of each chat."""
    c = table(spark, d, "conversations")
    return c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 3").select("conv_id", "turn", "role")
