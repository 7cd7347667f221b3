"""Queries on the second stage: query modes and lexical scores, over `documents` as papers of their sources."""

from pyspark.sql import functions as F

from paperloom.operators import querymodes
from paperloom.plans.library import P, papers
from paperloom.plans.registry import query

S = P + """, r AS (SELECT source AS profile, paper_id, title, substr(text, length(title) + 2) AS abstract FROM p WHERE source IS NOT NULL), sd AS (SELECT profile, paper_id AS pos, title, abstract FROM r WHERE (paper_id * 37) % 101 < 4)
"""
MODES = """, x AS (SELECT profile, pos, array_to_string(list_slice(string_split(title, ' '), 1, 3), ' ') AS name, array_to_string(list_slice(string_split(title, ' '), 2, 3), ' ') AS term FROM sd),
b AS (SELECT profile, pos, name AS q, 'topic' AS source, 1 AS turn FROM x WHERE pos % 2 = 0 AND length(profile) % 2 = 0),
c AS (SELECT profile, pos, term AS q, 'terms' AS source, 0 AS turn FROM x WHERE length(profile) % 3 = 0),
t AS (SELECT profile, pos, title AS q, 'title' AS source, 2 AS turn FROM sd), a AS (SELECT profile, pos, concat_ws(chr(10), nullif(title, ''), nullif(abstract, '')) AS q, 'article' AS source, 0 AS turn FROM sd),
o AS (SELECT 'topic' AS mode, * FROM b UNION ALL SELECT 'topic', * FROM t UNION ALL SELECT 'title', * FROM t UNION ALL SELECT 'article', * FROM a UNION ALL SELECT 'article', * FROM t UNION ALL SELECT 'terms', * FROM c UNION ALL SELECT 'terms', * FROM b UNION ALL SELECT 'terms', * FROM t),
f AS (SELECT * FROM o WHERE trim(q) <> '' QUALIFY turn = min(turn) OVER (PARTITION BY mode, profile)),
n AS (SELECT mode, profile, row_number() OVER (PARTITION BY mode, profile ORDER BY pos, q) - 1 AS query_no, q AS query, source FROM f)
"""
ARTICLES = """, z AS (SELECT profile, query_no, query FROM n WHERE mode = 'title' AND query_no < 30),
ar AS (SELECT paper_id, profile, regexp_extract_all(translate(concat_ws('. ', nullif(title, ''), nullif(abstract, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM r),
kw AS (SELECT paper_id, any_value(len(w)) AS l, word, count(*) AS tf FROM (SELECT paper_id, w, unnest(w) AS word FROM ar) GROUP BY paper_id, word), df AS (SELECT word, count(*) AS df FROM kw GROUP BY word),
qw AS (SELECT DISTINCT profile, query_no, word FROM (SELECT profile, query_no, unnest(regexp_extract_all(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM z)),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM ar),
h AS (SELECT ar.profile, ar.paper_id, qw.query_no, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / st.mean))) AS logit
  FROM ar JOIN kw ON kw.paper_id = ar.paper_id JOIN df ON df.word = kw.word JOIN qw ON qw.word = kw.word AND qw.profile = ar.profile CROSS JOIN st WHERE (ar.paper_id * 37) % 101 >= 4 GROUP BY 1, 2, 3),
nq AS (SELECT profile, count(*) AS queries FROM z GROUP BY profile)
"""


def research(spark, d):
    return papers(spark, d).where("source is not null").select(F.col("source").alias("profile"), "paper_id", "title", F.expr("substring(text, length(title) + 2)").alias("abstract"))


def asked(spark, d, mode):
    """The queries of each source: seeds are its least cited papers; topics and terms are words of their titles, which
    some sources have none of."""
    seeds = research(spark, d).where("paper_id * 37 % 101 < 4").withColumnRenamed("paper_id", "pos")
    part = lambda a, n: F.concat_ws(" ", F.slice(F.split("title", " "), a, n))
    topics = seeds.where(F.length("profile") % 2 == 0).select("profile", "pos", part(1, 3).alias("name"), (F.col("pos") % 2 == 0).alias("is_on"))
    terms = seeds.where(F.length("profile") % 3 == 0).select("profile", "pos", part(2, 2).alias("term"))
    return querymodes.queries_of(mode, topics, terms, seeds)


@query("v05_query_modes", S + MODES + "SELECT mode, profile, query_no, query, source FROM n WHERE query_no < 30")
def v05_modes(spark, d):
    """What each of the four modes asks for every source."""
    out = None
    for m in querymodes.MODES:
        q = asked(spark, d, m).withColumn("mode", F.lit(m))
        out = q if out is None else out.unionByName(q)
    return out


@query("v05_lexical_scores", S + MODES + ARTICLES + """SELECT ar.profile, ar.paper_id, round(coalesce(max(logit), 0), 6) AS logit, round(coalesce(sum(logit), 0) / any_value(queries), 6) AS mean, coalesce(first(query_no ORDER BY round(logit, 9) DESC NULLS LAST, query_no), 0) AS best_query, any_value(queries) AS queries
FROM ar JOIN nq ON nq.profile = ar.profile LEFT JOIN h ON h.profile = ar.profile AND h.paper_id = ar.paper_id WHERE (ar.paper_id * 37) % 101 >= 4 GROUP BY 1, 2""")
def v05_scores(spark, d):
    """Every paper against the titles of its source's seeds: BM25 over all papers in place of a model."""
    r = research(spark, d)
    articles = r.select("paper_id", querymodes.article_text(F.col("title"), F.col("abstract"), "title").alias("text"))
    out = querymodes.lexical_scores(asked(spark, d, "title"), articles, r.where("paper_id * 37 % 101 >= 4").select("profile", "paper_id"))
    return out.select("profile", "paper_id", F.round("logit", 6).alias("logit"), F.round("mean", 6).alias("mean"), "best_query", "queries")
