"""Queries on sentences and on what texts mention, over `documents`."""

from pyspark.sql import functions as F

from paperloom.operators import sentences
from paperloom.plans.registry import query, table

SENTENCES = r"""WITH p AS (SELECT doc_id AS paper_id, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT paper_id, string_split(regexp_replace(text, '([.!?]+["'')\]]*[ \t\r\n]+|\n[ \t\r\n]*)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM p),
raw AS (SELECT paper_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
ends AS (SELECT paper_id, part, i, sum(length(part)) OVER (PARTITION BY paper_id ORDER BY i) AS stop, ' ' || chr(9) || chr(10) || chr(13) AS blank FROM raw),
s AS (SELECT paper_id, i, (stop - length(ltrim(part, blank)))::INT AS a, (stop - length(part) + length(rtrim(part, blank)))::INT AS b FROM ends WHERE trim(part, blank) <> ''),
sn AS (SELECT paper_id, (row_number() OVER w - 1)::INT AS n, a, b, lead(b) OVER w AS next_b FROM s WINDOW w AS (PARTITION BY paper_id ORDER BY i))
"""

MENTIONS = """, wd AS (SELECT paper_id, regexp_split_to_array(text, '[^a-z]') AS ws FROM p), wx AS (SELECT paper_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM wd),
wy AS (SELECT paper_id, word, (sum(length(word) + 1) OVER (PARTITION BY paper_id ORDER BY i) - length(word) - 1)::INT AS start FROM wx),
m AS (SELECT paper_id, word, start, 500 + (start * 37) % 500 AS conf FROM wy WHERE length(word) >= 9),
mc AS (SELECT * FROM m WHERE conf >= 600),
c AS (SELECT paper_id, word AS concept, max(conf) AS surest, min(start) AS f FROM mc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY surest DESC, f, concept) <= 30)
"""


@query("f38_sentences", SENTENCES + "SELECT paper_id, n, a AS start, b AS stop FROM sn")
def f38_sentences(spark, d):
    """Where each sentence of every whole text starts and stops; the table function in SQL."""
    sentences.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("paperloom_texts")
    return spark.sql("SELECT t.doc_id AS paper_id, s.n, s.start, s.end AS stop FROM paperloom_texts t, LATERAL sentences(t.text) s WHERE t.text IS NOT NULL")


@query("a38_surest_mentions", SENTENCES + MENTIONS + """, j AS (SELECT mc.*, p.text, sn.a, CASE WHEN sn.b - sn.a < 120 AND next_b IS NOT NULL THEN next_b ELSE sn.b END AS b FROM mc JOIN c ON c.paper_id = mc.paper_id AND c.concept = mc.word JOIN p ON p.paper_id = mc.paper_id ASOF JOIN sn ON sn.paper_id = mc.paper_id AND mc.start >= sn.a),
k AS (SELECT *, CASE WHEN b - a <= 1000 THEN substr(text, a + 1, b - a) ELSE substr(text, a + greatest(0, least(start - a + length(word) // 2 - 500, b - a - 1000)) + 1, 1000) END AS sentence FROM j),
u AS (SELECT *, list_filter(regexp_split_to_array(sentence, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM k),
o AS (SELECT paper_id, word, sentence, max(conf) AS conf, arg_min(start, -conf::BIGINT * 100000000 + start) AS start FROM u WHERE len(t) > 0 AND len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z][a-z]{2,}[.,;:)]?$'))) / greatest(len(t), 1)::DOUBLE >= 0.5 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY paper_id, word ORDER BY conf DESC, start) AS place FROM o QUALIFY place <= 3)
SELECT c.paper_id, c.concept, c.surest, b.conf, sha256(b.sentence) AS sentence_sha256, b.place FROM c LEFT JOIN b ON b.paper_id = c.paper_id AND b.word = c.concept""")
def a38_surest(spark, d):
    """Words of nine plain letters or more as mentions, with confidences that follow from their places (thousandths): of the
    thirty surest of a paper up to three sentences each, as digests."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    found = texts.where("text is not null").lateralJoin(sentences.Matches(F.col("text").outer(), F.lit("(?<![a-z])[a-z]{9,}"))).select("paper_id", "start", "word")
    mentions = found.select("paper_id", F.col("word").alias("concept"), (500 + F.col("start").cast("long") * 37 % 500).alias("confidence"), "start", "word", F.lit(False).alias("defined"))
    out = sentences.surest_mentions(texts, mentions, 600)
    return out.select("paper_id", "concept", "surest", F.col("confidence").alias("conf"), F.sha2("sentence", 256).alias("sentence_sha256"), F.col("place").cast("long").alias("place"))
