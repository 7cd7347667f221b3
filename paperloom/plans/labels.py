"""Queries on topic lists: labels mapped to topics, near duplicates, merges."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.vectors import doubles, mean_vector
from paperloom.operators import groups, labels
from paperloom.plans.interest import cos
from paperloom.plans.registry import query, table

#: The test vectors are random, so that their cosines stay small; thresholds for them.
NEAREST, FURTHER, SAME = 0.1, 0.2, 0.15

L = f"""WITH tg AS (SELECT label, t.i AS i, avg(CAST(embedding[t.i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
t AS (SELECT label AS topic_id, 'Area ' || label % 4 || ' field ' || label % 6 AS name, CASE WHEN label % 5 <> 4 THEN list(x ORDER BY i) END AS v FROM tg GROUP BY label),
l AS (SELECT (vec_id * 7 + 3) % 10 AS profile, vec_id AS label_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n0 AS (SELECT profile, label_id, topic_id, round({cos('l.v', 't.v')}, 9) AS sim FROM l, t WHERE t.v IS NOT NULL),
n1 AS (SELECT *, row_number() OVER (PARTITION BY profile, label_id ORDER BY sim DESC, topic_id) AS k FROM n0 WHERE sim >= {NEAREST}),
m AS (SELECT profile, topic_id, label_id, sim FROM n1 WHERE k = 1 OR (k <= 3 AND sim >= {FURTHER}) QUALIFY row_number() OVER (PARTITION BY profile, topic_id ORDER BY sim DESC, label_id) = 1),
ws AS (SELECT topic_id, list_distinct(string_split(lower(name), ' ')) AS a FROM t),
same AS (SELECT x.topic_id AS a, y.topic_id AS b FROM t x JOIN t y ON x.topic_id <> y.topic_id JOIN ws p ON p.topic_id = x.topic_id JOIN ws q ON q.topic_id = y.topic_id
  WHERE CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN round({cos('x.v', 'y.v')}, 9) >= {SAME} ELSE len(list_intersect(p.a, q.a))::DOUBLE / greatest(len(list_distinct(list_concat(p.a, q.a))), 1) >= 0.5 END),
s AS (SELECT profile, topic_id, name, CASE WHEN topic_id % 2 = 0 THEN 'label' ELSE 'seed' END AS source, topic_id % 3 <> 0 AS is_on FROM (SELECT DISTINCT label AS profile FROM embeddings), t WHERE (topic_id + profile) % 4 = 0),
kept AS (SELECT * FROM s WHERE NOT (source = 'label' AND NOT is_on))
"""


def topic_index(spark: SparkSession, d: str) -> DataFrame:
    """A topic for each label of the vectors: their mean, but none for every fifth."""
    t = F.col("topic_id")
    mean = mean_vector(table(spark, d, "embeddings").select(F.col("label").alias("topic_id"), doubles(F.col("embedding")).alias("v")), "topic_id", "v", "v")
    return mean.select("topic_id", F.concat(F.lit("Area "), t % 4, F.lit(" field "), t % 6).alias("name"), F.when(t % 5 != 4, F.col("v")).alias("v"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Every vector is a label of some profile."""
    i = F.col("vec_id")
    asked = table(spark, d, "embeddings").select(((i * 7 + 3) % 10).alias("profile"), i.alias("label_id"), doubles(F.col("embedding")).alias("v"))
    return labels.label_topics(asked, topic_index(spark, d), NEAREST, FURTHER)


@query("v15_label_topics", L + "SELECT profile, topic_id, label_id, round(sim, 6) AS sim FROM m")
def v15(spark, d):
    return matches(spark, d).withColumn("sim", F.round("sim", 6))


@query("v17_near_duplicate_topics", L + "SELECT a, b FROM same WHERE a < b")
def v17(spark, d):
    """A row for each topic of the vocabulary meets the others."""
    t = topic_index(spark, d)
    x, y = t.toDF("a", "name", "v"), t.toDF("b", "other", "w")
    return x.join(y, (F.col("a") < F.col("b")) & labels.same_topic(F.col("v"), F.col("w"), F.col("name"), F.col("other"), SAME)).select("a", "b")


@query("m02_label_merge", L + """, fresh AS (SELECT m.profile, m.topic_id, t.name, m.sim FROM m JOIN t ON t.topic_id = m.topic_id
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.profile = m.profile AND (k.topic_id = m.topic_id OR lower(k.name) = lower(t.name)))
  AND NOT EXISTS (SELECT 1 FROM kept k JOIN same ON same.b = k.topic_id WHERE k.profile = m.profile AND same.a = m.topic_id)),
one AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY profile, lower(name) ORDER BY sim DESC, topic_id) = 1),
ten AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY profile ORDER BY sim DESC, topic_id) <= 10)
SELECT profile, topic_id, name, source, is_on, false AS is_new FROM kept
UNION ALL SELECT profile, topic_id, name, 'label', false, NOT EXISTS (SELECT 1 FROM s WHERE s.profile = ten.profile AND s.topic_id = ten.topic_id) FROM ten""")
def m02(spark, d):
    t, nth = topic_index(spark, d), F.col("topic_id")
    # a row for each profile and topic of the fixed vocabulary
    profiles = table(spark, d, "embeddings").select(F.col("label").alias("profile")).distinct()
    stored = profiles.join(t.drop("v"), (nth + F.col("profile")) % 4 == 0)
    stored = stored.withColumn("source", F.when(nth % 2 == 0, "label").otherwise("seed")).withColumn("is_on", nth % 3 != 0)
    return labels.with_labels(stored, matches(spark, d), t, SAME)


@query("m08_wanted_terms", """WITH t AS (SELECT p_partkey % 10 AS profile, CASE p_partkey % 3 WHEN 0 THEN 'research_interest' WHEN 1 THEN 'expertise' ELSE 'subfield' END AS kind, 'wet-lab ' || p_partkey % 60 AS label FROM part),
u AS (SELECT s_suppkey % 10 AS profile, 'Wet  lab-' || s_suppkey % 30 AS label FROM supplier)
SELECT profile, kind, trim(replace(label, '-', ' ')) AS label FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.profile = t.profile
  AND regexp_replace(lower(replace(u.label, '-', ' ')), '\\s+', ' ', 'g') = regexp_replace(lower(replace(t.label, '-', ' ')), '\\s+', ' ', 'g'))""")
def m08(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "research_interest").when(k % 3 == 1, "expertise").otherwise("subfield")
    terms = table(spark, d, "part").select((k % 10).alias("profile"), kind.alias("kind"), F.concat(F.lit("wet-lab "), k % 60).alias("label"))
    s = F.col("s_suppkey")
    unwanted = table(spark, d, "supplier").select((s % 10).alias("profile"), F.concat(F.lit("Wet  lab-"), s % 30).alias("label"))
    return labels.wanted_terms(terms, unwanted)


@query("v12_suggested_groups")
def v12(spark, d):
    """No SQL: clustering is iterative. The bars are for the random test vectors."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("researcher"), F.col("vec_id").alias("paper_id"), (F.col("vec_id") % 25).alias("year"), doubles(F.col("embedding")).alias("v"))
    return groups.suggestions(v, 0.3, 0.15)
