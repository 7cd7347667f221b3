"""Free-text labels mapped to topics, and their merge into a profile's topic list."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.vectors import cosine, dot, norm, safe_cosine

#: Similarity of a label's nearest topic, and of its further ones; nearest topics looked at; cosine and
#: word overlap from which two topics count as the same; topics added at once.
NEAREST, FURTHER, LOOKED_AT, SAME_COSINE, SAME_WORDS, ADDITIONS = 0.65, 0.80, 3, 0.75, 0.5, 10
#: Topics in a row of the index, and rows of it that may be broadcast (512 vectors of 1,024 numbers are 4 MB).
BLOCK, BLOCKS = 512, 128


def nearest_topics(rows: DataFrame, index: DataFrame, k: int, floor: float) -> DataFrame:
    """rows (id columns and v) with topic_id, sim and rank of their k nearest of index (topic_id, v), from `floor` on.

    The index is cut into rows of BLOCK topics; each row of vectors meets a block in its own row and keeps the block's
    best k, so that what is ranked in the end is k rows a block. Blocks are broadcast if a count shows at most BLOCKS."""
    ids = [c for c in rows.columns if c != "v"]
    entry = F.struct("topic_id", F.col("v").alias("w"), norm(F.col("v")).alias("n"))
    blocks = index.where("v is not null").withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("topic_id"), F.lit(64))).orderBy("topic_id")) - 1) / BLOCK))
    blocks = blocks.groupBy("_block", F.pmod(F.xxhash64("topic_id"), F.lit(64)).alias("_part")).agg(F.collect_list(entry).alias("_topics")).select("_topics")
    if blocks.limit(BLOCKS + 1).count() <= BLOCKS:
        blocks = F.broadcast(blocks)
    near = rows.withColumn("_n", norm(F.col("v"))).crossJoin(blocks)
    sims = F.transform("_topics", lambda t: F.struct((-F.round(safe_cosine(dot(F.col("v"), t["w"]), F.col("_n") * t["n"]), 9)).alias("s"), t["topic_id"].alias("topic_id")))
    best = F.slice(F.array_sort(F.filter(sims, lambda x: x["s"] <= -floor)), 1, k)
    near = near.select(*ids, F.inline(best)).select(*ids, "topic_id", (-F.col("s")).alias("sim"))
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("sim"), "topic_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def label_topics(labels: DataFrame, index: DataFrame, nearest: float = NEAREST, further: float = FURTHER) -> DataFrame:
    """labels (profile, label_id, v), index (topic_id, v) -> profile, topic_id, label_id, sim: the best label of each topic.

    A label takes its nearest topic from `nearest` on, the second and third from `further` on. Topics without a vector are
    nobody's neighbour."""
    near = nearest_topics(labels.select("profile", "label_id", "v"), index, LOOKED_AT, nearest)
    near = near.where((F.col("rank") == 1) | (F.col("sim") >= further))
    best = F.row_number().over(Window.partitionBy("profile", "topic_id").orderBy(F.desc("sim"), "label_id"))
    return near.withColumn("b", best).where("b = 1").select("profile", "topic_id", "label_id", "sim")


def same_topic(v: Column, w: Column, name: Column, other: Column, cosine_from: float = SAME_COSINE, words_from: float = SAME_WORDS) -> Column:
    """Whether two topics are near duplicates: by their vectors, or by the words of their names where a vector is missing."""
    return F.when(v.isNotNull() & w.isNotNull(), F.round(cosine(v, w), 9) >= cosine_from).otherwise(T.word_overlap(F.lower(name), F.lower(other)) >= words_from)


def with_labels(stored: DataFrame, matches: DataFrame, index: DataFrame, cosine_from: float = SAME_COSINE, additions: int = ADDITIONS) -> DataFrame:
    """stored (profile, topic_id, name, source, is_on) with matches (profile, topic_id, sim): a new list, is_new beside it.

    Topics that an earlier mapping brought and the reader left off go; the others stay. A match that is listed by id, by
    name or as a near duplicate is not added, nor one with the name of a better one; at most `additions` come, nearest
    first. is_new tells topics that were not listed before."""
    stays = stored.where("not (source = 'label' and not is_on)")
    new = matches.join(index.select("topic_id", "name", "v"), "topic_id")
    new = new.join(stays.select("profile", "topic_id"), ["profile", "topic_id"], "left_anti")
    lower = F.lower("name").alias("lower")
    new = new.withColumn("lower", lower).join(stays.select("profile", lower), ["profile", "lower"], "left_anti")
    there = stays.join(index.select("topic_id", F.col("v").alias("w")), "topic_id", "left").select(F.col("profile").alias("of"), F.col("name").alias("other"), "w")
    new = new.join(there, (F.col("profile") == F.col("of")) & same_topic(F.col("v"), F.col("w"), F.col("name"), F.col("other"), cosine_from), "left_anti")
    order = [F.desc("sim"), "topic_id"]
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("profile", "lower").orderBy(*order))).where("n = 1")
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy(*order))).where(F.col("n") <= additions)
    listed = stored.select("profile", "topic_id", F.lit(True).alias("listed")).distinct()
    new = new.join(listed, ["profile", "topic_id"], "left").select("profile", "topic_id", "name", F.lit("label").alias("source"), F.lit(False).alias("is_on"), F.col("listed").isNull().alias("is_new"))
    return stays.select("profile", "topic_id", "name", "source", "is_on", F.lit(False).alias("is_new")).unionByName(new)


def plain_label(c: Column) -> Column:
    """A label for comparison: hyphens as spaces, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("-"), F.lit(" "))), r"\s+", " "))


def wanted_terms(terms: DataFrame, unwanted: DataFrame) -> DataFrame:
    """terms (profile, kind, label) without those that unwanted (profile, label) names, however spelled."""
    out = terms.withColumn("_plain", plain_label(F.col("label")))
    out = out.join(unwanted.select("profile", plain_label(F.col("label")).alias("_plain")), ["profile", "_plain"], "left_anti")
    return out.select("profile", "kind", F.trim(F.replace("label", F.lit("-"), F.lit(" "))).alias("label"))
