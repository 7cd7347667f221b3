"""Topic hierarchies, gathering by topic, and topic lists."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hierarchy_counts(mentions: DataFrame, top: int = 8) -> DataFrame:
    """mentions (paper_id, pos, level, id, name): how often and in how many papers each node occurs, `top` of a level.

    Names are those of the first mention; equal counts keep the order of first mention."""
    by = mentions.groupBy("level", "id").agg(F.count("*").alias("count"), F.countDistinct("paper_id").alias("papers"), F.min(F.struct("paper_id", "pos", "name")).alias("f"))
    k = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("count"), "f.paper_id", "f.pos"))
    return by.withColumn("rank", k).where(F.col("rank") <= top).select("level", "id", F.col("f.name").alias("name"), "count", "papers", "rank")


def tiers(rows: DataFrame, least: int) -> DataFrame:
    """rows (tier, paper_id): earliest tier of each paper, tiers added until `least` papers are there."""
    first = rows.groupBy("paper_id").agg(F.min("tier").alias("tier"))
    n = first.groupBy("tier").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a tier
    return first.join(F.broadcast(n.withColumn("before", before).where(F.col("before") < least).select("tier")), "tier")


def most_cited(rows: DataFrame, group: str, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("cited"), "paper_id"))
    return rows.withColumn("rank", r).where(F.col("rank") <= k)


def dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Round-robin over topics (rows: topic, topic_pos, rank, paper_id), each paper once, up to `limit`.

    With topics that share papers the set form gives a paper to its first (rank, topic_pos); the one-by-one rule, in which
    a topic whose turn meets a paper already dealt takes its next, is round_robin()."""
    first = rows.withColumn("f", F.row_number().over(Window.partitionBy("paper_id").orderBy("rank", "topic_pos"))).where("f = 1").drop("f")
    return first.orderBy("rank", "topic_pos").limit(limit)


def round_robin(rows: DataFrame, limit: int) -> DataFrame:
    """The one-by-one rule for each profile (rows: profile, topic_pos, rank, paper_id, title_key), at most `limit` each.

    Order-dependent, hence one bounded group a profile: at most 40 papers for each enabled topic."""
    import pandas as pd

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["topic_pos", "rank"])
        queues = [list(g.itertuples(index=False)) for _, g in pdf.groupby("topic_pos")]
        seen, out = set(), []
        while len(out) < limit and any(queues):
            for q in queues:
                while q:
                    row = q.pop(0)
                    keys = {("id", row.paper_id)} | ({("title", row.title_key)} if row.title_key else set())
                    if not keys & seen:
                        seen |= keys
                        out.append(row)
                        break
        got = pd.DataFrame(out[:limit], columns=pdf.columns)
        return got.assign(position=range(1, len(got) + 1))

    return rows.groupBy("profile").applyInPandas(deal, rows.schema.simpleString()[7:-1].replace(":", " ") + ", position long")


#: Levels of a topic: the topic itself and the fields of its struct.
LEVELS = ("topic", "subfield", "field", "domain")


def level_mentions(works: DataFrame) -> DataFrame:
    """works (paper_id, primary_topic, topics; a topic: id, display_name and subfield, field, domain of id and display_name)
    -> a row (paper_id, pos, level, id, name) for each level of the primary topic and of each topic listed, in that order.

    A primary topic that is listed too is mentioned twice; what has no id is not mentioned."""
    every = F.concat(F.array("primary_topic"), F.coalesce("topics", F.array().cast(works.schema["topics"].dataType)))
    one = works.select("paper_id", F.posexplode(every).alias("pos", "t")).where("t is not null")
    node = lambda level: F.struct(F.lit(level).alias("level"), F.col("t.id" if level == "topic" else f"t.{level}.id").alias("id"), F.col("t.display_name" if level == "topic" else f"t.{level}.display_name").alias("name"))
    return one.select("paper_id", "pos", F.inline(F.array(*map(node, LEVELS)))).where(F.coalesce("id", F.lit("")) != "")
