"""Passages for a question: nearest chunks within a scope, a few of each paper."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import cosine

#: How many times k are looked at first, and chunks of one paper among the answers.
WIDER, OF_A_PAPER = 4, 4


def scope(slugs: F.col, wanted: list[str]) -> F.col:
    """Whether a chunk's slug list is one of the wanted slugs alone; without wanted slugs every chunk is in scope."""
    return slugs.isin(*[f"|{s}|" for s in wanted]) if wanted else F.lit(True)


def similarity(distance: F.col) -> F.col:
    """1 - distance within [0, 1]; an unknown distance is 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)), F.lit(0.0))


def retrieved(chunks: DataFrame, questions: DataFrame, wanted: list[str], k: int) -> DataFrame:
    """chunks (chunk_id, paper_id, slugs, v), questions (question, w: a few rows, asked by people) -> question, chunk_id,
    paper_id, score, rank: of the nearest 4 * k chunks at most four of a paper, and of these the nearest k."""
    far = F.round(1 - cosine(F.col("v"), F.col("w")), 9)
    near = chunks.where(scope(F.col("slugs"), [s for s in wanted if s])).crossJoin(questions).select("question", "chunk_id", "paper_id", far.alias("far"))
    top = lambda of, n: F.row_number().over(Window.partitionBy(*of).orderBy("far", "chunk_id")) <= n
    near = near.withColumn("t", top(["question"], WIDER * k)).where("t")
    near = near.withColumn("t", top(["question", "paper_id"], OF_A_PAPER)).where("t")
    rank = F.row_number().over(Window.partitionBy("question").orderBy("far", "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("question", "chunk_id", "paper_id", similarity(F.col("far")).alias("score"), "rank")
