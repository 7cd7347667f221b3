"""A stored vector index: vectors by list, lists by nearest centre, a meta row that names the version in force.

Readers open the version that the meta row names; a new one counts only once it is written whole. Rows lie in a folder for
each list, so that a question reads the folders of its nearest lists alone, and of those only the columns and row groups
that its scope lets through. Added rows go to their lists' folders; deleted ids to a list of tombstones with the time of
their deletion, so that an id can be added again later. Centres come from a bounded sample, every vector is indexed."""

import json
import time
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, IntegerType

from paperloom.functions.vectors import norm
from paperloom.operators.resolve import cut

#: Vectors that centres are fitted on, rounds of fitting; rows and questions of a block; questions scored at once; scores
#: that sums in another order, or rounding to nine places, may tell apart.
SAMPLE, ROUNDS, ROWS, QUESTIONS, ASKED, NEAR = 20_000, 8, 4_096, 4_096, 256, 1e-8
META = "version string, model string, size int, made double, centres array<array<double>>"


def fitted(vectors: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by spherical k-means; a list that runs empty keeps its centre."""
    r = np.random.default_rng(seed)
    centres = vectors[r.permutation(len(vectors))[:lists]]
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                mean = vectors[own == i].mean(axis=0)
                centres[i] = mean / (np.linalg.norm(mean) + 1e-12)
    return centres


def _list_of(centres: np.ndarray):
    @F.pandas_udf(IntegerType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_numpy()) @ centres.T).argmax(axis=1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a length; the others cannot be near anything."""
    return vectors.where(F.col("v").isNotNull() & (norm(F.col("v")) > 0))


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / norm(v))


def meta(spark: SparkSession, path: str) -> dict:
    rows = spark.read.schema(META).json(f"{path}/meta").collect()  # one row
    if not rows:
        raise ValueError(f"no index at {path}")
    return rows[0].asDict()


def build(vectors: DataFrame, path: str, model: str, lists: int) -> None:
    """vectors (chunk_id, v, ...) as a new version of the index at path."""
    spark, some = vectors.sparkSession, _usable(vectors)
    sample = some.select("chunk_id", _unit(F.col("v")).alias("v")).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(sample):
        raise ValueError("no vector to index")
    centres, version = fitted(np.stack(sample.to_numpy()), lists), uuid.uuid4().hex
    _write(some, f"{path}/{version}", centres)
    row = json.dumps({"version": version, "model": model, "size": centres.shape[1], "made": time.time(), "centres": centres.tolist()})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _write(vectors: DataFrame, at: str, centres: np.ndarray) -> None:
    out = vectors.withColumn("list", _list_of(centres)(_unit(F.col("v")))).withColumn("added", F.lit(time.time()))
    # a list of many rows is written by many tasks
    out.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("append").partitionBy("list").parquet(at)


def add(vectors: DataFrame, path: str, model: str) -> None:
    """More rows of the same model; an id that is there already has its new row in force."""
    now = meta(vectors.sparkSession, path)
    size = vectors.select(F.max(F.size("v"))).first()[0]
    if now["model"] != model or size not in (None, now["size"]):
        raise ValueError(f"the index holds {now['size']} numbers of {now['model']}, not {size} of {model}")
    delete(vectors.select("chunk_id"), path)
    _write(_usable(vectors), f"{path}/{now['version']}", np.array(now["centres"]))


def delete(ids: DataFrame, path: str) -> None:
    """Ids (chunk_id) whose rows so far no longer count."""
    version = meta(ids.sparkSession, path)["version"]
    ids.select("chunk_id").distinct().withColumn("gone", F.lit(time.time())).write.mode("append").parquet(f"{path}/gone/{version}")


def opened(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """The rows in force, of the given lists."""
    version = meta(spark, path)["version"]
    rows = spark.read.parquet(f"{path}/{version}")
    rows = rows if lists is None else rows.where(F.col("list").isin(lists))
    try:
        gone = spark.read.parquet(f"{path}/gone/{version}").groupBy("chunk_id").agg(F.max("gone").alias("gone"))
    except Exception as e:  # noqa: BLE001 - Spark says a missing path by a general error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows.drop("added")
    # few rows are gone between two builds; Spark takes their size into account
    return rows.join(gone, "chunk_id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("added"))).drop("gone", "added")


def _listed(centres: np.ndarray, probes: int):
    """The nearest lists of each vector."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(w: pd.Series) -> pd.Series:
        return pd.Series([np.argsort(-(centres @ v), kind="stable")[:probes].tolist() for v in w])

    return run


def _best(k: int, columns: list[str]):
    """Of the rows and the questions of one group the rows that may be among a question's k nearest of all, scored in the
    order of sums that Spark has; of rows with one score, k at most, the least chunk_id first."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        of, at, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(asked):
            v, w = (np.stack(t.column(c).to_numpy()) for t, c in ((rows, "v"), (asked, "w")))
            ids = rows.column("chunk_id").combine_chunks()
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            long, wide = (np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1]) for x in (v, w))
            for first in range(0, len(w), ASKED):
                rough = w[first : first + ASKED] @ v.T / (np.outer(wide[first : first + ASKED], long) + 1e-12)
                least = np.partition(rough, -k, axis=1)[:, -k] - NEAR if len(v) > k else np.full(len(rough), -np.inf)
                for q, (line, low) in enumerate(zip(rough, least, strict=True), first):
                    some = np.flatnonzero(~(line < low))
                    exact = np.add.accumulate(v[some] * w[q], axis=1)[:, -1] / (long[some] * wide[q] + 1e-12)
                    exact[np.isnan(exact)] = 0.0
                    order = np.lexsort((place[some], -exact))
                    some, exact = some[order], exact[order]
                    run_of = np.flatnonzero(np.concatenate(([True], exact[1:] != exact[:-1])))
                    turn = np.arange(len(some)) - np.repeat(run_of, np.diff(np.append(run_of, len(some))))
                    some, exact = some[turn < k], exact[turn < k]
                    of.append(np.full(len(some), q))
                    at.append(some)
                    score.append(exact)
        found = rows.take(pa.array(np.concatenate(at))).select(columns)
        question = asked.column("question").take(pa.array(np.concatenate(of)))
        return pa.Table.from_arrays([question, pa.array(np.concatenate(score)), *found.columns], names=["question", "score", *columns])

    return run


def nearest(spark: SparkSession, path: str, questions: DataFrame, k: int, probes: int, scope: Column | None = None) -> DataFrame:
    """questions (question, w) -> question, score, rank and the columns of its k nearest rows within the scope, a condition
    on the index's columns, out of its `probes` nearest lists.

    The rows of a list are dealt into blocks of some ROWS, its questions into blocks of some QUESTIONS; each block of rows
    meets each block of questions in a group, which yields k rows a question, but for rows within NEAR of the last."""
    told = cut(questions.select("question", "w", F.explode(_listed(np.array(meta(spark, path)["centres"]), probes)("w")).alias("list")))
    asked = told.groupBy("list").count().collect()  # a row a list at most
    rows = opened(spark, path, sorted(r["list"] for r in asked))
    rows = rows if scope is None else rows.where(scope)
    held = rows.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    parts, turns = max(1, -(-held // ROWS)), max([1, *(-(-r["count"] // QUESTIONS) for r in asked)])
    columns = [c for c in rows.columns if c not in ("v", "list")]
    block = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", block("chunk_id", parts)).withColumn("turn", every(turns)).groupBy("list", "part", "turn")
    right = told.withColumn("turn", block("question", turns)).withColumn("part", every(parts)).groupBy("list", "part", "turn")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"question {dict(questions.dtypes)['question']}, score double, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    met = left.cogroup(right).applyInArrow(_best(k, columns), schema).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "chunk_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)
