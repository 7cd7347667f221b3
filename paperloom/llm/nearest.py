"""Approximate nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Inner product becomes distance: vectors are scaled by the largest norm M and given one more dimension that brings all to
length 1, queries are scaled to length 1 with 0 there. All are turned by one random rotation, so that the first columns
of a difference estimate its whole length. Vectors lie in lists around k-means centres. Within a probed list, columns are
read in blocks; after d of D columns a candidate whose partial distance, times D / d, exceeds the query's current 20th
distance times (1 + EPSILON / sqrt(d)) squared is given up (the test of the hypothesis that it is nearer). Those that
last are scored exactly, on the original vectors, in double precision.

The index is fitted on at most SAMPLE vectors (those of least hash): centres, and how many lists to probe, the fewest
that cover COVER of the sample's own nearest neighbours. Every vector is in the index. Lists are cut into chunks of about
CHUNK vectors, and the queries of a list into blocks of about QUERIES, so that no list, however common its vector, is one
task's. Partial distances are matrix products for as long as more than SPARSE of a block's candidates are alive, and
single differences from then on.

A query whose products with the largest vector leave the range of doubles (beyond 1e300, or all under 1e-280) ranks by
rounded values that say nothing of angles; it probes every list and gives up no candidate, so that its answer is exact.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null vec_id; a vector shorter than the longest counts as followed by zeros; every row is a candidate of its own, also
where a vec_id repeats, and a query leaves out only its own row; ties go to the smaller vec_id; a sum that overflows to no
number ranks last; fewer candidates than asked give them all; an empty table gives an empty table; other columns are not
read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.store import saved

SAMPLE, COVER, EPSILON, BLOCK = 20_000, 0.97, 2.1, 16
CHUNK, QUERIES, AT_ONCE, SLACK, SPARSE = 2048, 1024, 512, 1e-9, 0.05
HUGE, TINY = 1e300, 1e-280


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles): the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, by way of their largest component, as squares of others may leave the range of doubles."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Index:
    def __init__(self, sample: np.ndarray, peak: float, largest: float, lists: int, k: int, seed: int = 7):
        """peak: the largest component of any vector; largest: the largest norm, in units of peak."""
        r = np.random.default_rng(seed)
        self.peak, self.largest, self.dims = peak, largest, sample.shape[1] + 1
        self.turn = np.linalg.qr(r.normal(size=(self.dims, self.dims)))[0]
        x = self.stored(sample)
        lists = min(lists, len(x))
        c = x[r.choice(len(x), lists, replace=False)]
        for _ in range(8):
            of = self.near(x, c, 1)[:, 0]
            sums = np.zeros_like(c)
            np.add.at(sums, of, x)
            n = np.bincount(of, minlength=lists)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        self.centres = c
        # lists to probe: the rank of the list of each of the sample's own nearest neighbours
        some = r.choice(len(x), min(256, len(x)), replace=False)
        of, q = self.near(x, c, 1)[:, 0], self.asked(sample[some])
        score = unit(sample[some]) @ (sample / peak).T
        score[np.arange(len(some)), some] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((len(some), 0), int)
        rank = np.argsort(self.near(q, c, lists), axis=1)
        ranks = np.sort(np.take_along_axis(rank, of[best], 1).ravel())
        self.probes = int(ranks[int(np.ceil(COVER * len(ranks))) - 1]) + 1 if len(ranks) else lists

    def stored(self, v: np.ndarray) -> np.ndarray:
        v = v / self.peak / self.largest
        return np.column_stack((v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1))))) @ self.turn

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((unit(q), np.zeros(len(q)))) @ self.turn

    def rounded(self, q: np.ndarray) -> np.ndarray:
        """Queries whose products in double precision may overflow, or vanish."""
        with np.errstate(over="ignore", under="ignore"):
            most = np.abs(q).max(axis=1) * self.peak * self.dims
        return (most > HUGE) | (most < TINY)

    @staticmethod
    def near(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
        """For each row of x the k nearest centres, nearest first."""
        d = (c * c).sum(axis=1) - 2 * x @ c.T
        return d.argmin(axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]


def _array(batch, name: str, width: int) -> np.ndarray:
    """A column of arrays as a matrix, shorter ones followed by zeros."""
    column = batch.column(name)
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < n[:, None]] = np.asarray(column.flatten(), np.float64)
    return out


PLACED = "list int, row long, id long, vec binary"


def _placed(index: Index, probing: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _array(batch, "v", index.dims - 1)
            if probing:
                to = index.near(index.asked(v), index.centres, len(index.centres))
                n = np.where(index.rounded(v), len(index.centres), index.probes)
                to, each = to[np.arange(to.shape[1])[None, :] < n[:, None]], np.repeat(np.arange(len(v)), n)
            else:
                to, each = index.near(index.stored(v), index.centres, 1)[:, 0], np.arange(len(v))
            vec, at = [x.tobytes() for x in v], pa.array(each)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column("row").take(at), batch.column("vec_id").take(at), pa.array([vec[i] for i in each], pa.binary())], ["list", "row", "id", "vec"])

    return run


def scan(index: Index, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, x: np.ndarray, qrow: np.ndarray, q: np.ndarray, k: int):
    """(place of the query, place of the vector, score) of the k best of one chunk for each query.

    rows, ids, v, x: row numbers, vec_ids, original and stored vectors; qrow, q: the queries' row numbers and vectors."""
    t, dims, n = index.asked(q), index.dims, len(q)
    top = np.abs(q).max(axis=1)
    norm = np.sqrt(((q / top[:, None]) ** 2).sum(axis=1)) * index.largest  # of query and largest vector, in units of top * peak
    exact = index.rounded(q)
    best_s, best_i, filled = np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros((n, 0), bool)
    reach = np.full(n, np.inf)  # squared distance of the k-th best so far
    # few vectors first, as nothing can be given up before k are known
    sizes = [64 << i for i in range(64) if 64 << i < AT_ONCE]
    cuts = np.unique(np.minimum(np.concatenate(([0], np.cumsum(sizes), np.arange(sum(sizes), len(x) + AT_ONCE, AT_ONCE))), len(x)))
    for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = slice(at, end)
        alive, seen = qrow[:, None] != rows[None, part], 0
        far = np.zeros(alive.shape)
        bar = lambda seen: (reach if seen >= dims else reach * seen / dims * (1 + EPSILON / np.sqrt(seen)) ** 2) + SLACK
        while seen < dims and alive.mean() > SPARSE:  # many candidates: whole blocks of the matrix of distances
            more = slice(seen, seen + BLOCK)
            a, b = t[:, more], x[part, more]
            far += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
            seen += BLOCK
            alive &= far <= bar(seen)[:, None]
        qi, ci = np.nonzero(alive)
        d, ci = far[qi, ci], ci + at
        while seen < dims and len(qi):
            more = slice(seen, seen + BLOCK)
            step = t[qi, more] - x[ci, more]
            d, seen = d + (step * step).sum(axis=1), seen + BLOCK
            go = d <= bar(seen)[qi]
            qi, ci, d = qi[go], ci[go], d[go]
        if not len(qi):
            continue
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            s = (q[qi] * v[ci]).sum(axis=1)
        old = np.nonzero(filled)
        qs, ss, ii = np.concatenate((old[0], qi)), np.concatenate((best_s[filled], s)), np.concatenate((best_i[filled], ci))
        order = np.lexsort((rows[ii], ids[ii], -np.where(np.isnan(ss), -np.inf, ss), qs))
        qs, ss, ii = qs[order], ss[order], ii[order]
        nth = np.arange(len(qs)) - np.searchsorted(qs, qs)
        keep = nth < k
        best_s, best_i, filled = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        best_s[qs[keep], nth[keep]], best_i[qs[keep], nth[keep]], filled[qs[keep], nth[keep]] = ss[keep], ii[keep], True
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            reach = np.where(filled[:, k - 1] & ~exact, np.maximum(0, 2 - 2 * (best_s[:, k - 1] / top / index.peak) / norm), np.inf)
    r, c = np.nonzero(filled)
    return r, best_i[r, c], best_s[r, c]


FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _search(index: Index, k: int):
    def answer(held, qrow, qid, q):
        rows, ids, v, x = held
        for at in range(0, len(qid), 256):
            to = slice(at, at + 256)
            a, b, s = scan(index, rows, ids, v, x, qrow[to], q[to], k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (qrow[to][a], qid[to][a], rows[b], ids[b], s)], ["query_row", "query_id", "row", "vec_id", "score"])

    def run(batches):
        group, own, ids, vecs, held = None, [], [], [], None
        for batch in batches:
            grp, kind, row, of = (batch.column(c).to_numpy() for c in ("grp", "kind", "row", "id"))
            vec = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1]), [True]))) if len(grp) else []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if grp[s] != group:
                    group, own, ids, vecs, held = grp[s], [], [], [], None
                if kind[s] == 0:  # the chunk's vectors come before the queries that probe it
                    own.append(row[s:e])
                    ids.append(of[s:e])
                    vecs.append(vec[s:e])
                elif ids:
                    if held is None:
                        v = np.concatenate(vecs)
                        held = (np.concatenate(own), np.concatenate(ids), v, index.stored(v))
                    yield from answer(held, row[s:e], of[s:e], vec[s:e])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """For rows (row, vec_id, v) of queries the k nearest of vectors, but for the same row: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    n, peak, width = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / peak) * (x / peak))))).first()[0]
    sample = np.zeros((min(n, SAMPLE), width))
    for to, r in zip(sample, vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("v").collect(), strict=True):
        to[: len(r[0])] = r[0]
    index = Index(sample, peak, largest, max(4, min(4096, int(n**0.5 / 4))), k)
    placed = saved(vectors.mapInArrow(_placed(index, False), PLACED), "placed")
    probes = saved(queries.mapInArrow(_placed(index, True), PLACED), "probes")
    # at most 4096 lists
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    table = F.broadcast(saved(sizes.join(asked, "list"), "lists"))
    cell = lambda of: F.pmod(F.xxhash64("row", F.lit(of)), F.col(of)).cast("int")
    own = placed.join(table, "list").withColumn("chunk", cell("chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ask = probes.join(table, "list").withColumn("block", cell("blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    grp = F.xxhash64("list", "chunk", "block").alias("grp")
    rows = own.select(grp, F.lit(0).alias("kind"), "row", "id", "vec").unionByName(ask.select(grp, F.lit(1).alias("kind"), "row", "id", "vec"))
    found = rows.repartition("grp").sortWithinPartitions("grp", "kind", "id", "row").mapInArrow(_search(index, k), FOUND)
    score = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(score.desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest vectors of each vector whose vec_id is divisible by `every`."""
    # numbers given once, then written with their rows
    good = saved(valid_vectors(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    return nearest(good.where(F.col("vec_id") % every == 0), good, k)
