"""Ranked lexical search: range-maximum tables per posting list, intervals of documents best first.

A block holds some BLOCK documents in order of doc_id, and for each query term its posting list with the impact of every
posting. A sparse table over a list answers which document of an interval has its largest impact; the sum of a query's
answers bounds every document of the interval. Intervals wait in a heap by that bound. One taken out is split at the
document of its largest single impact, which gets its full score, and the halves before and behind it go back with bounds
of their own. A block is done when no bound can enter the best found so far, which a task carries from block to block.

The corpus is read once: each task keeps postings of the query terms alone (equal by 64-bit hash, then byte by byte) and
sums what the weights need. Queries are handled PARTS at a time, so that a task's terms are bounded, each such part with
the whole corpus in blocks. Best ones of each task are ranked by item at the end, of which Spark keeps k a task first.

Defined cases: null or empty text has no term and counts neither in N nor in L; an item without terms, or whose terms no
document holds, has no rows; repeated documents are ranked each, repeated items too (as items of their own); a null
doc_id comes before others; empty tables give an empty table; other columns are not read.
"""

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import textbytes as tb
from paperloom.llm.store import saved

BLOCK, POSTINGS, SLICE, SLICE_BYTES, PARTS, AT_ONCE, PLACE = 8192, 1_000_000, 2048, 4 << 20, 5_000, 32, 20
TERM_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERM = np.ones(256, bool)
TERM[:128] = False
TERM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
UPPER = {c: c + 32 for c in range(65, 91)}
NONE = np.iinfo(np.int64).min
FOUND = "ids array<long>, sizes array<long>, term array<int>, doc array<int>, tf array<int>, seen array<int>, df array<long>, n long, total long"


def terms_of(text: str | None) -> list[str]:
    return TERM_TEXT.findall((text or "").translate(UPPER))


def _slices(batch: pa.RecordBatch):
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = min(at + SLICE, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES))), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _read(terms: list[str]):
    """Texts -> for each slice its documents, their sizes, and the postings of terms."""
    data = [t.encode() for t in terms]
    flat = np.frombuffer(b"".join(data), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)

    def run(batches):
        keys = tb.Hasher(flat)(first[:-1], first[1:])
        order = np.argsort(keys)
        keys = keys[order]
        for batch in batches:
            for part in _slices(batch):
                sizes, codes = np.zeros(part.num_rows, np.int64), []
                for owner, buf, offs in tb.parts(part.column("text"), TERM):
                    low = tb.LOWER[buf]
                    start, end = tb.runs(TERM[low], offs)
                    doc = owner[np.searchsorted(offs, start, "right") - 1]
                    sizes += np.bincount(doc, minlength=part.num_rows)
                    h = tb.Hasher(low)(start, end)
                    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = np.flatnonzero(keys[k] == h)
                    term, start, n = order[k[hit]], start[hit], (end - start)[hit]
                    same = n == first[term + 1] - first[term]
                    hit, term, start, n = hit[same], term[same], start[same], n[same]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    unlike = low[np.repeat(start, n) + inner] != flat[np.repeat(first[term], n) + inner]
                    same = np.ones(len(n), bool)
                    same[np.repeat(np.arange(len(n)), n)[unlike]] = False
                    codes.append(doc[hit[same]] * len(terms) + term[same])
                code, tf = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True)
                term, doc = code % len(terms), code // len(terms)
                seen, df = np.unique(term, return_counts=True)
                lists = [(part.column("doc_id"), pa.int64()), (sizes, pa.int64()), (term, pa.int32()), (doc, pa.int32()), (tf, pa.int32()), (seen, pa.int32()), (df, pa.int64())]
                columns = [pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], pa.list_(k)) for x, k in lists] + [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "term", "doc", "tf", "seen", "df", "n", "total"])

    return run


class Index:
    """A block's posting lists, one after the other, and the sparse tables over them."""

    def __init__(self, ids, sizes, term, doc, tf, weight, n_docs: int, n_terms: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, doc = ids[order], place[doc]
        m = 75 + (25 * sizes[order] * n_docs) // n_terms
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        keep = impact > 0
        key, impact = ((term << 32) | doc)[keep], impact[keep]
        by = np.argsort(key)
        self.key = key[by]
        # of equal impacts the first document is the largest
        self.table = [(impact[by] << PLACE) | ((1 << PLACE) - 1 - (self.key & 0xFFFFFFFF))]
        longest = int(np.unique(self.key >> 32, return_counts=True)[1].max(initial=0))
        width = 1
        while 2 * width <= longest:
            low = self.table[-1]
            level = low.copy()
            np.maximum(low[:-width], low[width:], out=level[:-width])
            self.table.append(level)
            width *= 2
        self.table = np.stack(self.table)

    def largest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The largest entry, impact and place, of each stretch of postings, 0 if it is empty."""
        n = end - start
        some = n > 0
        level = np.frexp(np.where(some, n, 1).astype(np.float64))[1] - 1
        first, last = np.where(some, start, 0), np.where(some, end - (1 << level), 0)
        return np.where(some, np.maximum(self.table[level, first], self.table[level, last]), 0)

    def search(self, terms: np.ndarray, times: np.ndarray, best: list, k: int):
        """best: a heap of (score, -doc_id) of at most k, which takes what this block has better."""
        times, border = times[:, None], terms << 32
        heap: list = []

        def wait(start, end, lo):
            top = self.largest(start, end)
            impact = (top >> PLACE) * times
            bound = impact.sum(axis=0)
            at = (1 << PLACE) - 1 - (top[impact.argmax(axis=0), np.arange(top.shape[1])] & ((1 << PLACE) - 1))
            for i in np.flatnonzero(bound):
                first = int(self.ids[lo[i]])
                if len(best) < k or (int(bound[i]), -first) > best[0]:
                    heapq.heappush(heap, (-int(bound[i]), first, int(lo[i]), int(at[i]), start[:, i], end[:, i]))

        wait(np.searchsorted(self.key, border)[:, None], np.searchsorted(self.key, border + (1 << 32))[:, None], np.zeros(1, np.int64))
        while heap:
            taken = []
            while heap and len(taken) < AT_ONCE and (len(best) < k or (-heap[0][0], -heap[0][1]) > best[0]):
                taken.append(heapq.heappop(heap))
            if not taken:
                break
            lo, at = np.array([t[2] for t in taken]), np.array([t[3] for t in taken])
            start, end = np.stack([t[4] for t in taken], axis=1), np.stack([t[5] for t in taken], axis=1)
            middle = np.searchsorted(self.key, border[:, None] + at)
            behind = middle + (self.key[np.minimum(middle, len(self.key) - 1)] == border[:, None] + at)
            score = ((self.largest(middle, behind) >> PLACE) * times).sum(axis=0)
            for i in np.lexsort((at, -score)):
                entry = (int(score[i]), -int(self.ids[at[i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                else:
                    break
            wait(np.concatenate((start, behind), axis=1), np.concatenate((middle, end), axis=1), np.concatenate((lo, np.minimum(at + 1, len(self.ids) - 1))))


def _search(items: list[tuple], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches):
        best: list[list] = [[] for _ in items]
        rows: list[tuple] = []

        def block():
            sizes = [len(r[0]) for r in rows]
            shift = np.cumsum([0, *sizes[:-1]])
            of = [np.concatenate([r[i] for r in rows]) for i in range(5)]
            of[3] = of[3] + np.repeat(shift, [len(r[3]) for r in rows])
            index = Index(of[0], of[1], of[2], of[3], of[4], weight, n_docs, n_terms)
            if len(index.key):
                for (_, terms, times), top in zip(items, best, strict=True):
                    index.search(terms, times, top, k)
            rows.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                got = [batch.column(c)[i].values for c in ("ids", "sizes", "term", "doc", "tf")]
                rows.append(tuple(x.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False) for x in got))
                if sum(len(r[0]) for r in rows) >= BLOCK or sum(len(r[2]) for r in rows) >= POSTINGS:
                    block()
        if rows:
            block()
        out = [(at, item, None if d == -NONE else -d, s) for at, ((item, *_), top) in enumerate(zip(items, best, strict=True)) for s, d in top]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "item_id", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score of each item's k best documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, out = -(-items.count() // PARTS), None
    items = items if n <= 1 else saved(items.repartition(n), "items")
    for part in range(max(1, n)):
        some = items if n <= 1 else items.where(F.spark_partition_id() == part)
        found = _ranked(docs, [(r["item_id"], Counter(terms_of(r["text"]))) for r in some.toLocalIterator()], k)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    vocabulary = sorted(set().union(*(c for _, c in items)))
    if not vocabulary:
        return docs.where("false").select(F.col("doc_id").alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.col("doc_id").alias("score"))
    found = saved(docs.mapInArrow(_read(vocabulary), FOUND), "postings")
    n_docs, n_terms = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    held = found.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df").alias("df")).collect()  # a row a term
    df = np.zeros(len(vocabulary), np.int64)
    df[[r["seen"] for r in held]] = [r["df"] for r in held]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    coded = [(item, np.array([place[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for item, c in items if c]
    best = found.mapInArrow(_search(coded, weight, n_docs, n_terms, k), "at long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
