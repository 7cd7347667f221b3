"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: counts of the byte that follows each context of ORDER bytes and fewer.
The probability of a byte after a context is count / (total + distinct); with distinct / (total + distinct) it escapes
to the next shorter context, and below the empty context to 1 / 256. A text's code length in a language is the sum of
-log2 of these, and the language of the shortest code wins; score is its posterior under equal priors.

The trees are fitted once, on at most MOST_DOCS labelled documents of each language (those of least hash), and frozen.
Every language with a label is learned; the trees, held by driver and workers, grow with the number of languages.
Code lengths are tables by then: a byte with its context either has an entry, or costs the escape of its context plus
the entry one order below. So a column of text is scored by look-ups over flat bytes.

Defined cases: null text, or text without a letter, is `und` with score 0; with no labelled documents all are `und`;
fitting leaves out null languages and null texts; repeated rows are scored alike; an empty table gives an empty table;
other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import textbytes as tb
from paperloom.llm.store import bounded, saved

ORDER, MOST_DOCS = 3, 300
PAD = b"\n" * ORDER


def padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with PAD before each text, and the places of the true bytes."""
    n = np.diff(offs)
    place = np.arange(len(buf)) + ORDER * (np.repeat(np.arange(len(n)), n) + 1)
    out = np.full(len(buf) + ORDER * len(n), PAD[0], np.uint8)
    out[place] = buf
    return out, place


def grams(out: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Each true byte with `order` bytes before it, as one number."""
    g = np.zeros(len(place), np.uint32)
    for k in range(order, -1, -1):
        g = (g << np.uint32(8)) | out[place - k]
    return g


def _counts(batches):
    for batch in batches:
        text, langs = batch.column("text"), np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            mine = text.filter(pa.array(langs == lang))
            for _, _, buf, offs in tb.pieces(mine):
                out, place = padded(buf, offs)
                for order in range(ORDER + 1):
                    g, n = np.unique(grams(out, place, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), order, np.int32)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "order", "gram", "n"])


class Trees:
    """Frozen code lengths: for each order, sorted grams, their costs (a column a language), and escapes of contexts."""

    def __init__(self, rows):
        self.langs = sorted({r[0] for r in rows})
        column = {x: i for i, x in enumerate(self.langs)}
        below_grams, below = np.zeros(1, np.uint32), None  # order -1: any byte costs 8 bits
        self.orders = []
        for order in range(ORDER + 1):
            mine = [r for r in rows if r[1] == order]
            known = np.unique(np.array([r[2] for r in mine], np.uint32))
            contexts = np.unique(known >> np.uint32(8))
            n = np.zeros((len(known), len(self.langs)))
            at = np.searchsorted(known, np.array([r[2] for r in mine], np.uint32))
            n[at, [column[r[0]] for r in mine]] = [r[3] for r in mine]
            of = np.searchsorted(contexts, known >> np.uint32(8))
            total, kinds = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(n / (total + kinds)[of])
            lower = np.full_like(n, 8.0) if below is None else below(known & np.uint32((1 << (8 * order)) - 1))
            cost = np.where(n > 0, own, escape[of] + lower)
            self.orders.append((known, cost.astype(np.float32), contexts, escape.astype(np.float32)))
            below = lambda g, order=order: self.cost(g, order)

    @staticmethod
    def rows_of(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def cost(self, g: np.ndarray, order: int) -> np.ndarray:
        """(len(g), languages) bits of each byte given its `order` bytes of context."""
        if order < 0:
            return np.full((len(g), len(self.langs)), 8.0, np.float32)
        known, cost, contexts, escape = self.orders[order]
        if not len(known):
            return self.cost(g, order - 1)
        at, hit = self.rows_of(known, g)
        out = cost[at]
        if not hit.all():
            miss = g[~hit]
            lower = self.cost(miss & np.uint32((1 << (8 * order)) - 1), order - 1)
            c, has = self.rows_of(contexts, miss >> np.uint32(8))
            out[~hit] = lower + np.where(has[:, None], escape[c], 0)
        return out

    def bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text in each language: each distinct gram is looked up once."""
        out, place = padded(buf, offs)
        g = grams(out, place, ORDER)
        top = self.orders[ORDER][0]
        total = np.zeros((len(buf) + 1, len(self.langs)))
        at, hit = self.fast(g, top)
        per = self.orders[ORDER][1][at]
        if not hit.all():
            kinds, inverse = np.unique(g[~hit], return_inverse=True)
            per[~hit] = self.cost(kinds, ORDER)[inverse]
        np.cumsum(per, axis=0, dtype=np.float64, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    def fast(self, g: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As rows_of, by an open table of hashed places in place of a binary search."""
        if not hasattr(self, "table"):
            size = 1 << max(16, int(len(keys) * 4).bit_length())
            self.shift, table = np.uint32(32 - (size.bit_length() - 1)), np.zeros(size, np.int32)
            table[(keys * np.uint32(2_654_435_761)) >> self.shift] = np.arange(len(keys), dtype=np.int32)
            self.table = table
        at = self.table[(g * np.uint32(2_654_435_761)) >> self.shift]
        hit = keys[at] == g
        if not hit.all():  # another key has the place, or none
            miss = np.flatnonzero(~hit)
            kinds, inverse = np.unique(g[miss], return_inverse=True)
            slow, ok = self.rows_of(keys, kinds)
            at[miss], hit[miss] = slow[inverse], ok[inverse]
        return at, hit


def fitted(docs: DataFrame) -> Trees:
    """Trees of labelled docs (doc_id, text, lang), from a bounded sample of each language."""
    known = docs.where("lang is not null and text is not null")
    # a share of rows by hash that holds MOST_DOCS of each language almost surely, then exactly MOST_DOCS of them
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), 2 * MOST_DOCS / F.count("*")).alias("share"))
    order = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    some = known.withColumn("h", order).join(bounded(saved(share, "shares")), "lang").where(F.col("h") < F.col("share") * (1 << 30))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= MOST_DOCS).select("lang", "text")
    counts = some.mapInArrow(_counts, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    return Trees([tuple(r) for r in counts.collect()])  # bounded by languages * MOST_DOCS texts


def _predict(trees: Trees):
    def run(batches):
        for batch in batches:
            best, score = [], []
            for _, _, buf, offs in tb.pieces(batch.column("text")):
                bits = trees.bits(buf, offs)
                b = bits.argmin(axis=1)
                best += [trees.langs[i] for i in b]
                score.append(1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("has"), pa.array(best, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["doc_id", "has", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, over whole texts."""
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(trees.langs))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), has.alias("has"))
    if not trees.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = docs.mapInArrow(_predict(trees), "doc_id long, has boolean, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("has"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("has"), F.col("score")).otherwise(0.0).alias("score"))


def held_out() -> F.col:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, and predict the language of all."""
    trees = fitted(docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    out = predicted(docs, trees)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
