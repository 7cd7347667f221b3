"""MinHash near-duplicate classes: universal hash minima, bands, verified links, connected components.

Each text is lower-cased (A-Z), cut into words at ASCII white space, and stands for the set of its shingles of five
words (a text of fewer words for one shingle of them all; a text without words for the empty set, linked with
nothing). Texts with equal sets are one class before anything is compared. 128 multiply-add minima make 32 bands of 4:
two sets of similarity 0.75 miss all bands with probability 5e-6. A candidate pair is passed over when its signatures
agree in under 0.55 (5 standard deviations below 0.75); the others are decided on their full sets of 64-bit shingle
hashes, with whole numbers.

Defined cases: null text is an empty text; a null doc_id takes no part (component null, kept true); rows that share a
doc_id are one document with the links of all its texts; an empty table gives an empty table; columns other than
doc_id and text are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbytes as tb
from paperloom.llm.links import linked, repeated_keys
from paperloom.llm.store import bounded, named, numbered, saved

HASHES, ROWS, WIDTH = 128, 4, 5
#: Similarity in hundredths; the share of agreeing minima under which a pair is not looked at.
SIMILAR, SIGNED = 75, 0.55
_rng = np.random.default_rng(97)
MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
BLOCK = 1024
#: Pairs for each text from which on products replace single intersections; cells of an incidence matrix.
DENSE, COLUMNS = 4, 1 << 22


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """For each text the sorted distinct hashes of its shingles."""
    for _, _, buf, offs in tb.pieces(texts):
        start, end, first = tb.words(buf, offs)
        h = tb.Hasher(tb.LOWER[buf])(start, end) if len(buf) else np.zeros(0, np.uint64)
        w = tb.windows(h, width)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= width:
                yield np.unique(w[s : e - width + 1])
            else:
                yield tb.windows(h[s:e], e - s) if e > s else h[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over the set."""
    h, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFF_FFFF, np.uint32)
    for at in range(0, len(h), BLOCK):
        np.minimum(out, (MULTIPLY[:, None] * h[None, at : at + BLOCK] + ADD[:, None]).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """(n, HASHES) minima -> (n, bands) keys."""
    m = m.reshape(len(m), -1, ROWS).astype(np.uint64)
    k = np.broadcast_to(np.arange(1, m.shape[1] + 1, dtype=np.uint64), m.shape[:2])
    for j in range(ROWS):
        k = tb.mixed(k * np.uint64(0x9DDF_EA08_EB38_2D69) + m[:, :, j])
    return k.view(np.int64)


def _sketch(batches):
    for batch in batches:
        m, n, one, two = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            m.append(minima(s))
            one.append(np.add.reduce(tb.mixed(s ^ np.uint64(0x51ED_270B_0A1F_39C1))))
            two.append(np.bitwise_xor.reduce(tb.mixed(s + np.uint64(0x2545_F491_4F6C_DD1D))))
        if not n:
            continue
        m = np.array(m)
        keys = band_keys(m)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(np.array(one, np.uint64).view(np.int64)),
                pa.array(np.array(two, np.uint64).view(np.int64)),
                pa.array([x.tobytes() for x in m.astype(np.uint8)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
            ],
            ["doc_id", "n_shingles", "f1", "f2", "signature", "bands"],
        )


def _agree(data, x, y):
    m = np.frombuffer(b"".join(data), np.uint8).reshape(-1, HASHES)
    return np.concatenate([(m[x[k : k + BLOCK]] == m[y[k : k + BLOCK]]).mean(axis=1) >= SIGNED for k in range(0, len(x), BLOCK)])


def _similar(data, x, y):
    """Whether the full shingle sets of texts data[x[i]] and data[y[i]] reach SIMILAR, for each i."""
    of, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    sets = list(shingle_sets(pa.array([data[i] for i in of], pa.string())))
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    possible = np.flatnonzero((100 * np.minimum(n[x], n[y]) >= SIMILAR * np.maximum(n[x], n[y])) & (n[x] > 0))
    both = np.zeros(len(x), np.int64)
    if len(possible) < DENSE * len(sets):
        for i in possible:
            both[i] = len(np.intersect1d(sets[x[i]], sets[y[i]], assume_unique=True))
    else:  # many pairs of few texts: products of their incidence columns
        owner, all_of = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        _, column, times = np.unique(all_of, return_inverse=True, return_counts=True)
        owner, column = owner[times[column] > 1], column[times[column] > 1]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        counts = np.zeros((len(sets), len(sets)), np.float32)
        width = max(256, COLUMNS // len(sets))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, (first, first + width))
            m = np.zeros((len(sets), width), np.float32)
            m[owner[s:e], column[s:e] - first] = 1
            counts += m @ m.T
        both[possible] = counts[x[possible], y[possible]].astype(np.int64)
    return (both > 0) & (100 * both >= SIMILAR * (n[x] + n[y] - both))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (least linked doc_id), kept; a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = saved(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>"), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copied = saved(classes.where("rep <> last").drop("last"), "classes")
    # one document of each class goes on, by its own row; other texts of the copies' documents go on as well
    row = ["doc_id", "f1", "f2", "n_shingles"]
    rows = saved(full.select(*row).join(bounded(copied), row[1:]).select(*row, "rep").distinct(), "copies")
    member = rows.select("doc_id", "rep").distinct()
    reps = full.join(bounded(rows.where("doc_id <> rep").select(*row)), row, "left_anti")
    members = repeated_keys(reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")))
    ids = saved(members.select("id").distinct(), "ids")
    signed = saved(reps.select(F.col("doc_id").alias("id"), F.col("signature").alias("data")).join(bounded(ids), "id"), "signatures")
    texts = saved(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("data")).join(bounded(ids), "id"), "texts")

    labels = linked(members, signed, _agree, texts, _similar)
    # a document with several texts ties their classes together, so classes and links meet in one more graph only then
    several = member.groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).where("k > 1").limit(1).count()
    copies = member.where("doc_id <> rep")
    if several or copies.join(bounded(labels.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").limit(1).count():
        from paperloom.llm.links import star_components

        labels = saved(star_components(member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))), "labels")
        of = labels.withColumnRenamed("id", "doc_id")
    else:
        copies = copies.join(bounded(labels.withColumnRenamed("id", "rep")), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("label"))
        of = labels.withColumnRenamed("id", "doc_id").unionByName(copies)
    of = saved(of, "components")
    out = sketches.select("doc_id", "n_shingles").join(bounded(of), "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents whose near-duplicate class has a smaller doc_id; all columns stay.

    Of rows that share a kept doc_id with the same text one stays. Rows with a null doc_id stay.
    """
    plain, c = numbered(docs)
    doc_id, text = c["doc_id"], c["text"]
    away = saved(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct(), "away")
    stay = plain.join(bounded(away), doc_id, "left_anti").select(*plain.columns)
    again = saved(plain.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias("times")).where("times > 1").select(doc_id), "again")
    if not again.limit(1).count():
        return stay.select(*named(docs))
    once = stay.join(bounded(again), doc_id, "left_semi").select(*plain.columns).dropDuplicates([doc_id, text])
    return stay.join(bounded(again), doc_id, "left_anti").select(*plain.columns).unionByName(once).select(*named(docs))
