"""Line de-duplication by a segment-partition edit join.

Unit: \\n-split lines that are not blank (ASCII white space), as they are. Two lines are the same if their edit distance
(insertions, deletions, substitutions of code points) is at most what the shorter one allows, one edit for each PER_EDIT
of its code points and EDITS at most, or if such steps connect them; of each class the occurrence with the least
(doc_id, line number) stays and the others leave their texts. Lines that allow no edit are the same if they are equal.

A line that allows e edits is cut into e + 1 even segments. So many edits leave one segment whole, so a line within that
distance holds it at one of few starts, which follow from both lengths; each line is filed under its own segments and
under the substrings at those starts, for each length that the shorter line may have. Lines that share a key are
compared by a banded bit-parallel edit distance.

Defined cases: null text and null doc_id pass unchanged and take no part; blank lines are left alone; rows that share
a doc_id lose the same line numbers; a text whose every line leaves becomes empty; an empty table gives an empty
table; all columns stay, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.llm import textbytes as tb
from paperloom.llm.links import linked, repeated_keys
from paperloom.llm.store import bounded, named, numbered, saved

EDITS, PER_EDIT = 2, 15
#: Cells of a padded matrix of code points at once; columns between two looks at which pairs are still near.
CELLS, LOOK = 1 << 20, 12


def within(data: list[str], x: np.ndarray, y: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Whether the edit distance of data[x[i]] and data[y[i]] is at most `edits`, for each i."""
    out = np.zeros(len(x), bool)
    size = np.fromiter(map(len, data), np.int64, len(data))
    m, n = size[x], size[y]
    todo = np.flatnonzero(np.abs(m - n) <= edits)
    tiny = np.minimum(m[todo], n[todo]) <= edits
    for i in todo[tiny]:  # shorter than the band
        a, row = data[x[i]], list(range(n[i] + 1))
        for r, c in enumerate(a, 1):
            old, row[0] = row[:], r
            for k, d in enumerate(data[y[i]], 1):
                row[k] = min(old[k] + 1, row[k - 1] + 1, old[k - 1] + (c != d))
        out[i] = row[-1] <= edits
    todo = todo[~tiny]
    todo = todo[np.argsort(m[todo], kind="stable")]
    at = 0
    while at < len(todo):
        end = min(len(todo), at + 4096)
        while end > at + 1 and (end - at) * m[todo[end - 1]] > CELLS:
            end = at + (end - at) // 2
        part = todo[at:end]
        out[part] = _banded([data[i] for i in x[part]], [data[i] for i in y[part]], edits)
        at = end
    return out


def _matrix(texts: list[str], left: int, width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.uint32)
    for row, t in zip(out, texts, strict=True):
        row[left : left + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Distances within the band of 2 * edits + 1 diagonals; a bit of a word stands for one diagonal.

    At column j, bit k is row j - edits + k. Vertical differences travel as two bit sets; the score is followed down
    the lowest diagonal to the last row of a, then along that row to the last column of b.
    """
    band, u = 2 * edits + 1, np.uint64
    m, n = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
    wide = int(max(m.max(), n.max())) + 1
    rows, cols = _matrix(a, edits, wide + 2 * edits + 1, 0xFFFF_FFFF), _matrix(b, 0, wide, 0xFFFF_FFFE)
    alive, full, low = np.arange(len(a)), u((1 << band) - 1), u(2 * edits)
    plus = np.full(len(a), u(((1 << band) - 1) ^ ((1 << edits) - 1)))
    minus, score = np.zeros(len(a), u), np.full(len(a), edits, np.int64)
    out = np.zeros(len(a), bool)
    for j in range(1, int(n.max()) + 1):
        equal = np.zeros(len(alive), u)
        for k in range(band):
            equal |= (rows[:, j - 1 + k] == cols[:, j - 1]).astype(u) << u(k)
        same = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        up, down = (minus | ~(same | plus)) & full, same & plus
        diagonal = j <= m - edits
        shift = np.clip(m - j + edits, 0, band - 1).astype(u)
        step = np.where(diagonal, 1 - ((same >> low) & u(1)).astype(np.int64), ((up >> shift) & u(1)).astype(np.int64) - ((down >> shift) & u(1)).astype(np.int64))
        score += np.where(j <= n, step, 0)
        plus = (down | ~((same >> u(1)) | up)) & full
        minus = (same >> u(1)) & up
        ended = j >= n
        if ended.any() or j % LOOK == 0:
            out[alive[ended]] = score[ended] <= edits
            go = ~ended & (score <= 3 * edits)
            if not go.any():
                break
            if not go.all():
                alive, rows, cols, m, n, plus, minus, score = (v[go] for v in (alive, rows, cols, m, n, plus, minus, score))
    return out


def allowed(length: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    """The edits that lines of such lengths allow."""
    return np.minimum(length // per_edit, edits)


def near(edits: int, per_edit: int):
    """For data, x, y: whether data[x[i]] and data[y[i]] are within the edits that the shorter of them allows."""

    def run(data: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = np.fromiter(map(len, data), np.int64, len(data))
        most, out = allowed(np.minimum(size[x], size[y]), edits, per_edit), np.zeros(len(x), bool)
        for e in range(1, edits + 1):
            of = np.flatnonzero(most == e)
            if len(of):
                out[of] = within(data, x[of], y[of], e)
        return out

    return run


def _lines(batch, least: int = 0):
    """For each piece: buf, its code points' places, and of the lines that are not blank and have at least so many code
    points starts, ends, first code point and their number, document, line number, hash."""
    for at, _, buf, offs in tb.pieces(batch.column("text")):
        start, end, first = tb.lines(buf, offs)
        point = np.flatnonzero((buf & 0xC0) != 0x80)
        a, b = np.searchsorted(point, start), np.searchsorted(point, end)
        seen = np.concatenate(([0], np.cumsum(~tb.SPACE[buf])))
        keep = (b - a >= least) & (seen[end] > seen[start])
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        number = np.arange(len(start)) - first[doc]
        hasher = tb.Hasher(buf)
        start, end, doc, number, a, b = (v[keep] for v in (start, end, doc, number, a, b))
        yield buf, np.append(point, len(buf)), hasher, start, end, a, b - a, doc + at, number, hasher(start, end).view(np.int64)


def _occurrences(batches):
    for batch in batches:
        for *_, doc, number, h in _lines(batch):
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int64())], ["h", "doc_id", "line"])


def _texts(least: int):
    def run(batches):
        for batch in batches:
            for buf, _, _, start, end, *_, h in _lines(batch, least):
                once = np.unique(h, return_index=True)[1]
                raw = buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h[once]), pa.array([raw[s:e].decode() for s, e in zip(start[once].tolist(), end[once].tolist(), strict=True)], pa.string())], ["id", "data"])

    return run


def segments(length: np.ndarray, edits: int, per_edit: int):
    """For lines of such lengths: (length of the partner, number of the segment, start, size, in bounds, own) of each filing.

    own: a line's segment of itself; the others are where it may hold a segment of a line that is no longer."""
    for e in range(1, edits + 1):
        for shorter in range(e + 1):
            partner = length - shorter
            cut = allowed(partner, edits, per_edit) == e
            base, extra = partner // (e + 1), partner % (e + 1)
            for i in range(e + 1):
                size = base + (i >= e + 1 - extra)
                place = i * base + np.maximum(0, i - (e + 1 - extra))
                for off in range(max(-i, shorter - (e - i)), min(i, shorter + e - i) + 1):
                    start = place + off
                    yield partner, i, start, size, cut & (start >= 0) & (start + size <= length) & (size > 0), not shorter and not off


def _filings(edits: int, per_edit: int):
    def run(batches):
        for batch in batches:
            for _, point, hasher, _, _, a, length, *_, h in _lines(batch, per_edit):
                once = np.unique(h, return_index=True)[1]
                a, length, h = a[once], length[once], h[once]
                keys, ids, owned = [], [], []
                for partner, i, start, size, ok, own in segments(length, edits, per_edit):
                    s = a[ok] + start[ok]
                    key = tb.mixed(hasher(point[s], point[s + size[ok]]) + (partner[ok] * 64 + i).astype(np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15))
                    keys.append(key.view(np.int64))
                    ids.append(h[ok])
                    owned.append(np.full(len(key), own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, owned)], ["key", "id", "own"])

    return run


def repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, gone: the numbers of the lines that leave each document, for those that lose any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    members = repeated_keys(docs.mapInArrow(_filings(edits, per_edit), "key long, id long, own boolean"))
    ids = saved(members.select("id").distinct(), "ids")
    lines = docs.mapInArrow(_texts(per_edit), "id long, data string")
    payload = saved(lines.join(bounded(ids), "id").dropDuplicates(["id"]), "lines")
    labels = linked(members, payload, near(edits, per_edit))
    found = saved(docs.mapInArrow(_occurrences, "h long, doc_id long, line long"), "occurrences")
    found = found.join(bounded(labels.withColumnRenamed("id", "h")), "h", "left").select(F.coalesce("label", "h").alias("g"), "doc_id", "line")
    first = found.groupBy("g").agg(F.min("doc_id").alias("doc0"), F.count("*").alias("n")).where("n > 1").select("g", "doc0")
    again = found.join(bounded(saved(first, "first")), "g").groupBy("doc_id", "g", "doc0").agg(F.collect_set("line").alias("at"))
    # the first document of a class keeps its first line
    away = again.select("doc_id", F.explode(F.when(F.col("doc_id") == F.col("doc0"), F.array_remove("at", F.array_min("at"))).otherwise(F.col("at"))).alias("line"))
    return away.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("gone"))


@F.arrow_udf(StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if t is not None and g:
            g = set(g)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
        out.append(t)
    return pa.array(out, pa.string())


def _removed(docs: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """numbered(docs), its texts without their repeated lines, plus removed, the number of these."""
    plain, c = numbered(docs)
    gone = repeated_lines(plain.select(F.col(c["doc_id"]).alias("doc_id"), F.col(c["text"]).alias("text")), edits, per_edit)
    out = plain.join(gone, F.col(c["doc_id"]) == F.col("doc_id"), "left")
    return out.withColumn(c["text"], _without(c["text"], "gone")).withColumn("removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))


def line_removals(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, text without its repeated lines, and removed, the number of these, for each row of docs."""
    c = numbered(docs)[1]
    return _removed(docs, edits, per_edit).select(F.col(c["doc_id"]).alias("doc_id"), F.col(c["text"]).alias("text"), "removed")


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """docs with the repeated lines taken out of text; every row and column stays, and n_chars, if there, follows."""
    c = numbered(docs)[1]
    out = _removed(docs, edits, per_edit)
    if "n_chars" in c:
        changed = F.when(F.col("removed") > 0, F.length(c["text"]).cast("long")).otherwise(F.col(c["n_chars"]).cast("long"))
        out = out.withColumn(c["n_chars"], changed)
    return out.select(*named(docs))
