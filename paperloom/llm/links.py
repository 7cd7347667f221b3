"""Connected components of confirmed links, from candidate groups that may be very large.

No group is ever expanded into all its pairs: members are tested against one centre at a time, members whose
components have already met are passed over, and what is then left across components is compared in blocks inside
tasks, from which only confirmed or likely pairs come out.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import BROADCAST_ROWS, bounded, saved

#: The share of tested pairs that must be links for another round of centres; members compared at once in a task.
#: Pairs compared in one call; pairs of a group from which on it gets a call of its own.
FRUITFUL, BLOCK, PAIRS_AT_ONCE, PAIRS_ALONE = 0.01, 512, 50_000, 2_000
#: Edges from which on a node is a hub.
HUB = 10_000


def _told(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (v, u) with m of v, from least (v, m, n: edges of v); no shuffle brings a hub's edges into one task.

    Few nodes are broadcast; of many, those of more than HUB edges, which are few, are, and the rest is shuffled."""
    least = saved(least, "least")
    if least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least), "v")
    hubs = bounded(least.where(F.col("n") > HUB))
    rest = edges.join(hubs.select("v"), "v", "left_anti").join(least.where(F.col("n") <= HUB), "v")
    return edges.join(hubs, "v").unionByName(rest)


def star_components(links: DataFrame) -> DataFrame:
    """links (a, b), any order -> (id, label): label is the smallest id of id's component. Ids without a link are absent.

    Alternating large-star and small-star: each step hangs the neighbours of a node on the smallest of them. A node's
    neighbourhood is only ever reduced to its minimum, so that hubs are aggregated before any shuffle. Null ends and
    self-links are ignored; repeated links do no harm; an empty input gives an empty result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges, state = saved(links, "edges"), None
    while True:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("v", "m"))
        # large star: neighbours above v hang on the least neighbour
        large = _told(both, least).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        # small star: v and its smaller neighbours hang on the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = _told(large, low).select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        edges = saved(small.where("v <> u").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("label")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct()).groupBy("id").agg(F.min("label").alias("label"))


def repeated_keys(buckets: DataFrame) -> DataFrame:
    """Of candidate rows (key, id), those of keys that several ids share, without repetition.

    With a boolean column own, a key must be some id's own as well: ids that only probe it are no candidates of each other.
    """
    keys = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = saved(keys.where("lo <> hi").select("key"), "keys")
    members = buckets.join(bounded(shared), "key")
    if "own" not in buckets.columns:
        return saved(members.distinct(), "members")
    members = saved(members.groupBy("key", "id").agg(F.max("own").alias("own")), "sided")
    owned = saved(members.where("own").select("key").distinct(), "owned")
    return saved(members.select("key", "id").join(bounded(owned), "key"), "members")


def _carried(batches):
    """Columns of whole groups (rows with one grp, which come together): id, label, block, grp as arrays, data as a list."""
    held = None
    for batch in batches:
        got = [batch.column(c).to_numpy() for c in ("grp", "id", "label", "block")] + [batch.column("data").to_pylist()]
        if held is not None:
            got = [np.concatenate((x, y)) for x, y in zip(held[:4], got[:4], strict=True)] + [held[4] + got[4]]
        if not len(got[0]):
            continue
        tail = int(np.flatnonzero(got[0] == got[0][-1])[0])
        if tail:
            yield [x[:tail] for x in got]
        held = [x[tail:] for x in got]
    if held is not None:
        yield held


def _across(near, out):
    """Pairs of unlike labels in each group that pass near: as links, one for each two labels, or their members' rows."""

    def told(x, y, grp, ids, label, block):
        if out == "links":
            one, two = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            first = np.unique(np.stack((one, two)), axis=1, return_index=True)[1]
            a, b = ids[x[first]], ids[y[first]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        of = np.unique(np.concatenate((x, y)))
        return pa.RecordBatch.from_arrays([pa.array(v[of]) for v in (grp, ids, label, block)], ["grp", "id", "label", "block"])

    def run(batches):
        for grp, ids, label, block, data in _carried(batches):
            cuts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
            waiting: list[tuple] = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x, y = np.triu_indices(e - s, 1)
                x, y = x + s, y + s
                new = label[x] != label[y]
                if block[s:e].min() != block[s:e].max():  # two blocks: each block alone is a group of its own
                    new &= block[x] != block[y]
                x, y = x[new], y[new]
                alone = len(x) >= PAIRS_ALONE
                if not alone and len(x):
                    waiting.append((x, y))
                full = waiting and (e == len(grp) or sum(len(w[0]) for w in waiting) >= PAIRS_AT_ONCE)
                for x, y in ([(x, y)] if alone else []) + ([tuple(map(np.concatenate, zip(*waiting, strict=True)))] if full else []):
                    ok = near(data, x, y)
                    if ok.any():
                        yield told(x[ok], y[ok], grp, ids, label, block)
                waiting = [] if full else waiting

    return run


def _beside(near):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            data = batch.column("da").to_pylist() + batch.column("db").to_pylist()
            ok = near(data, np.arange(n), np.arange(n, 2 * n)) if n else []
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def linked(members: DataFrame, payload: DataFrame, near: Callable, full: DataFrame | None = None, exact: Callable | None = None) -> DataFrame:
    """Components (id, label) of the links among members of a key, over rows (key, id) as repeated_keys returns them.

    payload: (id, data), rows for each id. near(data, x, y) tells for two arrays of places in the list data which
    pairs are links; or, if full and exact are given, which may be: full then is (id, data) for exact(data, x, y).
    Every pair of members of a key is tested, or joined by links that are, so that the components are those of all links.

    Rounds of one centre a key go on while they find links for at least FRUITFUL of the pairs they test. What is left
    across components is compared inside tasks, in blocks of BLOCK members of a key; out of those come rows in
    proportion to members or components, never to pairs.
    """
    links, labels, turn = None, None, 0

    def beside(pairs: DataFrame, data: DataFrame, test: Callable) -> DataFrame:
        one, two = data.select(F.col("id").alias("a"), F.col("data").alias("da")), data.select(F.col("id").alias("b"), F.col("data").alias("db"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(_beside(test), "a long, b long")

    while True:
        now = members.withColumn("label", F.col("id"))
        if labels is not None:
            now = members.join(bounded(labels), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        open_keys = saved(now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "open")
        now = saved(now.join(bounded(open_keys), "key"), "across")
        if turn and found.count() < FRUITFUL * tested:
            break
        rank = F.col("id") if not turn else F.xxhash64("id", F.lit(turn))
        centre = now.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "id", "label")).alias("c")).select("key", F.col("c.id").alias("id2"), F.col("c.label").alias("label2"))
        pairs = now.join(bounded(centre), "key").where("label <> label2")
        pairs = saved(pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "pairs")
        tested = pairs.count()
        if not tested:
            break
        found = beside(pairs, payload, near)
        if exact:
            found = beside(saved(found.distinct(), "likely"), full, exact)
        found = saved(found, "links")
        links = found if links is None else links.unionByName(found)
        labels, turn = saved(star_components(links), "labels"), turn + 1
    if not tested:
        return members.where("false").select("id", F.col("id").alias("label")) if labels is None else labels
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    now = now.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    now = now.select("id", "label", "block", F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("grp"))
    in_task = lambda rows, data: rows.join(data, "id").repartition("grp").sortWithinPartitions("grp").select("grp", "id", "label", "block", "data")
    if exact:
        likely = in_task(now, payload).mapInArrow(_across(near, "members"), "grp long, id long, label long, block int").distinct()
        found = in_task(saved(likely, "likely"), full).mapInArrow(_across(exact, "links"), "a long, b long")
    else:
        found = in_task(now, payload).mapInArrow(_across(near, "links"), "a long, b long")
    found = saved(found.distinct(), "links")
    if not found.limit(1).count():
        return labels
    return saved(star_components(links.unionByName(found)), "labels")
