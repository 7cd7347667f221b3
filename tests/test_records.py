"""Copies, refreshed sources, discarded drafts, followed columns and topic lists on small odd tables."""

import itertools
import random

from pyspark.sql import functions as F

from paperloom.functions import projections
from paperloom.operators import merge, topics, vault


def test_marked_copies(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.choice(["a", "b", None]), rng.choice([True, False, None]), rng.choice(["10.1/x", "", None]), rng.choice([True, False, None]), rng.choice([None, 0, 3, 3])) for i in range(120)]
    df = spark.createDataFrame(rows, "paper_id long, person int, key string, claimed boolean, doi string, abstract boolean, cited int")
    got = {r["paper_id"]: r["duplicate_of"] for r in merge.marked_copies(df, ["person", "key"], "paper_id", merge.version_rank(*map(F.col, ("claimed", "doi", "abstract", "cited")))).collect()}
    rank = lambda r: (1 if r[3] is None else 2 * r[3], bool(r[4]), bool(r[5]), r[6] or 0)
    best = {}
    for r in rows:
        if r[2] is not None and ((r[1], r[2]) not in best or rank(r) > rank(best[r[1], r[2]])):
            best[r[1], r[2]] = r
    assert got == {r[0]: None if r[2] is None or best[r[1], r[2]][0] == r[0] else best[r[1], r[2]][0] for r in rows}
    assert merge.marked_copies(df.limit(0), ["person", "key"], "paper_id", F.struct("cited")).count() == 0


def test_refreshed(spark):
    stored = [(1, "W1", None, "10.1/a", True, False), (1, "M2", "W2", None, True, False), (1, "W3", None, "10.1/c", False, False), (1, "prosopia:4", "W4", "", False, True), (2, "W9", None, "10.1/z", True, False)]
    works = [(1, w, d) for w, d in (("W1", None), ("W2", "x"), ("W3", "10.1/c"), ("W4", ""), ("W5", "10.1/a"), ("W6", ""), ("W7", None), ("W8", None), ("W9", "10.1/z"))]
    marks = [(1, "W7", "duplicate"), (1, "W8", "skipped"), (1, "W1", "skipped"), (1, "W7", "skipped"), (1, "W99", "skipped")]
    s = spark.createDataFrame(stored, "researcher int, paper_id string, source_id string, doi string, resolved boolean, synthetic boolean")
    w, m = spark.createDataFrame(works, "researcher int, work string, doi string"), spark.createDataFrame(marks, "researcher int, work string, mark string")
    got = {r["work"]: r["state"] for r in vault.refreshed(w, s, m).collect()}
    assert got == {"W1": "saved", "W2": "saved", "W3": "new", "W4": "saved", "W5": "saved", "W6": "new", "W7": "saved", "W8": "skipped", "W9": "new"}
    assert {r["state"] for r in vault.refreshed(w, s.limit(0), m.limit(0)).collect()} == {"new"}


def test_discarded(spark):
    """Against looking at one paper after the other, versions first."""
    rng = random.Random(8)
    for _ in range(4):
        brought = {(rng.randrange(3), rng.randrange(20)) for _ in range(25)}
        uses, versions = {rng.randrange(20) for _ in range(4)}, [(i, i + 1) for i in range(0, 20, 4)] + [(2, 1)]
        want = set()
        for draft in range(3):
            mine = {p for d, p in brought if d == draft}
            others = {p for d, p in brought if d != draft} | uses
            live = dict(versions)
            for p in sorted(mine, key=lambda p: p not in dict(versions)):
                if p not in others and p not in {c for v, c in versions if v in live}:
                    want.add((draft, p))
                    live.pop(p, None)
        b = spark.createDataFrame(sorted(brought), "draft int, paper_id int")
        u, v = spark.createDataFrame([(x,) for x in uses], "paper_id int"), spark.createDataFrame(versions, "version_id int, canonical_id int")
        assert {tuple(r) for r in vault.discarded(b.unionByName(b), u, v).collect()} == want


def test_following(spark):
    cols = ["paper_id", "title", *vault.FOLLOWED]
    rows = [(1, "own", *["old"] * 7), (2, "public", "new", *[None] * 5, "new"), (3, "lone", *["own"] * 7), (4, None, *[None] * 7)]
    p, v = spark.createDataFrame(rows, ", ".join(f"{c} string" if c != "paper_id" else "paper_id int" for c in cols)), spark.createDataFrame([(1, 2), (3, 99)], "version_id int, canonical_id int")
    got = {r[0]: tuple(r) for r in vault.following(p, v).collect()}
    assert got == {1: (1, "own", "new", *["old"] * 5, "new"), 2: rows[1], 3: rows[2], 4: rows[3]}


def test_levels(spark):
    node = "struct<id string, display_name string>"
    t = f"struct<id string, display_name string, subfield {node}, field {node}, domain {node}>"
    a, b = ("T1", "one", ("S1", "s"), ("F1", "f"), ("D1", "d")), ("T2", "two", None, ("F1", "other name"), ("", "no id"))
    works = spark.createDataFrame([(1, a, [a, b]), (2, None, [b]), (3, None, None), (4, b, [])], f"paper_id int, primary_topic {t}, topics array<{t}>")
    got = {(r["level"], r["id"]): (r["name"], r["count"], r["papers"], r["rank"]) for r in topics.hierarchy_counts(topics.level_mentions(works)).collect()}
    assert got == {("topic", "T1"): ("one", 2, 1, 2), ("topic", "T2"): ("two", 3, 3, 1), ("subfield", "S1"): ("s", 2, 1, 1), ("field", "F1"): ("f", 5, 3, 1), ("domain", "D1"): ("d", 2, 1, 1)}


def test_topic_lists(spark):
    flags = [("", True), (', "on": null', False), (', "on": 0', False), (', "on": "x"', True), (', "on": []', False), (', "on": {"a": 1}', True)]
    rows = [(i, f'{{"topics": [{{"id": "T{i}"{f}}}]}}') for i, (f, _) in enumerate(flags)]
    rows += [(50, None), (51, ""), (52, "broken {"), (53, '{"topics": null}'), (54, '{"topics": [{}, {"id": ""}, {"id": null}]}')]
    rows += [(60, '{"topics": [{"id": "A", "count": "7", "unmatched": 1}, {"id": "B", "unmatched": false, "source": "llm", "concept": "c", "confidence": 0.5}]}')]
    df = spark.createDataFrame(rows, "profile int, filters string").withColumn("brought", F.when(F.col("profile") == 60, F.array(F.lit("B"))))
    got = projections.topics(df).collect()
    assert [(r["profile"], r["is_on"]) for r in got if r["profile"] < 50] == [(i, w) for i, (_, w) in enumerate(flags)]
    last = [r for r in got if r["profile"] >= 50]
    assert [(r["id"], r["place"], r["count"], r["unmatched"], r["unmatched_why"], r["new"], r["umls_concept"]) for r in last] == [("A", 0, 7, True, "no_seed", False, None), ("B", 1, 0, None, None, True, None)]
    assert all(r["new"] is None for r in got if r["profile"] < 50)


def test_opened_then_swapped_is_the_edit(spark):
    rows = spark.createDataFrame(list(itertools.product((1, 2), range(4))), "profile int, paper_id int")
    both = merge.opened(rows, "profile", spark.createDataFrame([(2, 102)], "profile int, draft int"))
    assert both.count() == 12 and both.where("profile = 102").count() == 4
    edited = both.where("profile = 102 and paper_id <> 3").withColumn("profile", F.lit(2))
    saved = merge.swapped(both.where("profile <> 102"), edited, "profile")
    assert {tuple(r) for r in saved.collect()} == {(1, i) for i in range(4)} | {(2, i) for i in range(3)}
