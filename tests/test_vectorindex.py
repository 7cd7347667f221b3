"""The stored vector index: recall, pruned lists, added and deleted rows, wrong models, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.sources import vectorindex as V

SCHEMA = "chunk_id long, paper_id long, slugs string, v array<double>"


def clustered(n=1500, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    return [(i, i // 5, "|a|" if i % 3 else "|b|", (centres[i % 12] + 0.4 * r.normal(size=16)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at, rows = f"{tmp_path_factory.mktemp('index')}/i", clustered()
    odd = [(9001, 1, "|a|", None), (9002, 1, "|a|", [0.0] * 16)]
    V.build(spark.createDataFrame(rows + odd, SCHEMA), at, "m", 12)
    return at, {r[0]: r for r in rows}


def exact(rows, w, k, keep=lambda r: True):
    w = np.array(w)
    of = [(-round(float(np.dot(r[3], w) / (np.linalg.norm(r[3]) * np.linalg.norm(w) + 1e-12)), 9), i) for i, r in rows.items() if keep(r)]
    return [i for _, i in sorted(of)[:k]]


def test_recall_of_few_lists(spark, index):
    at, rows = index
    asked = spark.createDataFrame([(i, rows[i][3]) for i in range(0, 1500, 30)], "question long, w array<double>")
    got = V.nearest(spark, at, asked, 10, 3).collect()
    found = {}
    for r in got:
        found.setdefault(r["question"], set()).add(r["chunk_id"])
    hits = sum(len(found[i] & set(exact(rows, rows[i][3], 10))) for i in range(0, 1500, 30))
    assert hits >= 0.9 * 500
    every = V.nearest(spark, at, asked, 10, 12).collect()
    assert [r["chunk_id"] for r in sorted(every, key=lambda r: (r["question"], r["rank"]))] == [j for i in range(0, 1500, 30) for j in exact(rows, rows[i][3], 10)]


def test_a_question_reads_its_lists(spark, index):
    at, rows = index
    asked = spark.createDataFrame([(0, rows[0][3])], "question long, w array<double>")
    out = V.nearest(spark, at, asked, 5, 2, F.col("slugs") == "|b|")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "PushedFilters: [" in plan and "EqualTo(slugs,|b|)" in plan
    files = V.opened(spark, at, [0, 1]).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("list=0/" in r["f"] or "list=1/" in r["f"] for r in files)


def test_added_and_deleted(spark, tmp_path):
    at, rows = f"{tmp_path}/i", clustered(200)
    table = lambda of: spark.createDataFrame(of, SCHEMA)
    V.build(table(rows[:100]), at, "m", 4)
    V.add(table(rows[100:]), at, "m")
    V.delete(table(rows[:10]).select("chunk_id"), at)
    V.add(table([(5, 77, "|c|", rows[50][3])]), at, "m")
    got = {r["chunk_id"]: r["paper_id"] for r in V.opened(spark, at).collect()}
    assert got == {i: p for i, p, *_ in rows[10:]} | {5: 77} and V.opened(spark, at).count() == 191
    with pytest.raises(ValueError, match="holds 16 numbers of m"):
        V.add(table(rows[:1]), at, "other")
    V.build(table(rows[:20]), at, "m2", 4)
    assert V.opened(spark, at).count() == 20 and V.meta(spark, at)["model"] == "m2"
    with pytest.raises(ValueError, match="no vector"):
        V.build(table([(1, 1, "x", None)]), at, "m", 4)
    assert V.opened(spark, at).count() == 20


def test_many_questions_and_equal_rows(spark, tmp_path, monkeypatch):
    """More questions than a block holds, blocks of few rows, and more equal rows than are asked for: as all pairs tell."""
    monkeypatch.setattr(V, "ROWS", 300)
    monkeypatch.setattr(V, "QUESTIONS", 400)
    at, rows = f"{tmp_path}/i", clustered(1200)
    rows += [(5000 + i, 1, "|a|", rows[7][3]) for i in range(60)]
    V.build(spark.createDataFrame(rows, SCHEMA), at, "m", 3)
    asked = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(-1, [0.0] * 16)], "question long, w array<double>")
    got = {}
    for r in V.nearest(spark, at, asked, 4, 3, F.col("slugs") == "|a|").collect():
        got.setdefault(r["question"], []).append((r["rank"], r["chunk_id"], r["paper_id"]))
    of = {r[0]: r for r in rows}
    assert len(got) == 1261 and [i for _, i, _ in sorted(got[-1])] == sorted(i for i, r in of.items() if r[2] == "|a|")[:4]
    for q in [*range(0, 1200, 40), 7, 5000, 5059]:
        want = exact(of, of[q][3], 4, lambda r: r[2] == "|a|")
        assert sorted(got[q]) == [(n, i, of[i][1]) for n, i in enumerate(want, 1)]
