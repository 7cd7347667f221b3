"""Query modes and lexical scores by hand; snapshots under two writers; the refresh of stale logits."""

import math
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from paperloom.operators import logits, querymodes
from paperloom.sources.snapshots import Conflict, Snapshots

SEEDS = [("a", 2, "Second", "on lungs"), ("a", 1, "First title", None), ("a", 3, "", "only abstract"), ("b", 1, "Lone", ""), ("c", 1, None, None)]
TOPICS = [("a", 1, "Kidneys", True), ("a", 2, "Off", False), ("a", 3, None, True), ("b", 1, "Off", False)]


def tables(spark):
    return (
        spark.createDataFrame(TOPICS, "profile string, pos int, name string, is_on boolean"),
        spark.createDataFrame([("b", 1, "renal care"), ("b", 2, "  ")], "profile string, pos int, term string"),
        spark.createDataFrame(SEEDS, "profile string, pos int, title string, abstract string"),
    )


@pytest.mark.parametrize(
    "mode,want",
    [
        ("topic", {("a", 0, "Kidneys"), ("b", 0, "Lone")}),
        ("title", {("a", 0, "First title"), ("a", 1, "Second"), ("b", 0, "Lone")}),
        ("article", {("a", 0, "First title"), ("a", 1, "Second\non lungs"), ("a", 2, "only abstract"), ("b", 0, "Lone")}),
        ("terms", {("a", 0, "Kidneys"), ("b", 0, "renal care")}),
    ],
)
def test_modes(spark, mode, want):
    assert {(r["profile"], r["query_no"], r["query"]) for r in querymodes.queries_of(mode, *tables(spark)).collect()} == want


def test_most_queries(spark):
    topics, terms, _ = tables(spark)
    seeds = spark.createDataFrame([("z", i, f"title {i:02}", None) for i in range(50)], "profile string, pos int, title string, abstract string")
    got = sorted((r["query_no"], r["query"]) for r in querymodes.queries_of("title", topics, terms, seeds).collect())
    assert got == [(i, f"title {i:02}") for i in range(30)]


def test_bm25(spark):
    texts = {1: "Renal care. renal, RENAL!", 2: "care of the heart", 3: None, 4: "", 5: "heart heart é", 6: "Renal care. renal, RENAL!"}
    asked = [("p", 0, "renal heart"), ("p", 1, "é care care"), ("q", 0, "nothing here"), ("q", 1, "heart")]
    members = [("p", i) for i in texts] + [("q", 5), ("r", 1)]
    got = querymodes.lexical_scores(
        spark.createDataFrame(asked, "profile string, query_no long, query string"),
        spark.createDataFrame(list(texts.items()), "paper_id long, text string"),
        spark.createDataFrame(members, "profile string, paper_id long"),
    ).collect()
    words = lambda t: re.findall(querymodes.WORD, (t or "").lower())
    bags = {i: Counter(words(t)) for i, t in texts.items()}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    for r in got:
        bag, of = bags[r["paper_id"]], [q for p, _, q in asked if p == r["profile"]]
        scores = []
        for q in of:
            s = 0.0
            for w in set(words(q)):
                df = sum(w in b for b in bags.values())
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) if bag[w] else 0
            scores.append(s)
        assert r["logit"] == pytest.approx(max(scores)) and r["mean"] == pytest.approx(sum(scores) / len(scores))
        assert r["best_query"] == scores.index(max(scores)) and r["queries"] == len(of)
    assert {(r["profile"], r["paper_id"]) for r in got} == set(members) - {("r", 1)}
    keys = {r["profile"]: r["key"] for r in got}
    assert keys["p"] != keys["q"] and len(keys["p"]) == 64


def test_model_scores(spark):
    q = spark.createDataFrame([("p", 0, "ab"), ("p", 1, "abc")], "profile string, query_no long, query string")
    a = spark.createDataFrame([(i, "x" * i) for i in range(200)], "paper_id long, text string")
    got = querymodes.model_scores(q, a, a.selectExpr("'p' AS profile", "paper_id"), lambda pairs: [len(q) * 1000 + len(t) if len(pairs) <= 64 else -1 for q, t in pairs]).collect()
    assert {(r["paper_id"], r["query_no"], r["logit"]) for r in got} == {(i, n, (2 + n) * 1000.0 + i) for i in range(200) for n in (0, 1)}


C = "profile string, paper_id long, score_raw double, logit double, query_key string"


def test_snapshots(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    assert t.version is None
    row = lambda x: spark.createDataFrame([("p", x, 0.0, None, None)], C)
    assert t.commit(row(1), None) == 0
    with pytest.raises(Conflict):
        t.commit(row(2), None)
    assert t.commit(row(3), 0) == 1
    assert [r["paper_id"] for r in t.read().collect()] == [3] and [r["paper_id"] for r in t.read(0).collect()] == [1]
    # writers at once: every row arrives, each by its own number
    with ThreadPoolExecutor(3) as pool:
        told = list(pool.map(lambda i: t.update(lambda old: old.unionByName(row(i)), 20), (10, 11, 12)))
    assert sorted(told) == [2, 3, 4] and sorted(r["paper_id"] for r in t.read().collect()) == [3, 10, 11, 12]


def test_refresh(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([("p", i, float(i), None if i % 2 else 1.0, None if i % 2 else ("new" if i == 4 else "old")) for i in range(8)] + [("q", 1, 0.0, None, None)], C), None)
    key, calls = {"now": "new"}, []

    def score(late):
        ids = sorted(r["paper_id"] for r in late.collect())
        calls.append(ids)
        if len(calls) == 1:  # another writer sets 7 under a key of its own; the queries change too
            key["now"] = "newer"
            other = spark.createDataFrame([("p", 7, None, 5.0, "theirs")], "profile string, paper_id long, seen_key string, new_logit double, key string")
            t.update(lambda rows: logits.set_logits(rows, other))
        return late.selectExpr("profile", "paper_id", "CASE WHEN paper_id = 5 THEN NULL ELSE paper_id * 10.0D END AS new_logit")

    done = logits.refresh(t, lambda: spark.createDataFrame([("p", key["now"])], "profile string, key string"), score, limit=4)
    # 4 has the key of the first pass; the second asks for the best four of those not of the newer key, 7 first
    assert calls == [[3, 5, 6, 7], [4, 5, 6, 7]] and done == [4, 4]
    got = {r["paper_id"]: (r["logit"], r["query_key"]) for r in t.read().where("profile = 'p'").collect()}
    assert got == {0: (1.0, "old"), 1: (None, None), 2: (1.0, "old"), 3: (30.0, "new"), 4: (40.0, "newer"), 5: (None, None), 6: (60.0, "newer"), 7: (70.0, "newer")}


def test_set_only_what_was_seen(spark):
    rows = spark.createDataFrame([("p", 1, 0.0, 1.0, "old"), ("p", 2, 0.0, 1.0, "theirs"), ("p", 3, 0.0, None, None), ("p", 4, 0.0, 1.0, "old")], C)
    scored = spark.createDataFrame([("p", 1, "old", 9.0, "now"), ("p", 2, "old", 9.0, "now"), ("p", 3, None, 9.0, "now"), ("p", 4, "old", float("nan"), "now")], "profile string, paper_id long, seen_key string, new_logit double, key string")
    assert {r["paper_id"]: (r["logit"], r["query_key"]) for r in logits.set_logits(rows, scored).collect()} == {1: (9.0, "now"), 2: (1.0, "theirs"), 3: (9.0, "now"), 4: (1.0, "old")}


def test_upsert(spark):
    s = "profile string, paper_id long, score double, logit double, query_key string, topic string, saved_at long"
    stored = spark.createDataFrame([("p", 1, 0.1, 1.0, "old", "t1", 7), ("p", 2, 0.2, None, None, None, None), ("p", 3, 0.3, 3.0, "old", "t3", None)], s)
    found = spark.createDataFrame([("p", 1, 0.9, None, "new", "t9", None), ("p", 2, None, 2.5, "new", "t9", 8), ("p", 4, 0.4, None, None, None, None)], s)
    got = {r["paper_id"]: (r["score"], r["logit"], r["query_key"], r["topic"], r["saved_at"], r["is_new"]) for r in logits.upserted(stored, found).collect()}
    assert got == {1: (0.9, 1.0, "old", "t1", 7, False), 2: (None, 2.5, "new", "t9", None, False), 3: (0.3, 3.0, "old", "t3", None, False), 4: (0.4, None, None, None, None, True)}


def test_stale_fits(spark):
    t = spark.createDataFrame([("same", False, True, None), ("added", False, True, 1), ("swapped", False, True, 2), ("draft", True, True, 1), ("old", False, False, 2), ("old fewer", False, False, 3), ("untold", False, False, None), ("empty", None, True, None)], "profile string, is_draft boolean, recorded boolean, n_matrix long")
    pairs = lambda d: spark.createDataFrame([(p, i) for p, ids in d.items() for i in ids], "profile string, paper_id long")
    was = {"same": [1, 2, 2], "added": [1], "swapped": [1, 2], "draft": [1], "old": [5, 6]}
    now = {"same": [2, 1], "added": [1, 2], "swapped": [1, 3], "draft": [2], "old": [1, 2], "old fewer": [1, 2], "untold": [1]}
    from paperloom.operators import fits

    got = {r["profile"]: (r["stale"], r["added"], r["removed"]) for r in fits.stale_fits(t, pairs(was), pairs(now)).collect()}
    assert got == {"same": (False, 0, 0), "added": (True, 1, 0), "swapped": (True, 1, 1), "draft": (False, 1, 1), "old": (False, 2, 2), "old fewer": (True, 2, 0), "untold": (True, 1, 0), "empty": (False, 0, 0)}


def test_only_words_that_are_asked_for_are_counted(spark, monkeypatch):
    """Texts are cut into words once, and of their words those of queries alone are shuffled."""
    kept = []
    monkeypatch.setattr(querymodes, "cut", lambda df, cut=querymodes.cut: kept.append(cut(df)) or kept[-1])
    queries = spark.createDataFrame([("p", 0, "red fish"), ("p", 1, "fish")], "profile string, query_no long, query string")
    articles = spark.createDataFrame([(1, "One fish, two fish"), (2, "red door"), (3, "none"), (4, None)], "paper_id long, text string")
    out = querymodes.bm25(queries, articles, articles.select(F.lit("p").alias("profile"), "paper_id"))
    assert {(r["paper_id"], r["query_no"]) for r in out.collect()} == {(1, 0), (1, 1), (2, 0)}
    counts = [t for t in kept if "tf" in t.columns]
    assert len(counts) == 1 and {(r["paper_id"], r["length"], r["word"], r["tf"]) for r in counts[0].collect()} == {(1, 4, "fish", 2), (2, 2, "red", 1)}
