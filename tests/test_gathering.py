"""Operators that SQL cannot express, sources, sinks, plug-ins and streams, against plain Python."""

import json
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom import plugins
from paperloom.functions import works
from paperloom.operators import resolve, topiclists
from paperloom.plans import catalog
from paperloom.sources import documents, manifest
from paperloom.streaming import gather

D = "/root/testdata/sf0.001"


def test_first_owners(spark):
    r = random.Random(3)
    for seed in range(3):
        batch = [(p, i, i, [f"k{r.randrange(40)}" for _ in range(r.randint(0, 3))]) for p in (1, 2) for i in range(60)]
        stored = [(1, 900, ["k0", "k1"]), (2, 901, ["k2"])]
        got = {(x["profile"], x["paper_id"]): x["kept"] for x in resolve.first_owners(spark.createDataFrame(batch, "profile long, paper_id long, rank int, keys array<string>"), spark.createDataFrame(stored, "profile long, paper_id long, keys array<string>")).collect()}
        owned, want = {(p, k) for p, _, ks in stored for k in ks}, {}
        for p, i, _, ks in sorted(batch, key=lambda x: x[2]):
            want[p, i] = not any((p, k) in owned for k in ks)
            if want[p, i]:
                owned |= {(p, k) for k in ks}
        assert got == want


def test_gather_persist(spark):
    nan = float("nan")
    ranked = [(1, 1, 1, 0.9, "t", ["a"]), (1, 2, 2, 0.8, "t", ["b"]), (1, 3, 3, 0.7, "", ["a"]), (1, 4, 4, nan, "", ["c"]), (1, 5, 5, 0.5, "", ["c"]), (1, 6, 6, 0.4, "", ["z"]), (1, 7, 7, 0.3, "", ["y"])]
    stored = [(1, 7, ["q"]), (1, 8, ["z"])]
    out = resolve.persisted(spark.createDataFrame(ranked, "profile long, paper_id long, rank int, score double, title_key string, keys array<string>"), spark.createDataFrame(stored, "profile long, paper_id long, keys array<string>"), 3)
    assert {r["paper_id"]: (r["outcome"], r["counts"]) for r in out.collect()} == {1: ("new", True), 2: ("same title", True), 3: ("resurfaced", True), 4: ("no score", False), 5: ("resurfaced", False), 6: ("resurfaced", False), 7: ("again", False)}


def test_fuzzy_titles(spark):
    hits = [(1, "Deep learning for cats", 2020, "lee", w, t, y, a, n) for n, (w, t, y, a) in enumerate([(10, "Deep learning for cats!", 2021, "lee"), (11, "deep learning for dogs", 2020, "lee")])]
    hits += [(2, "Another one", 2020, "lee", 12, "another onx", 2025, "lee", 0), (3, "Another one", None, None, 12, "another onx", 2025, "lee", 0), (4, "x", 2020, "lee", 13, "totally different", 2020, "lee", 0), (5, "", 2020, "lee", 13, "", 2020, "lee", 0)]
    out = {r["record"]: (r["work"], round(r["ratio"], 6)) for r in resolve.best_titles(spark.createDataFrame(hits, "record long, title string, year int, author string, work long, w_title string, w_year int, w_author string, place int")).collect()}
    assert out == {1: (10, 1.0), 3: (12, round(SequenceMatcher(None, "another one", "another onx").ratio(), 6))}


def test_concept_votes(spark):
    r = random.Random(5)
    rows = [(p % 2, p, r.randrange(8), r.randrange(12), f"N{r.randrange(10)}", round(r.random(), 2), round(r.random(), 2), r.randrange(3)) for p in range(12) for _ in range(15)]
    have = [(0, 3), (1, 4)]
    got = {(x["profile"], x["topic_id"]): (x["votes"], x["similarity"], x["place"]) for x in topiclists.voted(spark.createDataFrame(rows, "profile long, paper_id long, concept long, topic_id long, name string, similarity double, confidence double, rank int"), spark.createDataFrame(have, "profile long, topic_id long")).collect()}
    votes = {}
    for p in range(12):
        used, n = set(), 0
        for x in sorted((x for x in rows if x[1] == p and (x[0], x[3]) not in have), key=lambda x: (-x[5], -x[6], x[7], x[4], x[3])):
            marks = {("c", x[2]), ("t", x[3]), ("n", x[4].lower())}
            if n < topiclists.OF_A_SEED and not marks & used:
                used |= marks
                n += 1
                votes.setdefault((x[0], x[3]), []).append(x[5])
    assert {k: (v[0], v[1]) for k, v in got.items()} == {k: (len(v), max(v)) for k, v in votes.items()}
    for q in (0, 1):
        order = sorted((k for k in votes if k[0] == q), key=lambda k: (-len(votes[k]), -max(votes[k]), k[1]))
        assert [got[k][2] for k in order] == list(range(1, len(order) + 1))


def test_placeholder_vectors(spark):
    out = catalog.queries()["f44_placeholder_vectors"](spark, D).limit(5).collect()
    titles = {r["doc_id"]: (r["text"] or "").split("\n")[0] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert all(r["v"] == works.unit_normal(titles[r["paper_id"]]) and np.isclose(np.linalg.norm(r["v"]), 1) for r in out)
    assert len({tuple(r["v"]) for r in out}) > 1


def test_placeholder_vectors_in_one_buffer():
    texts = ["a", None, "", "Ünder"] * 50
    got = works.unit_normals(pa.array(texts))
    assert got.to_pylist() == [works.unit_normal(t) for t in texts] and got.nbytes < 200 * 128 * 8 + 2000
    assert len(works.unit_normals(pa.array([], pa.string()))) == 0


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Title,DOI,Year\n"Known, by doi",https://doi.org/10.1/A,\nKnown title,,2020\nKnown title,,1999\nKnown title,,\n,10.9/zz,x\n')
    known = [(1, "10.1/a", "Known by DOI", 2001, "abs"), (2, None, "Known title!", 2020, ""), (3, "10.3/c", "Other", 2002, None)]
    w = spark.createDataFrame(known, "work long, doi string, title string, year int, abstract string")
    out = sorted(map(tuple, manifest.from_manifest(manifest.read_manifest(spark, str(tmp_path / "m.csv")), w).collect()))
    assert [x[1:] for x in out] == [(1, "10.1/a", "Known by DOI", 2001, "abs", None, "openalex"), (2, None, "Known title!", 2020, "", None, "openalex"), (None, None, "Known title", 1999, "", None, "user_csv"), (2, None, "Known title!", 2020, "", None, "openalex"), (None, "10.9/zz", "", None, "", None, "user_csv")]


def test_documents(spark, tmp_path):
    p = spark.createDataFrame([("a", "A", 0.5, ["W1"], [("T1", "t", 3, False)], "m")], documents.PROFILE)
    documents.write_profiles(p, f"{tmp_path}/p")
    assert documents.read_profiles(spark, f"{tmp_path}/p").collect() == p.collect()
    (tmp_path / "t.json").write_text(json.dumps({"results": [{"id": "T1", "display_name": "x", "keywords": [{"display_name": "k", "score": 0.5}]}, {"id": "T2"}]}))
    assert [r["id"] for r in documents.read_topics(spark, f"{tmp_path}/t.json").collect()] == ["T1", "T2"]
    index = spark.createDataFrame([(1, "a", [0.1, 0.2]), (2, "b", [0.3, 0.4])], "topic_id long, name string, v array<double>")
    documents.write_index(index, f"{tmp_path}/i", "m1")
    documents.write_index(index.where("topic_id = 1"), f"{tmp_path}/i", "m1")
    assert documents.read_index(spark, f"{tmp_path}/i", "m1").count() == 1
    with pytest.raises(ValueError):
        documents.read_index(spark, f"{tmp_path}/i", "m2")
    (tmp_path / "log.jsonl").write_text("\n".join(["", *(json.dumps({"n": i}) for i in range(50)), "", ""]))
    assert [json.loads(x)["n"] for x in documents.tail(spark, f"{tmp_path}/log.jsonl", 3)] == [47, 48, 49]
    body = json.dumps({"works": {"group": [{"external-ids": {"external-id": [{"external-id-type": "DOI", "external-id-value": "https://doi.org/10.1/X"}, {"external-id-type": "eid", "external-id-value": "2"}]}, "work-summary": [{"title": {"title": {"value": "A title that is certainly long enough here"}}}]}]}})
    rec = spark.createDataFrame([(1, body), (2, "{broken"), (3, "{}"), (4, None)], "person long, body string")
    got = {r["person"]: (r["state"], r["dois"], len(r["title_keys"])) for r in documents.claimed_works(rec).collect()}
    assert got == {1: ("found", ["10.1/x"], 1), 2: ("unknown", [], 0), 3: ("empty", [], 0), 4: ("unknown", [], 0)}
    assert documents.relevant_types(spark.createDataFrame([("T062",), ("T047",)], "tui string")).count() == 1
    documents.export_rankings(spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.7)], "profile long, paper_id long, score double"), f"{tmp_path}/x")
    assert spark.read.csv(f"{tmp_path}/x/summary", header=True).first()["best"] == "0.7" and spark.read.json(f"{tmp_path}/x/candidates").count() == 2


def test_plugins(spark):
    r = np.random.default_rng(1)
    rows = [(i % 2, i, i // 4, r.normal(size=5).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "profile long, chunk_id long, paper_id long, v array<double>")
    seeds, cand = df.where("chunk_id < 16"), df.where("chunk_id >= 16")
    assert set(plugins.SELECTORS) == {"centroid", "max_seed", "full_text"} and set(plugins.RERANKERS) == {"noop", "blend"}
    for name, cls in plugins.SELECTORS.items():
        key = [] if name == "full_text" else ["chunk_id"]
        as_papers = lambda x: x if not key else x.select("profile", F.col("chunk_id").alias("paper_id"), "v")  # noqa: B023, E731
        s = cls.from_config(cls(0.1).fit(as_papers(seeds)).config())
        with pytest.raises(ValueError):
            s.select(as_papers(cand))
        s.fit(as_papers(seeds))
        every, passing = s.select(as_papers(cand), plugins.KEEP_ALL), s.select(as_papers(cand))
        assert 0 < passing.count() == every.where("score_raw >= 0.1").count()
        assert every.where("score between 0 and 1").count() == every.count() and s.diagnostics()["status"] == "ok"
    ranked = plugins.SELECTORS["centroid"]().fit(seeds).select(cand.select("profile", F.col("chunk_id").alias("paper_id"), "v")).withColumn("batch", F.lit(0))
    logits = ranked.select("profile", "paper_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("query_no")).withColumn("logit", F.rand(1))
    assert plugins.only_reordered(ranked, plugins.RERANKERS["noop"]().rerank(ranked))
    blended = plugins.RERANKERS["blend"]().rerank(ranked, logits)
    assert plugins.only_reordered(ranked, blended) and not plugins.only_reordered(ranked, blended.limit(3))
    assert plugins.embed(spark.createDataFrame([("x",)], "t string"), "t", "placeholder").first()["v"] == works.unit_normal("x")
    got = plugins.GATHERERS["most_cited"](spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 1)], "topic string, paper_id long, cited int"), spark.createDataFrame([(1, "a")], "profile long, topic string"), 1)
    assert [(x["profile"], x["paper_id"]) for x in got.collect()] == [(1, 2)]


def test_incremental_gather(spark, tmp_path):
    r = np.random.default_rng(2)
    schema = "profile long, paper_id long, title_key string, keys array<string>, v array<double>"
    seeds = spark.createDataFrame([(0, 1000 + i, r.normal(size=4).tolist()) for i in range(3)], "profile long, paper_id long, v array<double>")
    rows = [(0, i, "", [f"k{i % 7}"] if i % 2 else [], r.normal(size=4).tolist()) for i in range(20)]
    run = lambda: gather.gather(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), seeds, f"{tmp_path}/state", f"{tmp_path}/c").awaitTermination()
    spark.createDataFrame(rows[:12], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame(rows[8:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = spark.read.parquet(f"{tmp_path}/state").collect()
    ids, keys = [x["paper_id"] for x in got], [k for x in got for k in x["keys"]]
    assert len(ids) == len(set(ids)) and len(keys) == len(set(keys)) and {i for i in range(0, 20, 2)} <= set(ids)
    assert {k for x in rows for k in x[3]} == set(keys) and {x["batch"] for x in got} == {0, 1}
