"""Every query with SQL against DuckDB on the same tables; the rest against plain Python."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import pool, predicates, selection, state, topics
from paperloom.plans import catalog
from paperloom.streaming import feedback

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if "datetime" in str(df[k].dtype):
            df[k] = df[k].astype("datetime64[us]").astype(str)
        elif df[k].dtype == object or str(df[k].dtype).startswith("str"):
            df[k] = df[k].map(lambda x: "~" if x is None or x != x else str(x))
        else:
            df[k] = df[k].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_as_sql(spark, duck, name):
    a, b = plain(catalog.queries()[name](spark, D).toPandas()), plain(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for k in a:
        assert a[k].equals(b[k]), (k, a[a[k] != b[k]].head(), b[a[k] != b[k]].head())


@pytest.mark.parametrize("sizes,limit", [([5, 0, 9, 2], 8), ([1, 1], 10), ([100, 3, 50], 60), ([7], 3), ([4, 4, 4], 2), ([0], 5)])
def test_fair_shares(spark, sizes, limit):
    got = {r["profile"]: r["share"] for r in pool.fair_shares(spark.createDataFrame(list(enumerate(sizes)), "profile int, n long"), limit).collect()}
    assert sum(got.values()) == min(limit, sum(sizes))
    assert all(s <= sizes[p] for p, s in got.items())
    least = min([s for p, s in got.items() if s < sizes[p]], default=None)
    assert least is None or max(got.values()) <= least + 1


def test_round_robin(spark):
    rows = [("p", t, r, t * 10 + r, "") for t in range(1, 4) for r in range(1, 6)] + [("p", 1, 6, 21, ""), ("p", 2, 7, 99, "same"), ("p", 3, 7, 98, "same")]
    out = topics.round_robin(spark.createDataFrame(rows, "profile string, topic_pos int, rank int, paper_id long, title_key string"), 30).collect()
    assert [r["paper_id"] for r in sorted(out, key=lambda r: r["position"])][:4] == [11, 21, 31, 12]
    assert len({r["paper_id"] for r in out}) == len(out) and sum(r["title_key"] == "same" for r in out) == 1


def test_predicates(spark):
    grid = [(s, t, m, p) for s in (None, 0.1, 0.5, 0.9) for t in (None, 0.5) for m in (None, 0.9) for p in (None, 0.5, 0.7, 0.95)]
    df = spark.createDataFrame(grid, "s double, t double, m double, p double")
    for r in df.select("*", predicates.bucket(F.col("s"), F.col("t"), F.col("m"), F.col("p")).alias("b"), predicates.passes(F.col("s"), F.col("t")).alias("ok")).collect():
        if r.s is not None and r.t is not None:
            want = "low" if r.s < r.t else "high" if r.m is not None and r.s >= r.m else "medium"
        else:
            want = "low" if r.p is None else "high" if r.p >= 0.9 else "medium" if r.p >= 0.67 else "low"
        assert r.b == want and r.ok == (r.s is None or r.t is None or r.s >= r.t)
    on = spark.createDataFrame([(None, True), ("null", False), ("false", False), ("0", False), ('""', False), ("[]", False), ("{}", False), ("true", True), ("1", True), ('"x"', True), ("[0]", True)], "j string, want boolean")
    assert on.where(predicates.json_on(F.col("j")) != F.col("want")).count() == 0
    tp = spark.createDataFrame([(None, ["a"], ["b"], True, True), ("a", [], ["a"], True, True), ("a", ["c"], ["b"], True, False), ("a", ["b"], ["b"], True, True), ("a", [], [], False, True)], "s string, own array<string>, o array<string>, l boolean, want boolean")
    assert tp.where(predicates.topic_on(F.col("s"), F.col("own"), F.col("o"), F.col("l")) != F.col("want")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/ABC.", "Smith, John", "0000-0002-1825-0097", {"b": [1], "a": [0, 2]}), ("x", "Ann Lee", "0000-0002-1825-0098", {})], "d string, a string, o string, i map<string,array<int>>")
    r = df.select(T.doi_key(F.col("d")), T.surname(F.col("a")), T.orcid_ok(F.col("o")), T.inverted_text(F.col("i"))).collect()
    assert [tuple(x) for x in r] == [("10.1/abc", "smith", True, "a b a"), (None, "lee", False, "")]


def test_unnormalised_vectors(spark):
    df = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 0, [6.0, 8.0]), (3, 0, [0.0, 0.0])], "paper_id int, profile int, v array<double>")
    c = df.crossJoin(df.where("paper_id = 1").select(F.col("v").alias("w"))).select(F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("c")).collect()
    assert [r["c"] for r in c] == [1.0, 1.0, 0.0]
    assert [round(x, 6) for x in selection.centroids(df).first()["centroid"]] == [3.0, 4.0]


def test_flat_pool_and_missing_logits(spark):
    df = spark.createDataFrame([("a", i, 0.5, None) for i in range(3)] + [("b", 1, 0.2, 1.0), ("b", 2, 0.4, None), ("b", 3, 0.3, 3.0), ("c", 1, 0.1, None)], "profile string, paper_id int, score_raw double, logit double")
    out = {(r["profile"], r["paper_id"]): r for r in pool.rescored(df).collect()}
    assert out["a", 0]["sel_norm"] == 0 and out["a", 0]["blended"] is None and out["c", 1]["pct"] == 1.0
    assert out["b", 2]["rr_norm"] is None and out["b", 2]["blended"] == pytest.approx(0.4 + 0.6 * 0.5)
    assert {out["b", i]["pct"] for i in (1, 2, 3)} == {0.0, 0.5, 1.0}


def test_all_copies_under_original(spark):
    out = catalog.queries()["w07_copies_under_original"](spark, D).collect()
    assert {r["paper_id"] for r in out} == {r["doc_id"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert [(r["f"], r["position"]) for r in out] == sorted((r["f"], r["position"]) for r in out) and out[-1]["f"] >= 50


def test_redaction(spark):
    rows = [("GET https://a.b/c?mailto=x@y.org&k=1 failed for me.too@z.co.uk",), (None,), ("x" * 501,), ("x" * 500,), ('"https://a.b/?q" <https://c.d/e?f>',)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(T.redact(F.col("c"))).collect()]
    assert got == ["GET https://a.b/c failed for <email>", "", "x" * 499 + "\u2026", "x" * 500, '"https://a.b/" <https://c.d/e>']


def test_paper_keys(spark):
    rows = [("https://doi.org/10.5281/Zenodo.7", "The Trust Dial", 2020, ["Clark, Tim", "Ann B. Lee", ""]), ("10.5281/zenodo.8", "The trust dial!", 2020, ["Tim Clark", "Lee, Ann", "x y"]), (None, "A title that is long enough for a key of its own", None, None), ("10.1/x", "Editorial", 2020, ["A B"])]
    got = [r[0] for r in spark.createDataFrame(rows, "d string, t string, y int, a array<string>").select(T.paper_keys(*map(F.col, "dtya"))).collect()]
    assert got[0] == ["doi:10.5281/zenodo.7", "zenodo:thetrustdial|2020|clark,lee|3"] and got[1][1] == "zenodo:thetrustdial|2020|clark,lee,y|3"
    assert got[2] == ["title:atitlethatislongenoughforakeyofitsown"] and got[3] == ["doi:10.1/x"]


def test_thresholds_without_band_or_scores(spark):
    band = spark.createDataFrame([(1, 0.9), (2, 0.5)], "profile int, seed_min double")
    scores = spark.createDataFrame([(1, i / 100) for i in range(100)] + [(3, i / 100) for i in range(100)] + [(4, 0.1)], "profile int, score double")
    got = {r["profile"]: r["threshold"] for r in selection.suggested_threshold(spark.range(1, 6).select(F.col("id").cast("int").alias("profile")), scores, band).collect()}
    assert got == {1: 0.89, 2: 0.49, 3: 0.891, 4: 0.9, 5: 0.9}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", i % 3, i % 5, ["saved", "dismissed", "unsaved", "shown", "odd"][i * 7 % 5]) for i in range(120)]
    ev = spark.createDataFrame(rows, "event_id long, t string, profile int, paper_id int, action string").select("event_id", F.to_timestamp("t").alias("ts"), "profile", "paper_id", "action")
    ev.repartition(4).write.parquet(f"{tmp_path}/in")
    read = lambda: feedback.feedback_stream(spark, f"{tmp_path}/in", ev.schema)
    feedback.append_log(read(), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == ev.where(F.col("action").isin(*feedback.ACTIONS)).count()
    feedback.keep_triage(read(), f"{tmp_path}/state", f"{tmp_path}/c2").awaitTermination()
    want = state.triage(ev)
    got = state.shown(spark.read.parquet(feedback.latest(f"{tmp_path}/state")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    # later events are merged into the last snapshot
    later = ev.where("event_id % 4 = 0").withColumn("event_id", F.col("event_id") + 1000).withColumn("ts", F.col("ts") + F.expr("interval 3 days"))
    later.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    feedback.keep_triage(read(), f"{tmp_path}/state", f"{tmp_path}/c2").awaitTermination()
    want = state.triage(ev.unionByName(later))
    got = state.shown(spark.read.parquet(feedback.latest(f"{tmp_path}/state")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert feedback.latest(f"{tmp_path}/state").endswith("batch=1")
    q = feedback.windowed_counts(read()).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 150
