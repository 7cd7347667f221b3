"""Keyed state over streams: owners and runs through restarts, against plain Python."""

import datetime as dt
import random

import pytest

from paperloom.streaming import keyed

FOUND = "profile string, paper_id long, score double, keys array<string>"
EVENTS = "run long, kind string, ts timestamp, error string"


def by_hand(batches):
    owner, seen, out = {}, set(), {}
    for n, rows in enumerate(batches):
        order = sorted(rows, key=lambda r: (r[2] is None or r[2] != r[2], -(r[2] or 0.0) if r[2] == r[2] else 0.0, r[1]))
        for p, i, _, keys in order:
            for k in [*filter(None, keys or []), f"#{i}"]:
                owner.setdefault((p, k), i)
        for p, i in {(r[0], r[1]) for r in rows}:
            keys = {k for r in rows if r[:2] == (p, i) for k in [*filter(None, r[3] or []), f"#{i}"]}
            others = [owner[p, k] for k in keys if owner[p, k] != i]
            out[n, p, i] = ("resurfaced", min(others)) if others else ("again" if (p, i) in seen else "new", i)
        seen |= {(r[0], r[1]) for r in rows}
    return out


def test_first_owners(spark, tmp_path):
    r = random.Random(5)
    batches = [[(r.choice("pq"), r.randrange(40), r.choice([None, 0.5, 0.25, float("nan")]), r.choice([None, [], [None, ""], [f"k{r.randrange(25)}"], [f"k{r.randrange(25)}", f"k{r.randrange(25)}"]])) for _ in range(15)] for _ in range(3)]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, FOUND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # each run is a restart from the checkpoint
        keyed.keep_first(spark.readStream.schema(FOUND).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {(x["batch"], x["profile"], x["paper_id"]): (x["outcome"], x["owner"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == by_hand(batches)


def test_owners_do_not_read_what_is_stored(spark, tmp_path):
    stream = lambda: spark.readStream.schema(FOUND).parquet(f"{tmp_path}/in")
    for n in (400, 3):
        spark.createDataFrame([("p", i, 0.0, [f"k{i}"]) for i in range(n)], FOUND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = keyed.keep_first(stream(), f"{tmp_path}/out", f"{tmp_path}/c")
        q.awaitTermination()
    assert [p.numInputRows for p in q.recentProgress if p.numInputRows] == [3]
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("outcome").count().orderBy("outcome").collect() == [("again", 3), ("new", 400)]


def test_runs(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    steps = [
        [(1, "start", at(0), None), (2, "start", at(0), None), (3, "start", at(1), None), (None, "start", at(0), None)],
        [(1, "end", at(5), None), (3, "tick", at(8), None), (4, "end", at(9), "failed")],
        [(5, "start", at(14), None), (3, "tick", at(14), None)],  # 2 has been silent for over ten minutes
        [(2, "end", at(13.5), None), (6, "start", at(40), None)],  # too late for 2; 3 and 5 fall silent
        [(6, "tick", at(49), None), (7, "start", at(58), None)],  # 6 lives on
    ]
    for rows in steps:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keyed.keep_runs(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {r["run"]: (r["started"], r["finished"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/out").selectExpr("run", "unix_seconds(started) AS started", "unix_seconds(finished) AS finished", "error").collect()}
    s = lambda m: int(at(m).timestamp())
    assert got == {
        1: (s(0), s(5), None),
        4: (None, s(9), "failed"),
        2: (s(0), s(10), keyed.INTERRUPTED),
        3: (s(1), s(24), keyed.INTERRUPTED),
        5: (s(14), s(24), keyed.INTERRUPTED),
    }


def test_patience_is_an_interval(spark, tmp_path):
    with pytest.raises(Exception, match="INTERVAL|PARSE|interval"):
        keyed.closed_runs(spark.readStream.schema(EVENTS).parquet(str(tmp_path)), "soon")
