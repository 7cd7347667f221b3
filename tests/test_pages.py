"""The paged source against a small service of this process."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from paperloom.operators import topiclists
from paperloom.sources import pages

COLUMNS = "id long, year long, title string"


@pytest.fixture
def service(spark):
    state = {"works": [{"id": i, "year": 2000 + i % 7, "title": None if i % 10 == 0 else f"t{i}"} for i in range(95)], "count": True, "asked": []}

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            state["asked"].append(asked)
            works = state["works"]
            for c in asked.get("filter", "").split(","):
                if c:
                    k, v = c.split(":")
                    n = int(v.lstrip("<>="))
                    works = [w for w in works if (w[k] >= n if v[0] == ">" else w[k] <= n if v[0] == "<" else w[k] == n)]
            if asked.get("sort"):
                works = sorted(works, key=lambda w: w["id"], reverse=asked["sort"].endswith("desc"))
            size, page = int(asked["per-page"]), int(asked["page"])
            body = json.dumps({"meta": {"count": len(works)} if state["count"] else {}, "results": works[(page - 1) * size : page * size]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pages.register(spark)
    yield state, lambda **o: {"url": f"http://127.0.0.1:{server.server_port}/works", "columns": COLUMNS, "perpage": 10} | o
    server.shutdown()


def test_pages_as_partitions(spark, service):
    state, options = service
    df = spark.read.format("pages").options(**options()).load()
    assert df.rdd.getNumPartitions() == 10
    assert sorted((r["id"], r["year"], r["title"]) for r in df.collect()) == [(w["id"], w["year"], w["title"]) for w in state["works"]]


@pytest.mark.parametrize("extra,counted,want", [({"limit": 25}, True, 25), ({"limit": 25}, False, 25), ({}, False, 95), ({"most": 40}, True, 40), ({"most": 45}, False, 40), ({"limit": 0}, True, 0), ({"perpage": 95}, True, 95), ({"perpage": 200}, False, 95)])
def test_where_pages_end(spark, service, extra, counted, want):
    state, options = service
    state["count"] = counted
    ids = [r["id"] for r in spark.read.format("pages").options(**options(sort="id:asc", **extra)).load().collect()]
    assert sorted(ids) == list(range(want))
    assert max(int(a["page"]) for a in state["asked"]) <= 11


def test_conditions_are_sent_along(spark, service):
    state, options = service
    df = spark.read.format("pages").options(**options(filters="year")).load().where("year = 2003 and id >= 50")
    assert sorted(r["id"] for r in df.collect()) == [i for i in range(50, 95) if i % 7 == 3]
    assert all(a.get("filter") == "year:2003" for a in state["asked"][-2:])
    df = spark.read.format("pages").options(**options(filters="year", sort="id:desc", limit=12)).load().where("year >= 2005")
    assert sorted(r["id"] for r in df.collect()) == sorted([i for i in range(95) if i % 7 >= 5][-12:])


def test_stream_reads_on(spark, service, tmp_path):
    state, options = service

    def run():
        q = spark.readStream.format("pages").options(**options(sort="id:asc")).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(COLUMNS).parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(95))
    state["works"] += [{"id": i, "year": 1, "title": "new"} for i in range(95, 112)]
    assert run() == list(range(112))


def test_adopt_and_strip(spark):
    stored = spark.createDataFrame([("p", 1, "seeds", True), ("p", 2, "researcher", False), ("p", 3, "seeds", False), ("p", 4, None, True), ("p", 5, "seeds", True)], "profile string, topic int, source string, is_on boolean")
    proposed = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("p", 3, False), ("p", 4, False), ("p", 6, True), ("p", 7, False), ("p", 8, False), ("p", 9, True), ("p", 9, False)], "profile string, topic int, wanted boolean")
    choices = spark.createDataFrame([("p", 4, "add"), ("p", 5, "filter"), ("p", 8, "add"), ("p", 7, "what")], "profile string, topic int, choice string")
    out = topiclists.adopted(stored, proposed, choices)
    got = {r["topic"]: (r["source"], r["is_on"], r["mark"], r["choice"], r["before"]) for r in out.collect()}
    assert got == {
        1: ("seeds", True, "interest", None, True),
        2: ("researcher", False, "not_interest", "filter", True),
        3: ("seeds", False, None, "keep", True),
        4: (None, True, "interest", "add", True),
        5: ("seeds", True, None, None, True),
        6: ("researcher", True, "interest", None, False),
        8: ("researcher", True, "interest", "add", False),
        9: ("researcher", True, "interest", "keep", False),
    }
    assert topiclists.stripped(out).exceptAll(stored).count() == 0 and topiclists.stripped(out).count() == 4
    own = topiclists.kept_as_own(out)
    assert own.where(F.col("source") == "adopted").count() == 4 and own.count() == 8
