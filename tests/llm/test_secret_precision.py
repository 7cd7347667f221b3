"""Precision of the secret network on the tables: words of documents it has not seen, and recall on made findings."""

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import pii, secrets
from paperloom.llm.store import saved


def looked(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text")
    return docs, saved(docs.mapInArrow(secrets._look, f"doc_id long, found {secrets.FOUND}"), "found")


def test_words_of_unseen_documents(spark):
    """Trained on one table, the network adds fewer than five plain words in 1,000 documents of another."""
    net = secrets.trained(looked(spark, "sf0.01")[1])
    docs, found = looked(spark, "sf0.1")
    words = secrets.plain_words(found, 1 << 20).collect()
    seen = {r["token"] for r in secrets.plain_words(looked(spark, "sf0.01")[1], 1 << 20).collect()}
    new = [tuple(r) for r in words if r["token"] not in seen]
    added = (net.score(new) >= net.threshold).sum()
    assert len(new) > 500 and added < 5 * docs.count() / 1000, added
    made = secrets.made_findings(1500, seed=99)
    score, label = net.score([m[:3] for m in made]), np.array([m[3] for m in made])
    assert (score[label == 1] >= net.threshold).mean() > 0.9
    assert (score[label == 0] >= net.threshold).mean() < 0.1


def test_added_spans_of_a_table(spark):
    docs = looked(spark, "sf0.1")[0]
    added = secrets.secret_spans(docs).select("doc_id", F.explode(F.filter("spans", lambda s: s["kind"] == "model")).alias("s")).join(docs, "doc_id")
    plain = added.where(F.expr("substring(text, s.start + 1, s.end - s.start)").rlike("^(?:[A-Z]?[a-z]+|[A-Z]+)$")).count()
    assert plain < 5 * docs.count() / 1000


def test_scores_of_personal_data(spark):
    docs = spark.createDataFrame([(1, "card 4111 1111 1111 1111, mail a@b.org and 10.0.0.1"), (2, "4111 1111 1111 1111"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"].split(","), r["scores"].split(",")) for r in pii.report(docs).collect()}
    assert got[3] == ([""], [""]) and [len(x) for x in got[1]] == [3, 3]
    # the word beside it raises the score of a card
    assert float(got[1][1][0]) > float(got[2][1][0])


def test_all_findings_train(spark):
    """No document, finding of a document or word is left out of the fit, and how rows lie in partitions changes nothing."""
    text = " ".join(f"token={i:04d}abcdefgh{i:04d}" for i in range(20))
    docs = spark.createDataFrame([(i, text.replace("abc", f"q{i}z") + " Unquestionable" + "abcdefghij"[i % 10] * 9) for i in range(450)], "doc_id long, text string")
    found = saved(docs.mapInArrow(secrets._look, f"doc_id long, found {secrets.FOUND}"), "found")
    every = secrets.labelled_findings(found).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in every} == {"assign": 450 * 20, "word": 10}
    before, secrets.ROUNDS = secrets.ROUNDS, 2
    try:
        one, two = (secrets.trained(x) for x in (found, found.unionByName(found).repartition(5)))
    finally:
        secrets.ROUNDS = before
    assert one.threshold == two.threshold and (one.state() == two.state()).all()
    assert one.t == 2 * (one.t // 2) and one.t < 2 * 200  # shards, not one pass over all
