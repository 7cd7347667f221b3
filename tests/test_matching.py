"""Rules on titles and names against cases by hand and plain Python."""

import random
import re

from pyspark.sql import functions as F

from paperloom.operators import matching as M


def test_names(spark):
    text = "A study of things\nKathleenC.Frasera, Guillaume Le Moing2, J. K. Rowlingb, Müller-Lüdenscheidt Óscar; DeepThought-AI team\nabstract"
    cases = {
        "Kathleen Fraser": True, "Fraser, Kathleen": True, "Guillaume Moing": True, "Joanne Rowling": True, "Rowling, Jim": True, "K. Rowling": True,
        "Müller-Lüdenscheidt Óscar": True, "Óscar Muller": False, "DeepThought-AI": True, "AI": False, "Nobody Here": False, "Fraser": True, "X": False, "": False,
        "Kathleen F": False, "Study, A": True, ", ": False, "Le Guillaume": False,
    }
    df = spark.createDataFrame(list(cases.items()), "name string, want boolean").withColumn("t", F.lit(text))
    got = df.select("name", "want", M.named(F.col("name"), M.squashed(M.folded(F.col("t"))), M.spaced(F.col("t"))).alias("got")).collect()
    assert {r["name"]: r["got"] for r in got} == cases


def test_names_at_random(spark):
    r = random.Random(8)
    names = ["".join(r.choice("ab") for _ in range(r.randint(1, 4))) + " " + "".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(150)]
    rows = [(n, "".join(r.choice("ab ") for _ in range(14))) for n in names]
    df = spark.createDataFrame(rows, "name string, t string")
    got = df.select("name", "t", M.named(F.col("name"), M.squashed(M.folded(F.col("t"))), M.spaced(F.col("t"))).alias("got")).collect()
    for x in got:
        given, family = x["name"].split()
        head, words = x["t"].replace(" ", ""), re.sub(" +", " ", x["t"]).strip()
        full = any(head[i : i + len(given)] == given and head[j : j + len(family)] == family for i in range(len(head)) for j in range(i + len(given), i + len(given) + 5))
        short = re.search(rf"(?<![a-z]){given[0]}(?: [a-z]){{0,2}} {family}[a-z]?(?![a-z])", words) is not None
        assert x["got"] == (len(family) >= 2 and (full or (len(family) >= 3 and short))), x


def test_titles(spark):
    rows = [
        ("Deep Learning", "x", "deep learning!", True), ("Deep learning: a book", "x", "Deep Learning", True), ("Deep learning", "x", "Deep learning: a book", True),
        ("Other", "On page one: DEEP LEARN-\nING for cats", "Deep learning for cats", True), ("Other", "text\nReferences\nDeep learning for cats", "Deep learning for cats", False),
        ("Other", "x" * 3000 + "Deep learning", "Deep learning", False), ("", "Deep learning", "Deep learning", False), (None, None, None, False), ("Été", None, "ete", True), ("?", "a", "!", False),
    ]
    df = spark.createDataFrame(rows, "title string, front string, w string, want boolean")
    assert [r["got"] for r in df.select(M.title_fits(F.col("title"), F.col("front"), F.col("w")).alias("got")).collect()] == [r[3] for r in rows]


def test_verdicts(spark):
    rows = [(t, a, f, by) for t in (True, False) for a in (True, False) for f in (True, False) for by in ("doi", "title", "doi_in_body")]
    df = spark.createDataFrame(rows, "t boolean, a boolean, f boolean, how string")
    for r in df.select("*", M.verified(F.col("t"), F.col("a"), F.col("f"), F.col("how")).alias("ok")).collect():
        assert r["ok"] == ((r["t"] or r["f"]) if r["how"] == "doi" else (r["t"] and r["a"]))


def test_pairs_fold_nothing(spark):
    """No Python runs above the join of records with works: what a row alone tells is made before."""
    from paperloom.plans import catalog

    plan = catalog.queries()["j12_verified_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "EvalPython" not in plan.split("Join")[0]


def test_pairs_read_no_text(spark):
    """Above the join of records with works nothing is looked for in a text: a pair costs its bits."""
    from paperloom.plans import catalog

    above = catalog.queries()["j12_verified_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "getbit" in above and not re.search("rlike|contains", above, re.I)


def _pairs_at_random(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randint(0, n)))
    name = lambda: r.choice([f"{word(3)} {word(4)}", f"{word(4)}, {word(2)}", word(5), f"{word(1)} {word(3)}", f"{word(3)} {word(14)}", "", "?", None])
    text = lambda: "".join(r.choice("ab  1é\n") for _ in range(r.randint(0, 60))) * r.choice([1, 1, 1, 3]) + r.choice(["", "\nReferences\nabba baab", "x" * 3000 + "ab abba", "y" * 6000 + "ab abba"])
    title = lambda: r.choice([word(6), f"{word(3)}: {word(3)}", "12", "", None, "ab" * r.randint(1, 40), "abbaabba" * 5 + word(4), "123: ab"])
    texts = [text() for _ in range(6)]
    cut = lambda: (x := r.choice(texts))[(i := r.randint(0, 20)) : i + r.randint(0, 90)].replace("\n", " ")
    recs = [(k, i * 10 + k, title(), r.choice([*texts, text(), None, ""])) for i in range(40) for k in range(3)]
    works = [(k, i * 10 + k, r.choice([title(), cut()]), name(), name()) for i in range(50) for k in range(1, 4)]
    return recs, works


def test_pairs_as_one_by_one(spark, monkeypatch):
    """All pairs of a key, over several blocks of both sides, against the rules for one pair."""
    from paperloom.operators import matchpairs as MP

    monkeypatch.setattr(MP, "RECORDS", 15)
    monkeypatch.setattr(MP, "WORKS", 20)
    recs, works = _pairs_at_random(12)
    rec = spark.createDataFrame(recs, "key int, record int, title string, text string")
    wrk = spark.createDataFrame(works, "key int, work int, w string, first string, second string")
    head = F.substring("text", 1, M.HEAD)
    one = rec.join(wrk, "key").select("record", "work", M.title_fits(F.col("title"), F.col("text"), F.col("w")), *(M.named(F.col(c), M.squashed(M.folded(head)), M.spaced(head)) for c in ("first", "second")))
    r = rec.select("key", "record", M.title_keys(F.col("title")).alias("own"), M.folded(head).alias("fold"), F.length(M.page_letters(F.col("text"))).alias("page"))
    w = wrk.select("key", "work", F.lit(1).alias("n"), M.title_keys(F.col("w")).alias("of"), M.name_keys(F.col("first")).alias("first"), M.name_keys(F.col("second")).alias("second"))
    got = MP.paired(r, w).select("record", "work", "title_ok", "first_ok", "second_ok")
    want = sorted(map(tuple, one.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 4000
    assert all(20 < sum(x[i] for x in want) < 3980 for i in (2, 3, 4))


def test_letters_in_pieces(monkeypatch):
    """Where a block's letters are cut makes no difference, nor which names are looked for together."""
    import pandas as pd

    from paperloom.operators import matchpairs as MP

    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randint(1, n)))
    works = pd.DataFrame([{"of_all": word(9), "of_main": word(9)} | {f"{k}_{c}": v for k in "fs" for c, v in (("group", r.random() < 0.2), ("given", word(3)), ("family", word(4)), ("token", word(6)))} for _ in range(130)])
    folds = [" ".join(word(r.choice([1, 5, 9])) for _ in range(r.randint(0, 12))) for _ in range(60)]
    records = pd.DataFrame({"own_all": folds, "own_main": folds, "fold": folds, "page": [len(x.replace(" ", "")) // 2 for x in folds]})
    whole = [x.copy() for x in MP.verdicts(records, works)]
    monkeypatch.setattr(MP, "LETTERS", 40)
    assert all((a == b).all() for a, b in zip(whole, MP.verdicts(records, works)))
    for j in (0, 7, 129):
        assert all((a[:, j] == b[:, 0]).all() for a, b in zip(whole, MP.verdicts(records, works.iloc[j : j + 1])))
    assert [int(b) & (2**64 - 1) for b in MP.bits(whole[0])[0]] == [sum(int(x) << i for i, x in enumerate(whole[0][0][k : k + 64])) for k in (0, 64, 128)]
