"""Sentences, contexts of mentions and the choice among them against plain Python."""

import random
import re

from pyspark.sql import functions as F

from paperloom.operators import predicates
from paperloom.operators import sentences as S
from paperloom.plans import mentions as plans  # noqa: F401


def plain_spans(text):
    """Cut after stops that white space follows, and after lines."""
    cuts, i = [0], 0
    while i < len(text):
        j = i
        if text[i] in ".!?":
            while j < len(text) and text[j] in ".!?":
                j += 1
            k = j
            while k < len(text) and text[k] in "\"')]":
                k += 1
            e = k
            while e < len(text) and text[e] in " \t\r\n":
                e += 1
            if e > k:
                cuts.append(e)
                i = e
                continue
            i = j
            continue
        if text[i] == "\n":
            while j < len(text) and text[j] in " \t\r\n":
                j += 1
            cuts.append(j)
            i = j
            continue
        i += 1
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        inside = [i for i in range(a, b) if text[i] not in " \t\r\n"]
        if inside:
            out.append((inside[0], inside[-1] + 1))
    return out


def test_spans():
    rng = random.Random(3)
    texts = ["", " \n ", "One. Two", "e.g. a (b.) c", 'Wait... "no!" Yes?', "a\n\n b\r\nc", "...", "!?" * 5, "x" * 2000]
    texts += ["".join(rng.choice("ab .!?\n\t\"')é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert list(S.spans(t)) == plain_spans(t), repr(t)


def test_long_runs_are_cut_in_linear_time():
    for t in ("." * 2_000_000, " " * 2_000_000, "a. " * 700_000, ".'" * 1_000_000, "\n" * 2_000_000):
        assert len(list(S.spans(t))) in (0, 1, 700_000)


def test_table_functions_in_sql(spark):
    S.register(spark)
    spark.createDataFrame([(1, "One two. Three\nfour"), (2, None), (3, ""), (4, " \n")], "i int, t string").createOrReplaceTempView("st")
    got = spark.sql("SELECT i, n, substr(t, start + 1, end - start) FROM st, LATERAL sentences(t)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "One two."), (1, 1, "Three"), (1, 2, "four")]
    got = spark.sql("SELECT i, start, word FROM st, LATERAL matches(t, '[a-z]{3,}')").collect()
    assert sorted(map(tuple, got)) == [(1, 4, "two"), (1, 10, "hree"), (1, 15, "four")]


def expected(texts, mentions, least, top, each):
    """Row by row, as one would do it for a single paper."""
    out = set()
    for paper, text in texts.items():
        mine = sorted({m for m in mentions if m[0] == paper and m[2] >= least}, key=lambda m: m[3])
        surest, first = {}, {}
        for _, c, conf, start, *_ in mine:
            surest[c] = max(conf, surest.get(c, conf))
            first.setdefault(c, start)
        for c in sorted(surest, key=lambda c: (-surest[c], first[c], c))[:top]:
            found = plain_spans(text or "")
            chosen = []
            for _, _, conf, start, word, defined in sorted((m for m in mine if m[1] == c), key=lambda m: (-m[2], m[3])):
                if not found:
                    continue
                i = max([k for k, (a, _) in enumerate(found) if a <= start], default=0)
                a, b = found[i]
                if b - a < 120 and i + 1 < len(found):
                    b = found[i + 1][1]
                s = text[a:b]
                if len(s) > 1000:
                    at = max(0, min(start - a + len(word) // 2 - 500, len(s) - 1000))
                    s = s[at : at + 1000]
                tokens = s.split()
                good = sum(bool(re.match(r"[A-Za-z][a-z]{2,}[.,;:)]?$", t)) for t in tokens) / len(tokens)
                if good < 0.5 or (len(re.sub("[^A-Za-z0-9]", "", word)) <= 3 and not defined):
                    continue
                if s not in [x for _, _, x in chosen] and len(chosen) < each:
                    chosen.append((conf, word, s))
            out |= {(paper, c, surest[c], *m, n) for n, m in enumerate(chosen, 1)} or {(paper, c, surest[c], None, None, None, None)}
    return out


def test_surest_mentions(spark):
    rng = random.Random(5)
    words = ["heart", "failure", "gene", "MRI", "cells,", "of", "=", "3.5", "longer", "sentence.", "Short.", "again.\n"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 400]))) for i in range(12)}
    texts |= {20: None, 21: "", 22: "gene and cells without any stop " * 200, 23: "gene here and there again and again, as is known to all of those who read this text in full and more. " * 3}
    mentions = [(i, m[0].lower(), float(rng.randrange(5)) / 4, m.start(), m[0], m[0] == "MRI" and i % 2 == 0) for i, t in texts.items() for m in re.finditer("heart|failure|gene|MRI|cells|longer", t or "")]
    mentions += [(20, "gone", 1.0, 0, "gone", False), (99, "nowhere", 1.0, 0, "nowhere", False)]
    a = spark.createDataFrame(list(texts.items()), "paper_id long, text string")
    b = spark.createDataFrame(mentions + mentions[:50], "paper_id long, concept string, confidence double, start int, word string, defined boolean")
    got = {tuple(r) for r in S.surest_mentions(a, b, 0.5, 4, 3).select("paper_id", "concept", "surest", "confidence", "word", "sentence", "place").collect()}
    want = expected(texts, mentions, 0.5, 4, 3) | {(99, "nowhere", 1.0, None, None, None, None)}
    assert got == want
    assert S.surest_mentions(a, b.limit(0), 0.5).count() == 0 and S.contexts(a.limit(0), b).count() == 0
    assert all(len(r[5]) <= 1000 for r in got if r[5]) and any(len(r[5]) == 1000 for r in got if r[5])


def test_whole_contexts_hold_their_mention(spark):
    t = spark.createDataFrame([(1, "é" * 30 + " word. " + "many words follow here " * 100 + "needle " + "and so on " * 200)], "paper_id long, text string")
    at = t.first()["text"].index("needle")
    m = spark.createDataFrame([(1, "n", 1.0, at, "needle", False)], "paper_id long, concept string, confidence double, start int, word string, defined boolean")
    s = S.contexts(t, m).select(F.col("sentence")).first()[0]
    assert "needle" in s and len(s) == 1000 and abs(s.index("needle") + 3 - 500) <= 1


def test_only_counting_contexts_leave(spark):
    """Of a concept named in every sentence, only the sentences that count are carried on; usable() is the predicate."""
    t = spark.createDataFrame([(1, "The gene was seen again by all of them. " * 5 + "".join(f"The gene of kind {'abcdefghij'[i % 10] * 5} was then seen by {'klmnopqrst'[i // 10] * 5} and others, as is known to those who read this text to the end of it. " for i in range(100)))], "paper_id long, text string")
    ms = [(1, "gene", 0.9, m.start(), "gene", False) for m in re.finditer("gene", t.first()["text"])]
    m = spark.createDataFrame(ms, "paper_id long, concept string, confidence double, start int, word string, defined boolean")
    assert S.contexts(t, m).count() == len(ms) and S.contexts(t, m, 3).count() == 3
    rng = random.Random(2)
    rows = [(rng.choice(["MRI", "gene", "a-b", "wörd"]), "".join(rng.choice(["abc", "Abc.", "x", "3", "é", " ", "\t", "\x0b", "\x85", "\u2028", "\xa0", "\n"]) for _ in range(rng.randrange(12))), rng.random() < 0.5) for _ in range(2000)]
    got = spark.createDataFrame(rows, "w string, s string, d boolean").select("w", "s", "d", predicates.usable_mention(F.col("w"), F.col("s"), F.col("d")).alias("ok")).collect()
    assert [(r["w"], r["s"], r["d"]) for r in got if r["ok"] != S.usable(r["w"], r["s"], r["d"])] == []
