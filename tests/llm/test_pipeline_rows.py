"""The rows of the whole pipeline against a plain Python version of all its stages, one document after the other."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers

from paperloom.llm import quality
from tests.llm.test_ops import WORD, distance

D = "/root/testdata/sf0.001"


def counts(text):
    w, lines = WORD.findall(text), [s for s in text.split("\n") if WORD.search(s)]
    seen, cover = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines)}


def good(docs, cuts):
    """docs {id: (text, lang, source)}; cuts {lang: {rule: cutoff}}."""
    out = {}
    for i, (text, lang, source) in docs.items():
        c = counts(text or "")
        n, mean = max(c["n_words"], 1), c["word_chars"] / max(c["n_words"], 1)
        measure = {"symbols": c["n_symbols"] / n, "repeated_lines": c["n_dup_lines"] / max(c["n_lines"], 1), "repeated_words": c["n_repeat_words"] / n, "long_words": mean, "short_words": -mean}
        if c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"] and all(measure[r] <= x for r, x in cuts.get(lang, {}).items()):
            out[i] = (text, lang, source)
    return out


class Classes(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.find(x), self.find(y)))
        self[y] = x


def without_lines(docs):
    """All pairs of lines; what the counts of their characters rule out is not measured."""
    kinds = sorted({s for t, *_ in docs.values() for s in t.split("\n") if s.strip(" \t\n\v\f\r")}, key=len)
    chars = {c: n for n, c in enumerate(sorted({c for s in kinds for c in s}))}
    table = np.zeros((len(kinds), len(chars)), np.int32)
    for row, s in zip(table, kinds, strict=True):
        for c, n in Counter(s).items():
            row[chars[c]] = n
    size, classes = np.array([len(s) for s in kinds]), Classes()
    for i, s in enumerate(kinds):
        to = np.searchsorted(size, len(s) + 2, "right")
        for j in np.flatnonzero(np.abs(table[i + 1 : to] - table[i]).sum(axis=1) <= 4) + i + 1:
            if len(s) >= 15 and distance(s, kinds[j]) <= min(2, len(s) // 15):
                classes.join(s, kinds[j])
    seen, out = set(), {}
    for i in sorted(docs):
        kept = []
        for s in docs[i][0].split("\n"):
            one = classes.find(s)
            if not s.strip(" \t\n\v\f\r") or one not in seen:
                kept.append(s)
            seen.add(one)
        out[i] = ("\n".join(kept), *docs[i][1:])
    return out


def one_of_each(docs):
    sets, classes = {}, Classes()
    for i, (t, *_) in docs.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                classes.join(i, j)
    return {i: x for i, x in docs.items() if classes.find(i) == i}


def passes(docs):
    """How often the mix takes each document."""
    size = {i: len(WORD.findall(t)) for i, (t, *_) in docs.items()}
    by = defaultdict(int)
    for i, (*_, source) in docs.items():
        by[source] += size[i]
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    free, left, target = set(order), 1.5 * sum(by.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * by[s]}
        for s in over or free:
            target[s] = 2 * by[s] if over else level * weight[s]
            left -= target[s]
        free -= over or set(free)
    out, tilt_of = {}, {5: -0.5, 2: 0.0, 1: 0.5}
    for source in order:
        at, tilt = 0, tilt_of[weight[source]]
        for i in sorted((i for i in docs if docs[i][2] == source), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            middle = at + size[i] / 2
            at += size[i]
            shares = [(middle + k * by[source]) / target[source] for k in range(2)] if size[i] else []
            flat = 1 - tilt
            out[i] = sum((x if not tilt or x >= 1 else (math.sqrt(flat * flat + 4 * tilt * x) - flat) / (2 * tilt)) < 1 for x in shares)
    return out


def test_quality_counts_once(spark):
    """Counts that are made again for the filter take a second Python worker in each task, which stays for all later stages."""
    docs, labels = (spark.read.parquet(f"{D}/{name}.parquet") for name in ("documents", "labels"))
    plan = quality.good_documents(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pipeline_rows(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = {i: (t, lang, s) for i, t, lang, s in duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{D}/documents.parquet'").fetchall()}
    cuts = defaultdict(dict)
    table = lambda name: spark.read.parquet(f"{D}/{name}.parquet")
    for r in quality.cutoffs(quality.counted(table("documents")), table("labels")).collect():
        cuts[r["stratum"]][r["rule"]] = r["cutoff"]
    stages = [docs]
    for stage in (lambda x: good(x, cuts), without_lines, one_of_each):
        stages.append(stage(stages[-1]))
    assert len(stages[0]) > len(stages[1]) >= len(stages[3]) and sum(stages[1][i] != stages[2][i] for i in stages[2]) > 5
    last, times = stages[-1], passes(stages[-1])
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    want = Counter()
    for i, n in times.items():
        ids = lib.encode(last[i][0], add_special_tokens=False).ids
        if n:
            want[i, len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)] = n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, D).select("doc_id", "n_tokens", "ids", "decoded").collect())
    assert {x[0] for x in got} == {x[0] for x in want}
    assert got == want
