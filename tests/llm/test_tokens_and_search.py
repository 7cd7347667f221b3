"""Packing, alignment of tokenizers and ranked search: against the libraries and brute force, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from paperloom.llm import alignment, bpe, lexical, packing
from paperloom.llm import textbytes as tb

WORDS_PATH, A_PATH, B_PATH = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row long, no long, start long, ids string, offset int, n long, term string, pair long"
ODD = ["", " ", "\n", "a ", "  b", "don't  stop\n\n now", "x\x1c y", "é́ é ́x", "▁ x", "<|endoftext|>a<|ENDOFTEXT|> <s>", "Straße ΣΑΣ İstanbul ﬁ", "日本語、テスト。　x", "a\x00b", "\ttab\r\nline", "١٢٣ 4½", "🙂🙂 ok", "w" * 3000, "1" * 400 + "'s", " nb sp", "A.b'c,D!?"]


def prose(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghéü") for _ in range(r.randint(1, 9))) for _ in range(400)]
    return "".join(r.choice(vocab).title() + r.choice([" ", " ", ", ", ".\n", "\n\n", "  "]) for _ in range(n))


def odd_rows():
    texts = [None, *ODD, prose(300, 1), prose(300, 1), prose(3000, 2), "".join(ODD)]
    rows = [(i, t, 1, 2, 3, "x", 4, 5, "t", 6) for i, t in enumerate(texts)]
    return [*rows, rows[-2], (None, "null id", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS_PATH)


def test_word_ids(library):
    ids_of, r = packing.WordIds(WORDS_PATH), random.Random(5)
    alphabet = "abZé'.,<|>\n \t\x1ć ΣßÀ÷1½日" + "".join(map(chr, range(0xC0, 0x180)))
    texts = [*ODD, prose(500, 3)] + ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(400)]
    got = ids_of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(texts) == got
    long = prose(3000, 4)
    before, packing.STRETCH = packing.STRETCH, 100
    try:
        assert ids_of.whole(long) == ids_of([long])[0]
    finally:
        packing.STRETCH = before


def test_rooms():
    r = random.Random(7)
    rooms, held = packing.Rooms(64), []
    for _ in range(2000):
        need = r.randint(1, 64)
        if r.random() < 0.5:
            rooms.put(need, [need])
            held.append(need)
        else:
            got, want = rooms.tightest(need), min([x for x in held if x >= need], default=None)
            assert (got and got[0]) == want
            if want:
                held.remove(want)


@pytest.mark.parametrize("slack", [0, 4])
def test_packing(spark, odd, none, library, slack):
    out = packing.packed(odd, WORDS_PATH, 256, 1, slack).collect()
    of = defaultdict(list)
    for t in odd_rows():
        of[t[0]].append([*library.encode(t[1] or "", add_special_tokens=False).ids, 1])
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in out:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert len(ids) == p["length"] > 0 and p["doc_tokens"] in [len(x) for x in of[p["doc_id"]]]
        assert any(ids == x[p["start"] : p["start"] + p["length"]] for x in of[p["doc_id"]])
        pieces[p["doc_id"]].append(p["length"])
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {d: sum(x) for d, x in pieces.items()} == {d: sum(map(len, x)) for d, x in of.items()}
    for w in windows.values():
        size = sum(n for _, n in w)
        assert [o for o, _ in sorted(w)] == np.cumsum([0, *[n for _, n in sorted(w)]]).tolist()[:-1]
        assert size <= 256 and (256 - size <= slack or size & (size - 1) == 0)
    # full windows of the long document stand alone
    long = len(of[23][0])
    assert sum(p["doc_id"] == 23 and p["length"] == 256 for p in out) >= long // 256 > 4
    for p in packing.report(odd.where("doc_id = 21"), WORDS_PATH).collect():
        assert p["ids_crc32"] == zlib.crc32(np.array(of[21][0][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert packing.packed(none, WORDS_PATH).count() == 0


def test_packing_gives_out_windows_on_the_way(library):
    before, packing.HELD = packing.HELD, 2000
    try:
        docs = [(i, prose(5 + i * 7 % 90, i)) for i in range(150)]
        windows = defaultdict(int)
        for p in packed_locally(docs):
            windows[p["sequence_id"]] += p["length"]
        assert sum(windows.values()) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)
        assert all(n >= 252 or n & (n - 1) == 0 for n in windows.values())
        assert sum(n < 252 for n in windows.values()) <= 8 * (1 + len(windows) // 20)
    finally:
        packing.HELD = before


def packed_locally(docs):
    class Context:
        @staticmethod
        def partitionId():
            return 3

    class Get:
        @staticmethod
        def get():
            return Context

    before, packing.TaskContext = packing.TaskContext, Get
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
        for out in packing._pack(WORDS_PATH, 256, 1, 4)(iter([batch])):
            yield from out.to_pylist()
    finally:
        packing.TaskContext = before


def whole_alignment(both, text):
    """Both encodings of a whole text: their numbers, groups as text, and links with how often they occur."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    if not both.same(" " + text, a, b):
        return None
    x, y = (np.cumsum([0, *[of[i] for i in ids]]).tolist() for ids, of in ((a, both.a_len), (b, both.b_len)))
    ends = sorted(set(x) & set(y))
    i, j = ({e: n for n, e in enumerate(of)} for of in (x, y))
    groups = [",".join(map(str, a[i[s] : i[e]])) + "|" + ",".join(map(str, b[j[s] : j[e]])) for s, e in zip(ends, ends[1:])]
    links = Counter()
    for i in range(len(a)):
        for j in range(int(np.searchsorted(y, x[i], "right")) - 1, len(b)):
            if y[j] >= x[i + 1]:
                break
            links[a[i], b[j]] += 1
    return len(a), len(b), len(groups), sum(links.values()), ";".join(groups), links


@pytest.mark.parametrize("long,size,fan", [(1 << 16, 1 << 15, 8), (400, 60, 2)])
def test_alignment(odd, none, long, size, fan):
    before = alignment.LONG, alignment.RANGE, alignment.FAN
    alignment.LONG, alignment.RANGE, alignment.FAN = long, size, fan
    try:
        both = alignment.Pair(A_PATH, B_PATH)
        found = [(r[0], whole_alignment(both, r[1])) for r in odd_rows()]
        count = Counter(p for _, x in found if x for p in x[5])
        best = defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        want = []
        for d, x in found:
            sums = (sum(n for p, n in x[5].items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x[5].items())) if x else ()
            want.append((d, *x[:5], *sums) if x else (d, 0, 0, 0, 0, "", 0, 0))
        columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        got = sorted([tuple(r) for r in alignment.alignment(odd, A_PATH, B_PATH).select(columns).collect()], key=key)
        assert got == sorted(want, key=key) and sum(x is None for _, x in found) >= 3
        digests = {r["doc_id"]: r["groups_sha256"] for r in alignment.report(odd.where("doc_id < 25"), A_PATH, B_PATH).collect()}
        assert digests == {r[0]: r[5] and hashlib.sha256(r[5].encode()).hexdigest() for r in want if r[0] is not None and r[0] < 25}
        assert alignment.alignment(none, A_PATH, B_PATH).count() == 0
    finally:
        alignment.LONG, alignment.RANGE, alignment.FAN = before


def test_fragments_compose_in_any_order():
    r = random.Random(3)
    for _ in range(200):
        total = r.randint(1, 60)
        ends = [sorted({*r.sample(range(1, total), min(total - 1, r.randint(0, 30))), total}) if total > 1 else [1] for _ in range(2)]
        cuts = [sorted(r.randint(0, len(e)) for _ in range(5)) for e in ends]
        parts = []
        for k in range(6):
            at = [([0, *c, len(e)][k], [0, *c, len(e)][k + 1]) for c, e in zip(cuts, ends, strict=True)]
            x = {"a": ends[0][slice(*at[0])], "a_end": ends[0][slice(*at[0])], "b": ends[1][slice(*at[1])], "b_end": ends[1][slice(*at[1])]}
            f = alignment.settled(x, None if k else 0)
            parts.append((f, f["closed"]))
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            (x, p), (y, q) = parts[i], parts[i + 1]
            z = alignment.composed(x, y)
            parts[i : i + 2] = [(z, [*p, *q, *z["closed"]])]
        f, done = parts[0]
        assert not f["head"]["a"] and not f["head"]["b"] and not f["tail"]["a"] and not f["tail"]["b"] and f["last"] == total
        common, want, old = sorted(set(ends[0]) & set(ends[1])), [], 0
        for c in common:
            want.append(",".join(str(x) for x in ends[0] if old < x <= c) + "|" + ",".join(str(x) for x in ends[1] if old < x <= c))
            old = c
        assert ";".join(c["groups"] for c in sorted(done, key=lambda c: c["at"])) == ";".join(want)


def by_hand(docs, items, k):
    terms = [(d, Counter(lexical.terms_of(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in terms:
            if c:
                m = 75 + 25 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in lexical.terms_of(text) if t in c)
                if s > 0:
                    scores.append((-s, d is not None, d or 0))
        out += [(item, i, d if some else None, -s) for i, (s, some, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,slice_rows,at_once,k", [(8192, 2048, 32, 20), (40, 16, 3, 5), (7, 3, 1, 3)])
def test_search(spark, odd, none, block, slice_rows, at_once, k):
    before = lexical.BLOCK, lexical.SLICE, lexical.AT_ONCE
    lexical.BLOCK, lexical.SLICE, lexical.AT_ONCE = block, slice_rows, at_once
    try:
        docs = [(i * 37 % 250, prose(20 + i % 40, i % 190)) for i in range(250)] + [(r[0] and r[0] + 500, r[1]) for r in odd_rows()]
        items = [(i, prose(12, i * 3)) for i in range(15)] + [(15, None), (16, " "), (17, "no such word zzzz"), (18, "abc ABC abc"), (3, prose(9, 1)), (None, prose(9, 2)), (19, "".join(ODD))]
        got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
        assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str) == by_hand(docs, items, k)
    finally:
        lexical.BLOCK, lexical.SLICE, lexical.AT_ONCE = before
    some = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert lexical.ranked(none, some).count() == 0 and lexical.ranked(odd, some.where("false")).count() == 0
    assert lexical.ranked(odd, some.selectExpr("item_id", "text", "1 as rank", "2 as score")).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_parts(spark, odd):
    items = spark.createDataFrame([(i, prose(8, i)) for i in range(9)], "item_id long, text string")
    want = sorted(map(tuple, lexical.ranked(odd, items).collect()), key=str)
    before, lexical.PARTS = lexical.PARTS, 4
    try:
        assert sorted(map(tuple, lexical.ranked(odd, items).collect()), key=str) == want
    finally:
        lexical.PARTS = before


def test_parts_of_long_texts():
    texts = pa.array([prose(200, 1), None, "x" * 5000 + " " + "y" * 300, prose(3000, 2), ""])
    before, tb.PIECE = tb.PIECE, 500
    try:
        got = defaultdict(bytes)
        for owner, buf, offs in tb.parts(texts, lexical.TERM):
            for i, o in enumerate(owner):
                part = buf[offs[i] : offs[i + 1]].tobytes()
                assert not (got[o] and lexical.TERM[got[o][-1]] and len(part) and lexical.TERM[part[0]])
                got[o] += part
        assert [got[i].decode() for i in range(5)] == [t or "" for t in texts.to_pylist()]
    finally:
        tb.PIECE = before


def test_words_are_learned_in_one_stream():
    """Both libraries see all new words behind each other; what they say of each is what they say of it alone."""
    both, rng = alignment.Pair(A_PATH, B_PATH), random.Random(8)
    words = sorted({rng.choice(" \n") + "".join(rng.choice("abetñ中9.,&\U0001f600") for _ in range(rng.randrange(1, 14))) for _ in range(700)})
    odd = [" ", " \n ", " a\t", " ①", " ﬁne", " x\u200by", " ▁x"]

    def alone(w):
        a, b = both.a_ids([w])[0], both.b_ids([w])[0]
        if not both.same(w, a, b):
            return None
        groups, _, links = alignment.aligned(a, [both.a_len[i] for i in a], b, [both.b_len[i] for i in b])
        return len(a), groups, b"".join(x.to_bytes(8, "little") for x in links)

    calls, whole = [], both.a_ids
    both.a_ids = lambda texts: calls.append(len(texts)) or whole(texts)
    got = both.learn(words)
    assert max(calls) <= 1
    both.a_ids = whole
    assert got == {w: alone(w) for w in words} and None not in got.values()
    mixed = words[:300] + odd + words[300:]
    assert both.learn(mixed) == {w: alone(w) for w in mixed} and both.learn([]) == {}
    assert both.learn([" ▁x"]) == {" ▁x": None}


def test_encoders_leave_with_their_stage():
    """A worker keeps the encoder from task to task, but not into those of other operators."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["some words", None])], ["doc_id", "text"])
    tb.KEPT.clear()
    want = [b.to_pylist() for b in bpe._encode(WORDS_PATH)(iter([batch]))]
    first = tb.KEPT[WORDS_PATH]
    assert [b.to_pylist() for b in bpe._encode(WORDS_PATH)(iter([batch]))] == want and tb.KEPT[WORDS_PATH] is first
    tb.count_words(batch.column("text"))
    assert not tb.KEPT
