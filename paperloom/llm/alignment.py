"""Two tokenizers aligned over the same bytes, by an associative monoid of fragments.

Groups are cut where a token of A and one of B end at the same byte. A fragment is what a stretch of a text shows: its
closed groups, lying between two such ends that it knows; before the first of them an open head, after the last an open
tail. Composing two fragments joins the tail of one and the head of the next, closes what now lies between known ends, and
is associative, so that fragments compose in any tree.

Words (up to a blank behind which a word begins) are fragments without open ends: a worker makes each once, remembers the
last WORDS to 2 * WORDS, and a text of at most LONG bytes is composed of them where it is read. Longer texts are dealt out
as ranges of about RANGE characters: A's begin where its words do, B's where no entry joins the characters on both sides,
so that a range's A and B tokens do not end alike. Ranges are encoded by tasks of their own and composed FAN at a time,
level by level; closed groups leave the tree at once, so that only open ends move up.

Counts: a block (texts of one task, BLOCK_BYTES or so) is one row with its id pairs, and in how many texts each lies. The
pairs of blocks and long texts are summed to corpus counts, joined with each block's own pairs, and given to its texts
inside the row. What moves is a block's distinct pairs, never links; pairs of more than HUB blocks are joined apart.

Defined cases: texts that are null, empty, or whose joined token bytes differ from space and text have zeros and no
groups; a null doc_id is kept; rows are judged one by one, repeated ones as texts of their own in the counts; an empty
table gives an empty table; other columns are not read. A stretch without any place to cut is one range.
"""

import hashlib
import json
import os
import re
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import byte_symbols
from paperloom.llm.store import BROADCAST_ROWS, bounded, saved

LONG, RANGE, FAN, WORDS, LONG_WORD, BLOCK_ROWS, BLOCK_BYTES, HUB, ALONE = 1 << 16, 1 << 15, 8, 120_000, 48, 4096, 8 << 20, 10_000, 8
#: A blank behind a visible character begins a word of both tokenizers.
WORD = re.compile(r"[ \n][^ \n]*(?:(?<=\s)[ \n][^ \n]*)*")
#: Where A may be cut: before white space, behind ASCII letters, and before full-width punctuation behind CJK letters.
A_CUT = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])|(?<=[ぁ-ゖ一-鿿])(?=[、-〃！，？])")
ENDS = "struct<a:array<int>,a_end:array<long>,b:array<int>,b_end:array<long>>"
CLOSED = "array<struct<at:long,groups:string,n_groups:long,pairs:array<long>,times:array<long>>>"
FRAGMENT = f"row long, no long, head {ENDS}, tail {ENDS}, last long, closed {CLOSED}"
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
BLOCK = f"block long, docs array<struct<{DOC.replace(' ', ':').replace(',:', ',')},at:binary,times:binary>>, pairs array<long>, holders array<long>"
ENDS_ARROW = pa.struct([("a", pa.list_(pa.int32())), ("a_end", pa.list_(pa.int64())), ("b", pa.list_(pa.int32())), ("b_end", pa.list_(pa.int64()))])
CLOSED_ARROW = pa.list_(pa.struct([("at", pa.int64()), ("groups", pa.string()), ("n_groups", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))
FRAGMENT_ARROW = pa.schema([("row", pa.int64()), ("no", pa.int64()), ("head", ENDS_ARROW), ("tail", ENDS_ARROW), ("last", pa.int64()), ("closed", CLOSED_ARROW)])


class Pair:
    """Both tokenizers: the tokens of a stretch, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = {s: i for i, s in enumerate(byte_symbols())}
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = {i: bytes([of[c] for c in t]) if set(t) <= set(of) else t.encode() for t, i in vocab.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = {i: len(x) for i, x in self.a_bytes.items()}, [len(x) for x in self.b_bytes]
        top = max(max(self.a_len), len(pieces) - 1) + 1
        self.sizes = np.array([self.a_len.get(i, 0) for i in range(top)]), np.array(self.b_len)
        #: Each id as it stands in groups: before another, as the last of A, as the last of B.
        self.shown = [np.array([f"{i}{c}" for i in range(top)], object) for c in ",|;"]
        #: Characters that some entry of B joins, blanks as such.
        self.joined = {p[i : i + 2].replace("▁", " ") for i_, p in enumerate(pieces) if not self.b.is_byte(i_) for i in range(len(p) - 1)}
        self.line = self.b.encode("\n")
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        """Of stretches, none of which an entry joins with what is before it: behind a line feed, which no entry holds."""
        n = len(self.line)
        return [x[n:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        data = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == data and b"".join([self.b_bytes[i] for i in b]) == data

    def b_cut(self, text: str, at: int) -> int:
        """The first place from `at` on where no entry of B joins the characters on both sides."""
        while at < len(text) and text[at - 1 : at + 1] in self.joined:
            at += 1
        return at

    def learn(self, words: list[str]) -> dict[str, tuple]:
        """(number of A tokens, groups as text, pairs of ids) of each word, None for unlike bytes.

        Words that end visibly are aligned in one stream; where its bytes differ or no common end is at a word's, in two."""
        inside = [w for w in words if not w[-1].isspace()]
        out = self.streamed(inside) if len(inside) > ALONE else None
        if out is None and len(inside) > ALONE:
            half = len(inside) // 2
            out = self.learn(inside[:half]) | self.learn(inside[half:])
        rest = [w for w in words if w[-1].isspace()] if out else words
        out = out or {}
        for w, a, b in zip(rest, self.a_ids(rest), self.b_ids(rest), strict=True):
            if not self.same(w, a, b):
                out[w] = None
                continue
            groups, _, links = aligned(a, [self.a_len[i] for i in a], b, [self.b_len[i] for i in b])
            out[w] = (len(a), groups, np.array(links, np.int64).tobytes())
        return out

    def streamed(self, words: list[str]) -> dict[str, tuple] | None:
        """learn(), for all words behind each other: a link for each end of a token, a group for each common end."""
        text = "".join(words)
        (a,), (b,) = self.a_ids([text]), self.b_ids([text])
        if not self.same(text, a, b):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ea, eb = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = np.union1d(ea, eb)
        ia, ib = np.searchsorted(ea, ends), np.searchsorted(eb, ends)
        common = ends[ea[ia] == eb[ib]]
        stops = np.cumsum([len(w.encode()) for w in words])
        at = np.searchsorted(common, stops)
        if (common[np.minimum(at, len(common) - 1)] != stops).any():
            return None
        links = (a[ia] << 32 | b[ib]).tobytes()
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        shown = np.concatenate((np.where(common[ga] == ea, self.shown[1][a], self.shown[0][a]), np.where(common[gb] == eb, self.shown[2][b], self.shown[0][b])))
        shown = shown[np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")].tolist()
        na, n, to = (np.searchsorted(x, stops, "right").tolist() for x in (ea, ends, np.sort(np.concatenate((ea, eb)), kind="stable")))
        out, x, y, z = {}, 0, 0, 0
        for w, i, j, k in zip(words, na, n, to, strict=True):
            out[w] = (i - x, "".join(shown[z:k])[:-1], links[8 * y : 8 * j])
            x, y, z = i, j, k
        return out

    def fragments(self, words: set[str]) -> dict[str, tuple]:
        if len(self.known) > WORDS:
            self.older, self.known = self.known, {}
        known, older, new, here = self.known, self.older, [], {}
        for w in words.difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        for w, x in self.learn(new).items() if new else ():
            if len(w) <= LONG_WORD:
                known[w] = x
            else:
                here[w] = x
        return here | {w: known[w] for w in words if w in known}


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(paths: tuple[str, str]) -> Pair:
    return _pairs.get(paths) or _pairs.setdefault(paths, Pair(*paths))


def aligned(a: list[int], a_len: list[int], b: list[int], b_len: list[int]) -> tuple[str, int, list[int]]:
    """Tokens that begin and end alike: their groups as text, how many, and a link (A id * 2^32 + B id) for each overlap."""
    if not a:
        return "", 0, []
    i = j = a0 = b0 = 0
    x, y, links, groups = a_len[0], b_len[0], [], []
    while True:
        links.append(a[i] << 32 | b[j])
        if x < y:
            i += 1
            x += a_len[i]
        elif y < x:
            j += 1
            y += b_len[j]
        else:
            i += 1
            j += 1
            groups.append(f"{','.join(map(str, a[a0:i]))}|{','.join(map(str, b[b0:j]))}")
            a0, b0 = i, j
            if i == len(a):
                return ";".join(groups), len(groups), links
            x += a_len[i]
            y += b_len[j]


EMPTY = {"a": [], "a_end": [], "b": [], "b_end": []}


def joined(x: dict, y: dict) -> dict:
    return {k: [*x[k], *y[k]] for k in EMPTY}


def split(x: dict, at: int) -> tuple[dict, dict]:
    """The tokens that end up to `at`, and the others."""
    i, j = (int(np.searchsorted(np.array(x[k], np.int64), at, "right")) for k in ("a_end", "b_end"))
    return {"a": x["a"][:i], "a_end": x["a_end"][:i], "b": x["b"][:j], "b_end": x["b_end"][:j]}, {"a": x["a"][i:], "a_end": x["a_end"][i:], "b": x["b"][j:], "b_end": x["b_end"][j:]}


def closed(x: dict, start: int) -> list[dict]:
    """The groups of tokens that begin together at `start` and end alike; none if there are no tokens."""
    if not x["a"]:
        return []
    lengths = [np.diff(np.array([start, *x[k]], np.int64)).tolist() for k in ("a_end", "b_end")]
    groups, n, links = aligned(x["a"], lengths[0], x["b"], lengths[1])
    pairs, times = np.unique(np.array(links, np.int64), return_counts=True)
    return [{"at": start, "groups": groups, "n_groups": n, "pairs": pairs.tolist(), "times": times.tolist()}]


def settled(open_ends: dict, start: int | None) -> dict:
    """A fragment of tokens whose common ends are not looked for yet; start: where they begin, if A and B do together.

    last is the last end that it knows to be common, at which its tail begins; none if it is open all through."""
    ends = np.intersect1d(np.array(open_ends["a_end"], np.int64), np.array(open_ends["b_end"], np.int64))
    if not len(ends):
        head, tail = (open_ends, EMPTY) if start is None else (EMPTY, open_ends)
        return {"head": head, "tail": tail, "last": start, "closed": []}
    head, rest = split(open_ends, int(ends[0])) if start is None else (EMPTY, open_ends)
    middle, tail = split(rest, int(ends[-1]))
    return {"head": head, "tail": tail, "last": int(ends[-1]), "closed": closed(middle, int(ends[0]) if start is None else start)}


def composed(x: dict, y: dict) -> dict:
    """The fragment of two that follow each other; its closed groups are those that only both together close."""
    out = settled(joined(x["head"] if x["last"] is None else x["tail"], y["head"]), x["last"])
    if x["last"] is not None:
        out["head"] = x["head"]
    return out if y["last"] is None else out | {"tail": y["tail"], "last": y["last"]}


def _short(paths: tuple[str, str], digest: bool):
    """Texts of at most LONG bytes -> a row for each block."""
    doc = pa.struct([("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()), ("at", pa.binary()), ("times", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(doc)), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])

    def block_of(number, docs, codes):
        sizes = [len(c) for c, _ in codes]
        every = np.concatenate([c for c, _ in codes]) if codes else np.zeros(0, np.int64)
        pairs, at, holders = np.unique(every, return_inverse=True, return_counts=True)
        at = np.split(at.astype("<u4"), np.cumsum(sizes)[:-1])
        for d, own, (_, times) in zip(docs, at, codes, strict=True):
            d["at"] = pa.compress(np.diff(own, prepend=np.uint32(0)).astype("<u4").tobytes(), "zstd", asbytes=True)
            d["times"] = pa.compress(times.astype("<u4").tobytes(), "zstd", asbytes=True)
            d["size"] = len(own)
        rows = [{k: d[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")} | {"at": d["size"].to_bytes(4, "little") + d["at"], "times": d["times"]} for d in docs]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], pa.list_(doc)), pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        both, number = pair_of(paths), TaskContext.get().partitionId() << 32
        docs, codes, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                cut = [WORD.findall(" " + t) if t else [] for t in texts]
                known = both.fragments(set().union(*cut))
                for doc_id, text, words in zip(part.column("doc_id").to_pylist(), texts, cut, strict=True):
                    got = [known[w] for w in words]
                    if None in got:
                        got = []
                    groups = ";".join([g[1] for g in got])
                    links = np.frombuffer(b"".join([g[2] for g in got]), np.int64)
                    pairs, times = np.unique(links, return_counts=True)
                    # a group has a comma less on either side than tokens there
                    n_a, n_groups, n_links = sum([g[0] for g in got]), groups.count("|"), len(links)
                    n_b = groups.count(",") + 2 * n_groups - n_a
                    docs.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": hashlib.sha256(groups.encode()).hexdigest() if digest and got else groups})
                    codes.append((pairs, times))
                    size += len(text) + (0 if digest else len(groups))
                if len(docs) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield block_of(number, docs, codes)
                    docs, codes, size, number = [], [], 0, number + 1
        if docs:
            yield block_of(number, docs, codes)

    return run


def _ranges(paths: tuple[str, str]):
    """Long texts -> ranges: row (one number a text), doc_id, no, where A's and B's parts begin in bytes, and the parts."""
    names = ["row", "doc_id", "no", "a_at", "b_at", "a", "b"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        both, row = pair_of(paths), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text, no, a, b, a_at, b_at = " " + text.as_py(), 0, 0, 0, 0, 0
                while a < len(text) or b < len(text):
                    want = (no + 1) * RANGE
                    m = A_CUT.search(text, max(a, want)) if want < len(text) else None
                    a_end = m.start() if m else len(text)
                    b_end = both.b_cut(text, max(b, want, 1)) if want < len(text) else len(text)
                    parts = text[a:a_end], text[b:b_end]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((row, doc_id, no, a_at, b_at, *parts), kinds, strict=True)], names)
                    a_at, b_at = a_at + len(parts[0].encode()), b_at + len(parts[1].encode())
                    a, b, no = a_end, b_end, no + 1
                row += 1

    return run


def _encoded(paths: tuple[str, str]):
    """Ranges -> the fragment of each, its token numbers, and whether its bytes are those of the text."""
    schema = pa.schema([*FRAGMENT_ARROW, ("doc_id", pa.int64()), ("same", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64())])

    def run(batches):
        both = pair_of(paths)
        for batch in batches:
            for r in batch.to_pylist():
                a, b = both.a_ids([r["a"]])[0], both.b_ids([r["b"]])[0]
                same = b"".join([both.a_bytes[i] for i in a]) == r["a"].encode() and b"".join([both.b_bytes[i] for i in b]) == r["b"].encode()
                if not same:
                    a, b = [], []
                ends = {"a": a, "a_end": [r["a_at"] + x for x in accumulate(both.a_len[i] for i in a)], "b": b, "b_end": [r["b_at"] + x for x in accumulate(both.b_len[i] for i in b)]}
                f = settled(ends, None if r["no"] else 0)
                yield pa.RecordBatch.from_pylist([f | {"row": r["row"], "no": r["no"], "doc_id": r["doc_id"], "same": same, "n_a": len(a), "n_b": len(b)}], schema)

    return run


def _composed(part: pa.Table) -> pa.Table:
    """Fragments of a text that follow each other -> their composition."""
    rows = sorted(part.to_pylist(), key=lambda r: r["no"])
    out, done = rows[0], []
    for r in rows[1:]:
        out = composed(out, r)
        done += out["closed"]
    return pa.Table.from_pylist([out | {"row": rows[0]["row"], "no": rows[0]["no"] // FAN, "closed": done}], FRAGMENT_ARROW)


def _listed(digest: bool):
    """Closed groups by text and place -> one row a text: groups as text or its digest, and their number and links."""

    def run(batches):
        row, kept, n, links = None, None, 0, 0

        def told():
            groups = kept.hexdigest() if digest else ";".join(kept)
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([groups], pa.string()), pa.array([n], pa.int64()), pa.array([links], pa.int64())], ["row", "groups", "n_groups", "n_links"])

        for batch in batches:
            for r in batch.to_pylist():
                new = r["row"] != row
                if new:
                    if row is not None:
                        yield told()
                    row, kept, n, links = r["row"], hashlib.sha256() if digest else [], 0, 0
                if digest:
                    kept.update((r["groups"] if new else f";{r['groups']}").encode())
                else:
                    kept.append(r["groups"])
                n, links = n + r["n_groups"], links + r["n_links"]
        if row is not None:
            yield told()

    return run


def _summed(batches):
    """Blocks with the counts of their pairs -> their texts with n_best and count_sum."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    for batch in batches:
        for docs, n, best in zip(*(batch.column(c) for c in ("docs", "n", "best")), strict=True):
            n, best = np.array(n.as_py() or [], np.int64), np.array(best.as_py() or [], bool)
            docs, sums = docs.as_py(), ([], [])
            for d in docs:
                size = int.from_bytes(d["at"][:4], "little")
                at, times = (np.frombuffer(pa.decompress(x, 4 * size, "zstd", asbytes=True), "<u4").astype(np.int64) for x in (d["at"][4:], d["times"]))
                at = np.cumsum(at)
                sums[0].append(int(times[best[at]].sum()))
                sums[1].append(int((times * n[at]).sum()))
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in docs], k) for c, k in zip(names, kinds, strict=True)] + [pa.array(x, pa.int64()) for x in sums], [*names, "n_best", "count_sum"])


def _counted(own: DataFrame, counts: DataFrame) -> DataFrame:
    """own (pair, ...) with n and best of each pair; no pair of many blocks is in one task."""
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return own.join(F.broadcast(counts.drop("blocks")), "pair")
    hubs = bounded(counts.where(F.col("blocks") > HUB).drop("blocks"))
    rest = own.join(hubs.select("pair"), "pair", "left_anti").join(counts.where(F.col("blocks") <= HUB).drop("blocks"), "pair")
    return own.join(hubs, "pair").unionByName(rest)


def _long(docs: DataFrame, paths: tuple[str, str], digest: bool) -> tuple[DataFrame, DataFrame]:
    """Long texts -> (row, doc_id, n_a, n_b, n_groups, n_links, groups) and (row, pair, times)."""
    ranges = saved(docs.mapInArrow(_ranges(paths), "row long, doc_id long, no long, a_at long, b_at long, a string, b string"), "ranges")
    found = saved(ranges.repartition("row", "no").mapInArrow(_encoded(paths), f"{FRAGMENT}, doc_id long, same boolean, n_a long, n_b long"), "fragments")
    facts = saved(found.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("same").alias("same"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")), "facts")
    now = found.join(bounded(facts.where("same").select("row")), "row", "left_semi").select("row", "no", "head", "tail", "last", "closed")
    done, most = [now.select("row", F.inline("closed"))], found.agg(F.max("no")).first()[0] or 0
    while most:
        now, most = saved(now.groupBy("row", F.expr(f"no div {FAN}").alias("up")).applyInArrow(_composed, FRAGMENT), "composed"), most // FAN
        done.append(now.select("row", F.inline("closed")))
    every = reduce(DataFrame.unionByName, done)
    pairs = every.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("row", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times"))
    text = every.select("row", "at", "groups", "n_groups", F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("n_links")).repartition("row").sortWithinPartitions("row", "at")
    text = text.mapInArrow(_listed(digest), "row long, groups string, n_groups long, n_links long")
    whole = F.col("same")
    out = facts.join(text, "row", "left").select("row", "doc_id", *[F.when(whole, F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.coalesce("groups", F.lit("")).alias("groups"))
    return out, saved(pairs, "pairs")


def alignment(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups as text or its digest."""
    docs, paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), (path_a, path_b)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    blocks = saved(docs.where(size <= LONG).mapInArrow(_short(paths, digest), BLOCK), "blocks")
    long, long_pairs = _long(docs.where(size > LONG), paths, digest)
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders", F.lit(1).alias("blocks"))
    held = held.unionAll(long_pairs.select("pair", F.lit(1), F.lit(0))).toDF("pair", "n", "blocks")
    counts = saved(held.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")), "counts")
    # a row for each A id: no more than A's vocabulary
    most = F.broadcast(counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most")))
    counts = saved(counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", "blocks", (F.col("n") == F.col("most")).alias("best")), "best")
    found = _counted(blocks.select("block", F.explode("pairs").alias("pair")), counts)
    found = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("c"))
    short = blocks.select("block", "docs").join(found.select("block", F.col("c.n").alias("n"), F.col("c.best").alias("best")), "block", "left").select("docs", "n", "best")
    short = short.mapInArrow(_summed, f"{DOC}, n_best long, count_sum long")
    sums = _counted(long_pairs, counts).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return short.unionByName(long.join(sums, "row", "left").drop("row").withColumns({c: zero(c) for c in ("n_best", "count_sum")}))


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """alignment() with a digest of the groups."""
    return alignment(docs, path_a, path_b, digest=True).withColumnRenamed("groups", "groups_sha256")
