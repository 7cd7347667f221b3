"""The rules of `matching` for all pairs of records and works that share a key.

A pair costs the look-up of three bits: blocks of records meet blocks of works in tasks, where all names and titles of a
block of works are looked for in the records' letters at once, so that no text is read for a pair."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import matching
from paperloom.operators.resolve import cut

#: Records and works of a key that a task compares at once; letters that are looked through at once.
RECORDS, WORKS, LETTERS = 512, 1024, 1 << 17
#: Between texts: longer than what may lie between a given and a family name.
GAP = bytes(8)
NO_LETTERS = bytes(x for x in range(256) if not 97 <= x <= 122)
DIGITS = re.compile(b"[0-9]+")
INITIAL = re.compile(b"([a-z]) (?:[a-z] ){0,2}([a-z]{3,})")
#: Needles are compared by their first 32 letters as four numbers, then by the rest.
HEADS = 4
MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype="<u8")


def letters(fold: str) -> bytes:
    return fold.encode("ascii").translate(None, NO_LETTERS)


class Found:
    """Sorted distinct numbers, and where among them given numbers are: most that are absent fall out by a small table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, np.zeros(1 << 16, dtype=bool)
        self.table[self._slot(keys)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into x, and into the keys, of equal numbers."""
        at = np.flatnonzero(self.table[self._slot(x)])
        k = np.searchsorted(self.keys, x[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == x[at]
        return at[ok], k[ok]


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n from first on: the number of the run and the element, of each element."""
    run = np.repeat(np.arange(len(n)), n)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


class Buffer:
    """Texts of letters, each with a gap behind it; window: the eight letters from a place on as a number."""

    def __init__(self, texts: list[bytes]):
        self.text = b"".join(t + GAP for t in texts)
        sizes = np.array([len(t) + len(GAP) for t in texts])
        self.row, self.start = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        self.code = np.frombuffer(self.text, dtype=np.uint8) & 31
        self.window = np.ndarray((len(self.text) + 8 * (HEADS - 1),), "<u8", self.text + bytes(8 * HEADS), strides=(1,)).copy()


class Needles:
    """Distinct non-empty words of letters, looked for all at once at every place of a buffer."""

    def __init__(self, words: list[bytes]):
        self.words, self.length = words, np.array([len(w) for w in words], dtype=np.int64)
        padded = b"".join(w[: 8 * HEADS].ljust(8 * HEADS, b"\0") for w in words)
        self.parts = np.frombuffer(padded, dtype="<u8").reshape(-1, HEADS)
        self.classes = []
        for n in range(1, 9):
            ids = np.flatnonzero(np.minimum(self.length, 8) == n)
            if len(ids):
                ids = ids[np.argsort(self.parts[ids, 0], kind="stable")]
                keys, first, count = np.unique(self.parts[ids, 0], return_index=True, return_counts=True)
                self.classes.append((n, ids, Found(keys), first, count))

    def there(self, b: Buffer, p: np.ndarray, k: np.ndarray, begin: int = 0) -> np.ndarray:
        """Which of the words k begin at the places p; their first parts, up to begin, are known to."""
        left = np.arange(len(p))
        for i in range(begin, HEADS):
            more = self.length[k[left]] > 8 * i
            same = (b.window[p[left] + 8 * i] & MASKS[np.clip(self.length[k[left]] - 8 * i, 0, 8)]) == self.parts[k[left], i]
            left = left[~more | same]
        ok = np.zeros(len(p), dtype=bool)
        ok[left] = True
        for i in left[self.length[k[left]] > 8 * HEADS]:
            ok[i] = b.text.startswith(self.words[k[i]], p[i])
        return ok

    def places(self, b: Buffer) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and their numbers."""
        at, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, of_class, found, first, count in self.classes:
            p, k = found.places(b.window[: len(b.text)] & MASKS[size])
            if size == 8:
                run, j = spread(first[k], count[k])
                p, k = p[run], of_class[j]
                ok = self.there(b, p, k, 1)
                p, k = p[ok], k[ok]
            else:
                k = of_class[first[k]]
            at.append(p)
            ids.append(k)
        return np.concatenate(at), np.concatenate(ids)


def initials(folds: list[str]):
    """Single letters of folded texts, each with the text's number and the word of three letters or more that follows it, at
    most two more single letters between; digits are spaces."""
    text = DIGITS.sub(b" ", "\n".join(["", *folds, ""]).encode())
    code = np.frombuffer(text, dtype=np.uint8)
    letter = code >= 97
    at = np.flatnonzero(letter[1:-1] & ~letter[:-2] & (code[2:] == 32)) + 1
    row = np.cumsum(code == 10)[at] - 1
    for r, i in zip(row.tolist(), at.tolist()):
        if m := INITIAL.match(text, i):
            yield r, m[1], m[2]


class Names:
    """name_keys() of a block of works, each distinct name once; rows: the number of each one's name, or -1 if it is never printed."""

    def __init__(self, names: list[tuple]):
        self.persons, self.groups, self.rows = {}, {}, []
        for group, given, family, token in names:
            kind = key = None
            if group is None:
                pass
            elif group and len(token) >= 4:
                kind, key = self.groups, token.encode()
            elif not group and given != "" and len(family) >= 2:
                kind, key = self.persons, (given.encode(), family.encode())
            self.rows.append(None if key is None else (kind is self.groups, kind.setdefault(key, len(kind))))
        n = len(self.persons)
        self.rows = np.array([-1 if x is None else x[1] + n * x[0] for x in self.rows], dtype=np.int64)
        self.n = n + len(self.groups)

    def words(self) -> set[bytes]:
        """What is looked for everywhere; given names are only looked for before their families."""
        return {f for _, f in self.persons} | set(self.groups)

    def link(self, of: dict[bytes, int]) -> None:
        """of: the numbers of the needles that hold all words()."""
        families = {f: k for k, f in enumerate(dict.fromkeys(f for _, f in self.persons))}
        self.family, self.group = (np.full(len(of), -1, dtype=np.int64) for _ in range(2))
        for f, k in families.items():
            self.family[of[f]] = k
        for w, k in self.groups.items():
            self.group[of[w]] = len(self.persons) + k
        # which two letters, before a family or up to four others, may end one of its given names
        self.ending = np.zeros((len(families), 32, 32), dtype=bool)
        # given names of one letter: names by family and letter; others: by family and last two letters, then by all letters
        self.by_letter = np.full((len(families), 32), -1, dtype=np.int32)
        given, ends = [], []
        for (g, f), k in self.persons.items():
            if len(g) == 1:
                self.by_letter[families[f], g[0] & 31] = k
                self.ending[families[f], :, g[0] & 31] = True
            else:
                given.append((g, k))
                ends.append(families[f] * 1024 + (g[-2] & 31) * 32 + (g[-1] & 31))
        order = np.argsort(np.array(ends, dtype=np.int64), kind="stable")
        self.given = Needles([given[i][0] for i in order])
        self.given_name = np.array([given[i][1] for i in order], dtype=np.int64)
        ends, self.first, self.count = np.unique(np.array(ends, dtype=np.int64)[order], return_index=True, return_counts=True)
        self.ending = self.ending.ravel()
        self.ending[ends] = True
        self.ends = Found(ends.astype("<u8"))
        self.short = {}
        for (g, f), k in self.persons.items():
            if len(f) >= 3:
                self.short.setdefault((g[:1], f), []).append(k)

    def printed(self, b: Buffer, at: np.ndarray, ids: np.ndarray, folds: list[str], hits: np.ndarray) -> None:
        """Marks in hits (texts by names) what is printed; at and ids: the needles' places."""
        g = self.group[ids]
        hits[b.row[at[g >= 0]], g[g >= 0]] = True
        f = self.family[ids]
        q, f = at[f >= 0], f[f >= 0]
        two = np.zeros(len(b.text) + matching.BETWEEN, dtype=np.int32)  # the two letters before a place, from BETWEEN on
        two[matching.BETWEEN + 1 :] = b.code[:-1]
        two[matching.BETWEEN + 2 :] += 32 * b.code[:-2].astype(np.int32)
        base = f.astype(np.int32) * 1024
        for j in range(matching.BETWEEN + 1 if len(f) else 0):
            key = base + two[matching.BETWEEN - j :][q]
            p = np.flatnonzero(self.ending[key])
            key = key[p]
            k = self.by_letter[key >> 10, key & 31]
            hits[b.row[q[p[k >= 0]]], k[k >= 0]] = True
            at, i = self.ends.places(key.astype("<u8"))
            run, k = spread(self.first[i], self.count[i])
            end = q[p[at[run]]]
            begin = end - j - self.given.length[k]
            ok = begin >= 0
            end, k, begin = end[ok], k[ok], begin[ok]
            ok = self.given.there(b, begin, k)
            hits[b.row[end[ok]], self.given_name[k[ok]]] = True
        for r, x, w in initials(folds):
            for family in (w, w[:-1]):
                for k in self.short.get((x, family), ()):
                    hits[r, k] = True


def bits(hits: np.ndarray) -> list[np.ndarray]:
    """Rows of booleans as 64-bit numbers, the first in the lowest bit."""
    wide = np.zeros((len(hits), -(-hits.shape[1] // 64) * 64), dtype=bool)
    wide[:, : hits.shape[1]] = hits
    return list(np.packbits(wide, axis=1, bitorder="little").view("<i8"))


def verdicts(records: pd.DataFrame, works: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """title_ok, first and second author printed, of records (own_all, own_main, fold, page) by works (of_all, of_main, and
    group, given, family, token of the first and the second author, f_ and s_)."""
    m = len(works)
    names = Names([x for k in "fs" for x in zip(*(works[f"{k}_{c}"] for c in ("group", "given", "family", "token")))])
    titles = [letters(t) for t in works["of_all"]]
    words = sorted((names.words() | set(titles)) - {b""})
    of = {w: i for i, w in enumerate(words)}
    needles = Needles(words)
    names.link(of)
    is_title = np.full(len(words), -1, dtype=np.int64)
    distinct = {t: k for k, t in enumerate(dict.fromkeys(titles))}
    for t, k in distinct.items():
        if t:
            is_title[of[t]] = k
    texts, folds, page = [letters(x) for x in records["fold"]], records["fold"].tolist(), records["page"].to_numpy()
    author, title = np.zeros((len(texts), names.n + 1), dtype=bool), np.zeros((len(texts), len(distinct)), dtype=bool)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= LETTERS):
            size += len(texts[end]) + len(GAP)
            end += 1
        b = Buffer(texts[begin:end])
        at, ids = needles.places(b)
        names.printed(b, at, ids, folds[begin:end], author[begin:end, : names.n])
        k = is_title[ids]
        ok = (k >= 0) & (at + needles.length[ids] - b.start[b.row[at]] <= page[begin:end][b.row[at]])
        title[begin:end][b.row[at[ok]], k[ok]] = True
        begin = end
    if b"" in distinct:
        title[:, distinct[b""]] = True
    code = {}
    own, own_main = (np.array([code.setdefault(x, len(code)) for x in records[c]], dtype=np.int64)[:, None] for c in ("own_all", "own_main"))
    of_all, of_main = (np.array([code.setdefault(x, len(code)) for x in works[c]], dtype=np.int64)[None, :] for c in ("of_all", "of_main"))
    same = (own == of_all) | (own_main == of_all) | (own == of_main)
    none = code.get("", -1)
    title_ok = (own != none) & (of_all != none) & (same | title[:, [distinct[t] for t in titles]])
    return title_ok, author[:, names.rows[:m]], author[:, names.rows[m:]]


def _compared(key, records: pd.DataFrame, works: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"key": key[0], "part": key[1], "record": records["record"]})
    if len(records) and len(works):
        out["title"], out["first"], out["second"] = map(bits, verdicts(records, works.sort_values("place")))
        return out
    return pd.DataFrame({c: [] for c in (*out.columns, "title", "first", "second")})


def paired(records: DataFrame, works: DataFrame) -> DataFrame:
    """record, work, title_ok, first_ok, second_ok and the works' group and n, of all pairs of one key.

    records: key, record, own (title_keys()), fold (folded head of its text), page (how many of that head's letters are on the
    first page). works: key, work, n, of (title_keys()), first and second (name_keys()). Large keys are dealt out in parts of
    about RECORDS records and WORKS works."""
    sizes = records.groupBy("key").agg(F.ceil(F.count("*") / RECORDS).cast("int").alias("blocks"))
    sizes = cut(sizes.join(works.groupBy("key").agg(F.ceil(F.count("*") / WORKS).cast("int").alias("parts")), "key"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    w = works.join(sizes, "key").withColumn("part", dealt("work", F.col("parts")))
    w = w.withColumn("place", F.row_number().over(Window.partitionBy("key", "part").orderBy("work")) - 1)
    name = [F.col(f"{c}.{x}").alias(f"{c[0]}_{x}") for c in ("first", "second") for x in ("group", "given", "family", "token")]
    w = cut(w.select("key", "part", "place", "work", "n", "blocks", F.col("of.all").alias("of_all"), F.col("of.main").alias("of_main"), *name))
    r = records.join(sizes, "key").withColumn("block", dealt("record", F.col("blocks")))
    r = r.select("key", upto("parts").alias("part"), "block", "record", F.col("own.all").alias("own_all"), F.col("own.main").alias("own_main"), "fold", "page")
    many = w.select("*", upto("blocks").alias("block")).drop("work", "n", "blocks")
    at = ("key", "part", "block")
    told = r.groupBy(*at).cogroup(many.groupBy(*at))
    told = cut(told.applyInPandas(_compared, f"key {dict(r.dtypes)['key']}, part int, record {dict(r.dtypes)['record']}, title array<long>, first array<long>, second array<long>"))
    pairs = told.join(w.select("key", "part", "place", "work", "n", F.col("f_group").alias("group")), ["key", "part"])
    word, bit = F.shiftright("place", 6), F.col("place").bitwiseAND(63)
    told_of = lambda c: F.getbit(F.get(c, word), bit) == 1
    return pairs.select("record", "work", "n", "group", told_of("title").alias("title_ok"), told_of("first").alias("first_ok"), told_of("second").alias("second_ok"))
