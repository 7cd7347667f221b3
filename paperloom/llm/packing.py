"""Documents packed into windows of a fixed number of tokens by best-fit decreasing.

A document's ids are those of the tokenizer file, and the end id behind them. Overlong documents are first cut into full
windows, which stand alone. The rests go, longest first, each into the open window with the least room that still holds
it; a segment tree over remaining capacities finds that window, and a new one is opened where none has the room.

Every task packs what it reads: nothing is shuffled, and a task holds the rests of at most HELD tokens. Once it has so
many, windows with at most `slack` free places are given out and the others' pieces wait for the next rests. At its end
the emptiest windows are dealt out to the gaps of the fullest, cut where a piece does not fit, and the one that is left
becomes windows of powers of two, which need no padding. So at most `slack` places a window are padding.

Ids come word by word: no token crosses a space or a line feed, so that a worker asks the tokenizers library for each word
once, and remembers the last WORDS to 2 * WORDS words. A text is worked on in stretches of STRETCH characters, cut at a space.

Defined cases: null text is empty and has the end id alone; a null doc_id is kept; repeated rows are packed one by one; an
empty table gives an empty table; other columns are not read. Sequence ids are unique, not gapless. Repeated runs over
the same files agree: ties are broken by doc_id, start and ids.
"""

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import byte_symbols

WINDOW, END_ID, SLACK, HELD, STRETCH, WORDS, LONG_WORD, ROWS = 2048, 1, 4, 3_000_000, 1 << 20, 300_000, 48, 4096
BREAK = re.compile("[ \n]")
STEM = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([\x00-&(-@\\[-`{-\x7f].*)?", re.DOTALL)
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Known(dict):
    """Ids of words; those that are missing come from older ones or are learnt."""

    def __init__(self, ids: "WordIds", older: dict | None = None):
        self[""] = b""
        self.learn, self.older = ids.learn, dict(older or {})

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.learn(word)
        if len(word) <= LONG_WORD:
            self[word] = got
        return got


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    A word that begins with letters of STEM and goes on, if at all, with another ASCII character than an apostrophe is a
    word of these letters and the rest to the tokenizer; both are remembered apart, and neither is composed any further."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.symbol = byte_symbols()
        self.known = Known(self)
        self.parts: dict[str, bytes] = {}

    def _stem(self, letters: str) -> bytes:
        word = letters.lower()
        word = word if word.isascii() else "".join([self.symbol[b] for b in word.encode()])
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()

    def _rest(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, word: str) -> bytes:
        m = STEM.fullmatch(word)
        if not m:
            return self._rest(word)
        out = b""
        for part, learn in ((m[1], self._stem), (m[2], self._rest)):
            if part:
                got = self.parts.get(part)
                if got is None:
                    got = learn(part)
                    if len(part) <= LONG_WORD:
                        self.parts[part] = got
                out += got
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known = Known(self, self.known)
        if len(self.parts) > WORDS:
            self.parts = {}
        of = self.known.__getitem__
        return [b"".join(map(of, t.replace("\n", " ").split(" "))) for t in texts]

    def whole(self, text: str) -> bytes:
        """The ids of one text of any length."""
        out, at = [], 0
        while at < len(text):
            cut = BREAK.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            out += self([text[at:end]])
            at = end
        return b"".join(out)


_ids: dict[str, WordIds] = {}


class Rooms:
    """Open windows by their remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int):
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, window: list):
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, list] | None:
        """The window with the least room that is at least need, taken out, and its room."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """Pieces (doc_id, start, ids, doc_tokens), each of at most size ids -> windows as lists of them."""
    rooms, out = Rooms(size), []
    for p in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is not None, p[0] or 0, p[1], p[2])):
        n = len(p[2]) // 4
        got = rooms.tightest(n)
        if got is None:
            got = size, []
            out.append(got[1])
        got[1].append(p)
        rooms.put(got[0] - n, got[1])
    return out


def filled(window: list[tuple]) -> int:
    return sum(len(p[2]) for p in window) // 4


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)


def topped_up(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """The same pieces in full windows, and the rest in windows of powers of two."""
    windows = sorted(([*w] for w in windows), key=filled, reverse=True)
    out, first = [], 0
    while first < len(windows) - 1:
        room, last = size - filled(windows[first]), windows[-1]
        while room and last:
            piece = last.pop()
            n = len(piece[2]) // 4
            if n > room:
                piece, rest = cut(piece, room)
                last.append(rest)
            windows[first].append(piece)
            room -= min(n, room)
        if not last:
            windows.pop()
        if not room:
            out.append(windows[first])
            first += 1
    for window in windows[first:]:
        left, n = filled(window), size
        while left:
            if n <= left:
                left -= n
                out.append([])
                room = n
                while room:
                    piece = window.pop(0)
                    if len(piece[2]) // 4 > room:
                        piece, rest = cut(piece, room)
                        window.insert(0, rest)
                    out[-1].append(piece)
                    room -= len(piece[2]) // 4
            n //= 2
    return out


def _pack(path: str, size: int, end_id: int, slack: int):
    def run(batches):
        ids_of, end = _ids.get(path) or _ids.setdefault(path, WordIds(path)), np.array([end_id], "<u4").tobytes()
        sequence, held, n_held, rows = TaskContext.get().partitionId() << 40, [], 0, []

        def give(window: list[tuple]):
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def told():
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                short = iter(ids_of([t for t in texts if len(t) <= STRETCH]))
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    ids = (next(short) if len(text) <= STRETCH else ids_of.whole(text)) + end
                    total, whole = len(ids) // 4, len(ids) // 4 // size * size
                    for start in range(0, whole, size):
                        give([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
                        if len(rows) >= ROWS:
                            yield told()
                    if whole < total:
                        held.append((doc_id, whole, ids[4 * whole :], total))
                        n_held += total - whole
                if n_held >= HELD:
                    waiting = []
                    for window in best_fit(held, size):
                        if size - filled(window) <= slack:
                            give(window)
                        else:
                            waiting += window
                    n_held = sum(len(p[2]) for p in waiting) // 4
                    if n_held >= HELD // 2:  # rests that do not go together
                        for window in topped_up(best_fit(waiting, size), size):
                            give(window)
                        waiting, n_held = [], 0
                    held = waiting
                if len(rows) >= ROWS:
                    yield told()
        windows = best_fit(held, size)
        for window in windows:
            if size - filled(window) <= slack:
                give(window)
        for window in topped_up([w for w in windows if size - filled(w) > slack], size):
            give(window)
            if len(rows) >= ROWS:
                yield told()
        if rows:
            yield told()

    return run


def packed(docs: DataFrame, path: str, size: int = WINDOW, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start (ids of its document before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (its place there)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(path, size, end_id, slack), PIECES)


def report(docs: DataFrame, path: str) -> DataFrame:
    """packed(), with a checksum in place of the ids."""
    return packed(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
