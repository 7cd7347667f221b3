"""Secret scan: a character convolutional network over every candidate and its surroundings.

Base spans (always kept): assign (a keyword, a separator and 12 or more value characters), access (AKIA and 14 or more)
and hex (16 or more of 0-9a-f), leftmost and not overlapping within a kind, in code points, ordered by start, then kind.
Candidates are the base spans; near misses of the patterns (assigned values of SHORT or more characters, AKIA runs of
ACCESS_SHORT or more); and of every run of A-Z a-z 0-9 + / _ = - the parts outside those, if RUN or more characters with
a letter. The network scores each from its characters and REACH characters on both sides (long candidates by their best
window); a candidate that is no base span is added as kind `model` if its calibrated score reaches the threshold.

Training: all labelled findings of all documents, equal ones once, all words of the corpus (of each its least place), and
GENERATED made ones from a fixed seed. Of the documents, base spans are positive, except hexadecimal ones beside a word that
tells of a digest, which are negative. A candidate of letters alone, of one case but for its first, that nothing is assigned
to is a word of the corpus and negative, since long words far outnumber keys of such letters; other candidates have no
label. Made positives are random keys, also of letters alone and short, with and without keywords; made negatives are long
words, identifiers, paths, dates, digests, rulers and assigned plain words.

Two thirds (by hash) fit the network (Adam, cross-entropy) by parameter mixing: they are dealt by hash into shards of about
SHARD findings, each of which holds the made ones too; in each of ROUNDS rounds a task takes a shard once, from the common
parameters, and the mean of what the shards come to is the next common state. A finding is one example, by its first window.
The other third calibrates the output (logistic fit) and sets the threshold: all its logits, in steps of 1 / GRID, are
counted by label, and these counts are all that the driver sees. Made ones weigh there as they do in the fit, once for each
shard; the threshold is the largest that keeps RECALL of the corpus' positives and of the made ones.

Defined cases: null text is empty; rows are judged one by one, repeated ones alike; a null doc_id is kept; an empty table
gives an empty table (the network then trains on made findings alone); other columns are not read.
"""

import random
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from paperloom.llm import textbytes as tb
from paperloom.llm.spans import SPANS, digest, listing, number
from paperloom.llm.store import saved

KINDS = ["assign", "access", "hex"]
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
RUN, SHORT, ACCESS_SHORT, REACH, WINDOW, RECALL, GENERATED = 16, 6, 12, 24, 48, 0.96, 3000
#: Findings of a shard, passes over all, steps of a logit and the largest one that is told apart.
SHARD, ROUNDS, GRID, LARGEST = 4096, 16, 256, 64
#: Words beside which a hexadecimal run is a digest.
DIGESTS = re.compile(r"\b(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|revision|rev|uuid)\b", re.IGNORECASE)
HEX, TOKEN = np.zeros(256, bool), np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
ANY_LETTER = re.compile("[A-Za-z]")


def _texts_with(buf: bytes, needle: bytes, offs: np.ndarray) -> set[int]:
    out, at = set(), buf.find(needle)
    while at >= 0:
        doc = int(np.searchsorted(offs, at, "right")) - 1
        out.add(doc)  # a find across two texts only costs a look
        at = buf.find(needle, int(offs[doc + 1]) if at + len(needle) <= offs[doc + 1] else at + 1)
    return out


def _outside(start: int, end: int, starts: list[int], ends: list[int]):
    """What is left of a stretch outside others, which ascend and do not overlap."""
    i = bisect_right(ends, start)
    while start < end:
        until = min(end, starts[i]) if i < len(starts) else end
        if until > start:
            yield start, until
        if i == len(starts):
            return
        start, i = max(start, ends[i]), i + 1


def _joined(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that (start, kind, end) cover together; touching ones stay apart or not alike."""
    starts, ends = [], []
    for s, _, e in sorted(found):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, hexes: list, runs: list, keyed: bool, access: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, from the places of hexadecimal and token runs and whether the others may be there."""
    base = [(s, 2, e) for s, e in hexes]
    near = []
    if keyed:
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= 12:
                base.append((m.start(), 0, m.end()))
            elif len(m[1]) >= SHORT:
                near.append((m.start(), m.end()))
    if access:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                base.append((m.start(), 1, m.end()))
            elif len(m[0]) >= ACCESS_SHORT:
                near.append((m.start(), m.end()))
    at = _joined(base)
    for s, e in near:  # only whole near misses
        if list(_outside(s, e, *at)) == [(s, e)]:
            base.append((s, 3, e))
    at = _joined(base)
    base += [(s, 3, e) for x, y in runs for s, e in _outside(x, y, *at) if e - s >= RUN and ANY_LETTER.search(text, s, e)]
    return sorted(base)


def _look(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("token", pa.string()), ("after", pa.string())])
    for batch in batches:
        rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for at, _, buf, offs in tb.pieces(batch.column("text")):
            raw = buf.tobytes()
            lower = tb.LOWER[buf].tobytes()
            keyed = set().union(*(_texts_with(lower, k, offs) for k in KEYWORDS))
            access = _texts_with(raw, b"AKIA", offs)
            point = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
            places: list[dict[int, list]] = [{}, {}]
            for of, mask in zip(places, (HEX, TOKEN), strict=True):
                s, e = tb.runs(mask[buf], offs)
                s, e = s[e - s >= RUN], e[e - s >= RUN]
                d = np.searchsorted(offs, s, "right") - 1
                first = point[offs[d]]
                for doc, x, y in zip(d.tolist(), (point[s] - first).tolist(), (point[e] - first).tolist(), strict=True):
                    of.setdefault(doc, []).append((x, y))
            for doc in keyed | access | set(places[0]) | set(places[1]):
                text = raw[offs[doc] : offs[doc + 1]].decode()
                found = candidates(text, places[0].get(doc, []), places[1].get(doc, []), doc in keyed, doc in access)
                rows[at + doc] = [{"kind": [*KINDS, "model"][k], "start": s, "end": e, "before": text[max(0, s - REACH) : s], "token": text[s:e], "after": text[e : e + REACH]} for s, k, e in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], ["doc_id", "found"])


FOUND = "array<struct<kind:string,start:int,end:int,before:string,token:string,after:string>>"


class CharNet:
    """Characters (embedded, with a mark on the candidate) -> convolution -> maximum and mean over places -> logit."""

    SYMBOLS, WIDTH, PLACES = 130, 5, WINDOW + 2 * REACH

    def __init__(self, seed: int = 11, embed: int = 8, filters: int = 24):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (self.SYMBOLS, embed)),
            "w": r.normal(0, 0.15, (self.WIDTH * (embed + 1), filters)),
            "b": np.zeros(filters),
            "v": r.normal(0, 0.2, 2 * filters),
            "c": np.zeros(1),
        }
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t, self.scale, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    @classmethod
    def coded(cls, before: str, token: str, after: str) -> tuple[np.ndarray, np.ndarray]:
        x, mark = np.zeros(cls.PLACES, np.int64), np.zeros(cls.PLACES)
        for at, text in ((REACH - len(before[-REACH:]), before[-REACH:]), (REACH, token), (REACH + len(token), after[:REACH])):
            x[at : at + len(text)] = [ord(c) + 1 if ord(c) < 128 else 129 for c in text]
        mark[REACH : REACH + len(token)] = 1
        return x, mark

    @classmethod
    def windows(cls, before: str, token: str, after: str) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(token) <= WINDOW:
            return [cls.coded(before, token, after)]
        cuts = [*range(0, len(token) - WINDOW, WINDOW // 2), len(token) - WINDOW]
        return [cls.coded((before + token[max(0, c - REACH) : c])[-REACH:], token[c : c + WINDOW], (token[c + WINDOW : c + WINDOW + REACH] + after)[:REACH]) for c in cuts]

    def forward(self, x: np.ndarray, mark: np.ndarray):
        p, n, places = self.p, len(x), self.PLACES - self.WIDTH + 1
        h = np.concatenate((p["e"][x], mark[:, :, None]), axis=2)
        wide = np.lib.stride_tricks.sliding_window_view(h, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n * places, -1)
        z = np.maximum(wide @ p["w"] + p["b"], 0).reshape(n, places, -1)
        top = z.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(axis=1)), axis=1)
        return pooled @ p["v"] + p["c"][0], (h, wide, z, top, pooled)

    def backward(self, x, kept, d):
        h, wide, z, top, pooled = kept
        p, n, places, filters = self.p, len(x), z.shape[1], z.shape[2]
        g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
        dp = d[:, None] * p["v"]
        dz = np.repeat(dp[:, None, filters:] / places, places, axis=1)
        np.put_along_axis(dz, top[:, None], np.take_along_axis(dz, top[:, None], 1) + dp[:, None, :filters], 1)
        dz = (dz * (z > 0)).reshape(n * places, filters)
        g["w"], g["b"] = wide.T @ dz, dz.sum(axis=0)
        dwide = (dz @ p["w"].T).reshape(n, places, self.WIDTH, -1)
        dh = np.zeros_like(h)
        for k in range(self.WIDTH):
            dh[:, k : k + places] += dwide[:, :, k]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x, dh[:, :, :-1])
        return g

    def fit(self, x, mark, y, rounds: int = ROUNDS, size: int = 64, rate: float = 0.01, seed: int = 5):
        r = np.random.default_rng(seed)
        for _ in range(rounds):
            order = r.permutation(len(x))
            for at in range(0, len(x), size):
                part = order[at : at + size]
                logit, kept = self.forward(x[part], mark[part])
                g = self.backward(x[part], kept, (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part))
                self.t += 1
                m, v, t = self.m, self.v, self.t
                for k in self.p:
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def state(self) -> np.ndarray:
        """Parameters, moments of the fit and its steps, as one vector."""
        of = [{k: np.broadcast_to(d.get(k, 0.0), a.shape) for k, a in self.p.items()} for d in (self.p, self.m, self.v)]
        return np.concatenate([d[k].ravel() for d in of for k in self.p] + [[self.t]])

    def at(self, state: np.ndarray):
        i = 0
        for d in (self.p, self.m, self.v):
            for k, a in [(k, self.p[k]) for k in self.p]:
                d[k] = state[i : i + a.size].reshape(a.shape).copy()
                i += a.size
        self.t = float(state[i])
        return self

    def calibrate(self, x, mark, y):
        return self.settle(self.snapped(self.forward(x, mark)[0]), np.asarray(y, float), np.ones(len(y)), np.zeros(len(y), int))

    def settle(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, kind: np.ndarray):
        """Logistic fit of logits z that occur n times with label y; kind: which of them must keep RECALL by themselves."""
        a, b, of = 1.0, 0.0, n / n.sum()
        for _ in range(400):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.1 * (((q - y) * z * of).sum() + 1e-3 * a), b - 0.1 * ((q - y) * of).sum()
        self.scale, self.shift = float(max(a, 0.05)), float(b)
        # the largest threshold that at least RECALL of the positives of each kind reach
        least = []
        for k in np.unique(kind[y == 1]):
            mine = (y == 1) & (kind == k)
            order = np.argsort(z[mine], kind="stable")
            upto = np.cumsum(n[mine][order])
            least.append(z[mine][order][np.searchsorted(upto, np.floor((1 - RECALL) * upto[-1]), "right")])
        self.threshold = float(self.squash(np.array(min(least)))) if least else 0.5
        return self

    @staticmethod
    def snapped(z):
        return np.clip(np.round(np.asarray(z) * GRID), -LARGEST * GRID, LARGEST * GRID) / GRID

    def squash(self, z):
        return 1 / (1 + np.exp(-np.clip(self.scale * self.snapped(z) + self.shift, -30, 30)))

    def logits(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        cut = [self.windows(*f) for f in found]
        flat = [w for c in cut for w in c]
        z = np.concatenate([self.forward(np.array([w[0] for w in flat[k : k + 256]]), np.array([w[1] for w in flat[k : k + 256]]))[0] for k in range(0, len(flat), 256)])
        return np.maximum.reduceat(z, np.cumsum([0, *map(len, cut)])[:-1])

    def score(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        return self.squash(self.logits(found))


#: Parts of made words.
PARTS = "inter nation al iz ation pro gram ming trans form ver sion con figur er ung schaft keit ment able ness port graph logy data base user name file path time stamp server client haupt verwalt infra struktur com mun ica res pons bil idad".split()


def made_findings(n: int = GENERATED, seed: int = 23) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, token, after, secret?) from a fixed seed."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    letters = lower + lower.upper()
    word = lambda k=0: "".join(r.choice(PARTS) for _ in range(k or r.randint(1, 3)))
    prose = lambda: " ".join(word() for _ in range(4))[-REACH:]
    key = lambda of, k: "".join(r.choice(of) for _ in range(k))
    keyword = lambda: r.choice(["password", "passwd", "token", "secret", "api_key", "TOKEN", "Secret", "auth", "key"])
    assigned = lambda: r.choice(["=", ": ", " = ", '="'])
    secret = [
        lambda: key(lower + digits, r.randint(16, 40)),
        lambda: key(letters + digits + "+/", r.randint(20, 44)) + "=" * r.randint(0, 2),
        lambda: key("0123456789abcdef", r.randint(16, 64)),
        lambda: "AKIA" + key(lower.upper() + digits, r.randint(12, 16)),
        lambda: key(lower.upper() + digits, r.randint(16, 32)),
        lambda: r.choice(["ghp_", "sk-", "xox-"]) + key(letters + digits, r.randint(20, 36)),
        lambda: key(letters, r.randint(16, 40)),
        lambda: key(lower, r.randint(16, 32)),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(4)) + str(r.randint(0, 99)),
        lambda: "_".join(word() for _ in range(4)),
        lambda: "/".join(["", word(), word(), f"{r.randint(1990, 2030)}", word()]),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}",
        lambda: word(r.randint(4, 7)) + str(r.randint(0, 9)) * r.randint(0, 1),
        lambda: word(r.randint(4, 8)),
        lambda: word(r.randint(4, 8)).capitalize(),
        lambda: "".join(word().capitalize() for _ in range(4)) + str(r.randint(0, 99)),
        lambda: "=" * 10 + word() + "=" * 10,
        lambda: r.choice("xyzab-_=") * r.randint(16, 60) + r.choice("ax"),
    ]
    out = []
    for i in range(n):
        before, after, kind = prose() + " ", " " + prose(), r.random()
        if i % 2:
            token = r.choice(secret)()
            if kind < 0.15:
                token = keyword() + assigned() + key(letters + digits, r.randint(SHORT, 11))
            elif kind < 0.5:
                before += keyword() + assigned()
        elif kind < 0.15:
            before += r.choice(["commit ", "sha256:", "sha1 ", "md5: ", "checksum ", "digest ", "etag ", "revision "])
            token = key("0123456789abcdef", r.choice([32, 40, 64]))
        elif kind < 0.25:
            token = (keyword() + assigned() + word(2))[: len("password = ") + 11]
        else:
            token = r.choice(plain)()
            token = token if len(token) >= RUN else token + word(4)
        out.append((before, token, after, i % 2))
    return out


def labelled(kind: str, before: str, after: str) -> int | None:
    """What a finding in a document is taken to be: 1 secret, 0 none, None unknown."""
    if kind == "model":
        return None
    return 0 if kind == "hex" and DIGESTS.search(f"{before} {after}") else 1


def plain_words(found: DataFrame, most: int | None = None) -> DataFrame:
    """before, token, after of the distinct candidates of the corpus that are words; of `most` at most, if given."""
    c = found.select(F.explode(F.filter("found", lambda s: s["kind"] == "model")).alias("c")).select("c.*")
    c = c.where(F.col("token").rlike("^(?:[A-Z]?[a-z]+|[A-Z]+)$") & ~F.col("before").rlike("[:=][\"' ]*$"))
    one = c.groupBy("token").agg(F.min(F.struct("before", "after")).alias("c"))
    one = one if most is None else one.orderBy(F.xxhash64("token"), "token").limit(most)
    return one.select("c.before", "token", "c.after")


def labelled_findings(found: DataFrame) -> DataFrame:
    """kind, before, token, after, h: every labelled finding of the corpus, equal ones once; h a hash of it."""
    base = found.select(F.explode(F.filter("found", lambda s: s["kind"] != "model")).alias("c")).select("c.kind", "c.before", "c.token", "c.after").distinct()
    every = base.unionByName(plain_words(found).withColumn("kind", F.lit("word")))
    return every.withColumn("h", F.xxhash64("kind", "before", "token", "after"))


def _label(kind: str, before: str, after: str) -> int:
    return 0 if kind == "word" else labelled(kind, before, after)


def _round(state: np.ndarray, turn: int, made: list[tuple[str, str, str, int]]):
    """Shards (shard, rows) -> shard and the state that one pass over it leads to from the common one."""

    def run(batches):
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                data = sorted((r["before"], r["token"], r["after"], _label(r["kind"], r["before"], r["after"])) for r in rows or [])
                data += made
                coded = [CharNet.windows(*d[:3])[0] for d in data]
                net = CharNet().at(state).fit(np.array([c[0] for c in coded]), np.array([c[1] for c in coded]), np.array([d[3] for d in data], float), 1, seed=turn)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([net.state()], pa.list_(pa.float64()))], ["shard", "state"])

    return run


def _held(net: CharNet):
    """Findings -> logit in steps of 1 / GRID, and label."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                z = net.snapped(net.logits([(r["before"], r["token"], r["after"]) for r in rows])) * GRID
                yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int64)), pa.array([_label(r["kind"], r["before"], r["after"]) for r in rows], pa.int64())], ["z", "y"])

    return run


def trained(found: DataFrame) -> CharNet:
    """found: rows (doc_id, found) of documents; the network from all their labelled findings and made ones."""
    spark, made = found.sparkSession, made_findings()
    fit, held = ([d for i, d in enumerate(made) if (i // 2 % 3 == 0) == out] for out in (False, True))
    every = saved(labelled_findings(found), "labelled")
    mine = every.where(F.pmod("h", F.lit(3)) != 0)
    n = max(1, -(-mine.count() // SHARD))
    # a first window and what follows it
    row = F.struct("kind", "before", F.substring("token", 1, WINDOW + REACH).alias("token"), "after")
    dealt = mine.groupBy(F.pmod(F.xxhash64("h"), F.lit(n)).cast("long").alias("shard")).agg(F.collect_list(row).alias("rows"))
    shards = saved(spark.range(n).toDF("shard").join(dealt, "shard", "left").repartition(n, "shard"), "shards")
    net = CharNet()
    for turn in range(ROUNDS):
        told = shards.mapInArrow(_round(net.state(), turn, fit), "shard long, state array<double>").select("shard", F.posexplode("state").alias("i", "x"))
        # summed in the order of the shards, so that reruns agree
        mean = told.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("shard", "x"))).alias("xs")).select("i", (F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["x"]) / n).alias("x"))
        net.at(np.array([r["x"] for r in sorted(mean.collect())]))
    counts = every.where(F.pmod("h", F.lit(3)) == 0).select("kind", "before", "token", "after").mapInArrow(_held(net), "z long, y long").groupBy("z", "y").count().collect()
    rows = [(r["z"] / GRID, r["y"], r["count"], 0) for r in counts]
    rows += [(z, d[3], n, 1) for z, d in zip(net.snapped(net.logits([d[:3] for d in held])), held, strict=True)]
    z, y, times, kind = (np.array(v) for v in zip(*sorted(rows), strict=True))
    return net.settle(z, y.astype(float), times.astype(float), kind)


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans (kind, start, end, score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = saved(docs.mapInArrow(_look, f"doc_id long, found {FOUND}"), "found")
    net = trained(found)

    @F.pandas_udf(ArrayType(DoubleType()))
    def scores(rows: pd.Series) -> pd.Series:
        flat = [(s["before"], s["token"], s["after"]) for r in rows for s in r]
        got = iter(net.score(flat).tolist()) if flat else iter(())
        return pd.Series([[next(got) for _ in r] for r in rows])

    scored = found.where("size(found) > 0").withColumn("score", scores("found"))
    spans = F.transform(F.arrays_zip("found", "score"), lambda z: F.struct(z["found"]["kind"].alias("kind"), z["found"]["start"].alias("start"), z["found"]["end"].alias("end"), z["score"].alias("score")))
    scored = scored.select("doc_id", F.filter(spans, lambda s: (s["kind"] != "model") | (s["score"] >= net.threshold)).alias("spans"))
    return scored.unionByName(found.where("size(found) = 0").select("doc_id", F.array().cast(SPANS).alias("spans")))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and listing of the spans of each document, and scores, the network's of each span in that order."""
    s = F.col("spans")
    scores = F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 4)), ",")
    return secret_spans(docs).select("doc_id", *[number(s, k).alias(f"n_{k}") for k in KINDS], digest(s, KINDS).alias("base_sha256"), listing(s).alias("spans"), scores.alias("scores"))
