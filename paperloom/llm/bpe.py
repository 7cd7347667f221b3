"""BPE encoding by a traversal of the trie of distinct words, and decoding.

An encoding of a prefix is its longest known state: the last token and the state before that token. The last token of a
prefix is the one token that ends it, is its own encoding, and may follow the last token before it (two tokens may
follow each other if merging their symbols anew would give just them). So each state follows from those above it in the
trie, and prefixes that words share are encoded once. A word's last symbol carries the end mark, hence leaves are
complete words.

The tokenizer file (path parameter) gives vocabulary, merges, end mark and special tokens. Text is split at its special
tokens, composed (NFC), lower-cased by code point, and cut into words. A worker remembers the encodings of the last CACHE to 2 * CACHE words, until a task of another kind begins.
The file's rules go by the Unicode tables of the tokenizers library, which are older or newer than those of the modules
here for some code points; these are stated below and take their own way. A word's cost is linear in its length: of a
prefix only its last symbols, as many as the longest token has, are ever looked at.

Defined cases: null text is an empty text, with no ids and an empty decoding; other columns are not read; repeated rows
are encoded alike; an empty table gives an empty table.
"""

import gc
import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import textbytes as tb

CACHE, LONG_WORD, BATCH_BYTES, PAIRS = 120_000, 64, 1 << 20, 250_000
#: Fixed values of the tokenizer file's rules; white space is Unicode's, without the separators 0x1C to 0x1F.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
#: Letters and numbers of the regex module that are neither to the tokenizer.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Marks that composition here orders or joins, but to the tokenizer stand still like letters.
STILL = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070"
    "\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47"
    "\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f"
    "\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
#: Lower case that str.lower does not know yet.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
ODD = re.compile(f"[{LATER}{STILL}{''.join(map(chr, LOWER))}]")
#: All odd code points lie from the first of LATER on, where few texts have any.
FAR = re.compile("[^\x00-\u0557]")
STILL_ONE = regex.compile(f"([{STILL}])")
ODD_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATER}]]+|[\p{{N}}--[{LATER}]]|[[^{SPACE}\p{{L}}\p{{N}}]||[{LATER}]]+", regex.V1)


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next unused one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        text_of = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        # tokens as decimal ids, and as decoding gives them back: joined by spaces, as files without a decoder say
        self.number, self.text = {t: str(i) for t, i in self.ids.items()}, {t: text_of[i] for t, i in self.ids.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.begun = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.longest = max(map(len, self.ids), default=1)
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.joined = self.rank
        self.halves = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.made = {t: self.rank[self.halves[t]] if t in self.halves else -1 for t in self.ids}
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if len(token) > len(self.end) else token
        return [*body[:-1], body[-1] + token[len(body) :]]

    def merged(self, parts: list[str]) -> list[str]:
        """Plain merging, lowest rank and leftmost first; only for one or two tokens."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def may_follow(self, before: str | None, token: str) -> bool:
        """Whether token stands by itself after before: no merge across their border comes ahead of those inside them.

        The symbols at the border are undone in turn, the later made of both first; a merge of the two that then stand
        there counts if it comes before the step that is undone."""
        if before is None:
            ok = self.alone.get(token)
            if ok is None:
                ok = self.alone[token] = self.merged(self.symbols(token)) == [token]
            return ok
        made, halves, joined, bar = self.made, self.halves, self.joined, 1 << 60
        a, b = before, token
        while True:
            if joined.get((a, b), 1 << 60) < bar:
                return False
            x, y = made[a], made[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                bar, a = x, halves[a][1]
            else:
                bar, b = y + 1, halves[b][0]

    def stands(self, pair: tuple[str | None, str]) -> bool:
        """may_follow, remembered."""
        if len(self.follows) > PAIRS:
            self.follows.clear()
        ok = self.follows[pair] = self.may_follow(*pair)
        return ok

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Words of byte symbols, without end mark -> their tokens.

        In the trie a word hangs where no other shares its way any more; its end, where others go on, is under None. A node
        is a word that goes through it, which gives its prefix, and what comes below. It is entered with the places,
        ascending, from where the prefix still begins a token, and those of the prefix before it; states holds the states of
        all prefixes above. The way down is a list, so that words of any length share prefixes of any length."""
        trie: dict = {}
        for w in words:
            node, i, n = trie, 0, len(w)
            while True:
                below = node.get(w[i])
                if below is None:
                    node[w[i]] = w
                    break
                if below.__class__ is str:
                    below = node[w[i]] = (below, {below[i + 1] if len(below) > i + 1 else None: below})
                node, i = below[1], i + 1
                if i == n:
                    node[None] = w
                    break
        ids, begun, follows, end, stands = self.ids, self.begun, self.follows, self.end, self.stands
        out: dict[str, list[str]] = {}
        states: list[tuple | None] = [None]

        def after(starts: list[int], word: str, to: int, live: list[int]) -> tuple | None:
            """The state of word[:to]; the starts from which that begins a token are added to live."""
            last = None
            for k in starts:
                token = word[k:to]
                if token in begun:
                    live.append(k)
                    if last is None and token in ids:
                        before = states[k]
                        pair = (before and before[0], token)
                        ok = follows.get(pair)
                        if stands(pair) if ok is None else ok:
                            last = (token, before)
            live.append(to)
            return last

        def complete(starts: list[int], word: str):
            for k in starts:
                token = word[k:] + end
                if token in ids:
                    before = states[k]
                    pair = (before and before[0], token)
                    ok = follows.get(pair)
                    if stands(pair) if ok is None else ok:
                        out[word] = self.tokens((token, before), word)
                        return
            raise ValueError(f"no token ends {word!r}")

        way: list[tuple] = [(iter(trie.items()), [0], [])]
        while way:
            items, starts, above = way[-1]
            for symbol, below in items:
                if symbol is None:
                    complete(above, below)
                elif below.__class__ is str:  # the rest of one word
                    depth, at = len(states), starts
                    for to in range(depth, len(below)):
                        live: list[int] = []
                        states.append(after(at, below, to, live))
                        at = live
                    complete(at, below)
                    del states[depth:]
                else:
                    live = []
                    states.append(after(starts, below[0], len(states), live))
                    way.append((iter(below[1].items()), live, starts))
                    break
            else:
                way.pop()
                states.pop()
        return out

    @staticmethod
    def tokens(state: tuple | None, word: str) -> list[str]:
        if state is None:
            raise ValueError(f"no token ends {word!r}")
        out = []
        while state:
            out.append(state[0])
            state = state[1]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, lower-cased by code point (a final sigma is as any)."""
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        if FAR.search(text) and ODD.search(text):
            text = "".join([unicodedata.normalize("NFC", part) for part in STILL_ONE.split(text)]).replace("\u03a3", "\u03c3")
            return ODD_WORD.findall(text.translate(LOWER).lower())
        return WORD.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def learn(self, words: set[str]) -> dict[str, tuple[str, int, str]]:
        """Ids as text, their number and the decoding of each word."""
        symbols = {w: "".join([self.bytes[b] for b in w.encode("utf-8", "surrogatepass")]) for w in words}
        gc.disable()  # tries and states are many and hold no cycles
        try:
            tokens = self.encode_words(set(symbols.values()))
        finally:
            gc.enable()
        number, text = self.number, self.text
        return {w: (" ".join([number[x] for x in t]), len(t), " ".join([text[x] for x in t])) for w, s in symbols.items() for t in (tokens[s],)}

    def split(self, text: str) -> list[str]:
        """Words, and special tokens (upper case or not, they are no words) as they stand."""
        if self.specials and self.specials.search(text):
            out = []
            for i, part in enumerate(self.specials.split(text)):
                out += [(part,)] if i % 2 else self.words(part)
            return out
        return self.words(text)

    def encode_batch(self, texts: list[str]):
        """For each text: ids as text, their number, the decoded text."""
        cut = [self.split(t) for t in texts]
        here = {}
        new = set()
        for w in set().union(*cut):
            if isinstance(w, tuple):
                here[w] = (str(self.special[w[0]]), 1, w[0])
            elif got := self.known.get(w) or self.older.get(w):
                here[w] = got
            else:
                new.add(w)
        here |= self.learn(new)
        if len(self.known) > CACHE:  # the words of the last batches stay
            self.older, self.known = self.known, {}
        self.known.update((w, x) for w, x in here.items() if len(w) <= LONG_WORD and not isinstance(w, tuple))
        for words in cut:
            got = [here[w] for w in words]
            yield " ".join([x[0] for x in got]), sum([x[1] for x in got]), " ".join([x[2] for x in got])


def _encode(path: str):
    def run(batches):
        encoder = tb.KEPT.get(path) or tb.KEPT.setdefault(path, TrieEncoder(path))
        for batch in batches:
            text, at = batch.column("text"), 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + sizes[end] <= BATCH_BYTES):
                    size += sizes[end]
                    end += 1
                rows = list(encoder.encode_batch([t or "" for t in text.slice(at, end - at).to_pylist()]))
                ids, n, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                at = end

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids (decimal, joined by one space), decoded."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path), "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encoded(), with digests in place of ids and decoded text."""
    return encoded(docs, path).select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
