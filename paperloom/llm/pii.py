"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

Base kinds (always kept, whatever their score): email; ip with parts up to 255; card of 13 to 19 digits passing Luhn;
phone of 9 to 15 digits. Added kinds: iban, confirmed by mod 97; national (3-2-4 digits), kept only with a context word.
Spans are code points, end exclusive; order is by kind as listed, then start. Matches are leftmost and do not overlap
within a kind; those that fail a check are dropped without another try.

Defined cases: null text has no spans; rows are judged one by one, repeated ones alike; a null doc_id is kept; an empty
table gives an empty table; other columns are not read.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spans import SPANS, digest, listing, number

BASE, ADDED = ["email", "ip", "card", "phone"], ["iban", "national"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
# no match can begin inside a run of digits where the run's own start failed, hence the look behind
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Context words (fixed values), the score without and what a word adds, the least score of added kinds.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national": ("ssn", "social", "security", "identity"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.4}
BONUS, LEAST, REACH = 0.2, 0.6, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Leftmost matches, from each @ in turn: the run of local characters before it that no match has used, and a domain."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = used + len(text[used:at].rstrip(LOCAL)) if at > used else at
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            used = m.end()
        else:
            used = max(used, at + 1)
        at = text.find("@", used)


def proposals(text: str):
    """Confirmed (kind, start, end), by kind, then start."""
    if "@" in text:
        yield from (("email", s, e) for s, e in emails(text))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in NATIONAL.finditer(text):
        yield "national", m.start(), m.end()


def find(text: str) -> list[tuple[str, int, int, float]]:
    out = []
    for kind, s, e in proposals(text):
        near = (text[max(0, s - REACH) : s] + " " + text[e : e + REACH]).lower()
        score = PRIOR[kind] + BONUS * any(re.search(rf"\b{w}", near) for w in CONTEXT[kind])
        if kind in BASE or score >= LEAST:
            out.append((kind, s, e, round(min(score, 1.0), 3)))
    return out


def _find(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        rows = []
        for t in batch.column("text"):
            found = find(t.as_py() or "")
            rows.append([dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in found])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans (kind, start, end, score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_find, f"doc_id long, spans {SPANS}")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and listing of the spans of each document, and scores, of each span in that order."""
    s = F.col("spans")
    scores = F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 4)), ",")
    return personal_data(docs).select("doc_id", *[number(s, k).alias(f"n_{k}") for k in BASE], digest(s, BASE).alias("base_sha256"), listing(s).alias("spans"), scores.alias("scores"))
