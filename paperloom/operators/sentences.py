"""Sentences of texts, and of what a text mentions the sentences that it was read in."""

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A sentence under SHORT characters takes the next one with it; of a longer context than MOST the part
#: around the mention counts; a paper has at most CONCEPTS concepts, a concept at most MENTIONS mentions.
SHORT, MOST, CONCEPTS, MENTIONS = 120, 1000, 30, 3
#: A sentence ends with its stops, what closes after them and white space, or with a line. No run is looked at twice.
END = re.compile(r"(?<![.!?])[.!?]++[\"')\]]*+[ \t\r\n]++|\n[ \t\r\n]*+")
BLANK = " \t\r\n"


def spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence, in code points, without the white space around it; blank ones are none."""
    at = 0
    for to in [*(m.end() for m in END.finditer(text)), len(text)]:
        part = text[at:to]
        start = at + len(part) - len(part.lstrip(BLANK))
        end = at + len(part.rstrip(BLANK))
        if start < end:
            yield start, end
        at = to


@F.udtf(returnType="n int, start int, end int", useArrow=True)
class Sentences:
    """sentences(text): number (from 0), start and end of each sentence; a null text has none."""

    def eval(self, text: str):
        for n, (start, end) in enumerate(spans(text or "")):
            yield n, start, end


@F.udtf(returnType="start int, word string", useArrow=True)
class Matches:
    """matches(text, pattern): start and text of each match of a Python pattern, leftmost and without overlap."""

    def eval(self, text: str, pattern: str):
        for m in re.finditer(pattern, text or ""):
            yield m.start(), m[0]


def register(spark: SparkSession) -> None:
    """Makes sentences(text) and matches(text, pattern) known to SQL, for use after LATERAL."""
    spark.udtf.register("sentences", Sentences)
    spark.udtf.register("matches", Matches)


def context(text: str, begins: list[int], ends: list[int], start: int, size: int) -> str:
    """The sentence that holds the mention, with the next one if it is short; of a long one the part around the mention."""
    i = max(0, bisect_right(begins, start) - 1)
    a = begins[i]
    b = ends[i + 1] if ends[i] - a < SHORT and i + 1 < len(ends) else ends[i]
    if b - a > MOST:
        a += max(0, min(start - a + size // 2 - MOST // 2, b - a - MOST))
        b = a + MOST
    return text[a:b]


#: predicates.usable_mention in Python: white space, words and line ends as Java's patterns have them.
TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")
WORD = re.compile("[A-Za-z][a-z]{2,}[.,;:)]?[\x85\u2028\u2029]?")


def usable(word: str, sentence: str, defined: bool) -> bool:
    """Whether predicates.usable_mention holds."""
    if not defined and len(re.sub("[^A-Za-z0-9]", "", word)) <= 3:
        return False
    tokens = TOKEN.findall(sentence)
    return bool(tokens) and 2 * sum(WORD.fullmatch(t) is not None for t in tokens) >= len(tokens)


def contexts(texts: DataFrame, mentions: DataFrame, each: int | None = None) -> DataFrame:
    """texts (paper_id, text), mentions (paper_id, concept, confidence, start, word, defined) -> mentions with sentence.

    With each, only the usable ones that may count: the surest of a concept in a sentence, for the first `each` sentences.
    A paper's mentions travel to its text as one list, which is no longer than the text that it stands beside; the
    sentences leave in batches. Mentions of papers without a text, or in a blank one, go."""
    names = ["paper_id", "concept", "confidence", "start", "word", "defined", "sentence"]
    listed = mentions.groupBy("paper_id").agg(F.collect_set(F.struct(*names[1:6])).alias("ms"))

    def of_paper(text, ms):
        found = list(spans(text))
        if not found:
            return
        begins, ends = map(list, zip(*found, strict=True))
        if each is not None:
            ms = sorted(ms, key=lambda m: (-m["confidence"], m["start"], m["word"]))
        taken: dict[str, list[str]] = {}
        for m in ms:
            mine = taken.setdefault(m["concept"], [])
            if each is not None and len(mine) >= each:
                continue
            s = context(text, begins, ends, m["start"], len(m["word"]))
            if each is None:
                yield m, s
            elif s not in mine and usable(m["word"], s, m["defined"]):
                mine.append(s)
                yield m, s

    def run(batches):
        for batch in batches:
            rows = []
            for paper, text, ms in zip(batch["paper_id"], batch["text"], batch["ms"], strict=True):
                for m, s in of_paper(text, ms):
                    rows.append((paper, m["concept"], m["confidence"], m["start"], m["word"], m["defined"], s))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    rows = texts.where("text is not null").select("paper_id", "text").join(listed, "paper_id")
    kinds = {f.name: f.dataType.simpleString() for f in mentions.schema}
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names[:6]) + ", sentence string")


def surest_concepts(mentions: DataFrame, least: float, top: int = CONCEPTS) -> DataFrame:
    """paper_id, concept and its surest confidence: `top` of a paper, equal ones in the order of their first mention."""
    by = mentions.where(F.col("confidence") >= least).groupBy("paper_id", "concept").agg(F.max("confidence").alias("surest"), F.min("start").alias("first"))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("surest"), "first", "concept"))
    return by.withColumn("n", n).where(F.col("n") <= top).select("paper_id", "concept", "surest")


def surest_mentions(texts: DataFrame, mentions: DataFrame, least: float, top: int = CONCEPTS, each: int = MENTIONS) -> DataFrame:
    """paper_id, concept, surest, confidence, word, sentence, place: of each of a paper's surest concepts up to `each` usable
    mentions, the surest first and then in the order of the text, no two from the same sentence. A concept without a usable
    mention stays, with nulls."""
    chosen = surest_concepts(mentions, least, top)
    of_chosen = mentions.where(F.col("confidence") >= least).join(chosen.select("paper_id", "concept"), ["paper_id", "concept"], "left_semi")
    first = contexts(texts, of_chosen, each).groupBy("paper_id", "concept", "sentence").agg(F.min(F.struct((-F.col("confidence")).alias("o"), "start", "word")).alias("m"))
    n = F.row_number().over(Window.partitionBy("paper_id", "concept").orderBy("m"))
    best = first.withColumn("place", n).where(F.col("place") <= each)
    best = best.select("paper_id", "concept", (-F.col("m.o")).alias("confidence"), "m.word", "sentence", "place")
    return chosen.join(best, ["paper_id", "concept"], "left")
