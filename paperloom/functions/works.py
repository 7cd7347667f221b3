"""Projections of works and papers: slim works, cards, texts for embedders and prompts, event lines."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from paperloom.functions import text as T
from paperloom.operators import predicates

#: Sections in their order, what marks where a text's reading starts, words of a passage.
SECTIONS, LEAD, PASSAGE_WORDS = ("title", "abstract", "mesh", "keywords", "substances", "body"), "\x0b", 500
TOPICS, CONCEPTS = 5, 8


def n_words(c: Column) -> Column:
    return F.size(T.word_array(c))


def embedding_text(most: int = 512) -> Column:
    """Labelled sections of the columns SECTIONS, at most `most` words with their labels.

    Over that, body, substances, keywords and mesh go in this order, then the abstract is cut; the title never is.
    Without an abstract, as much of the body's beginning comes back as there is room for."""
    have = {s: F.coalesce(F.col(s), F.lit("")) for s in SECTIONS}
    size = {s: F.when(c != "", n_words(c) + 1).otherwise(0) for s, c in have.items()}
    upto = lambda *names: sum((size[n] for n in names[1:]), size[names[0]])
    # a section stays if all that stays with it fits
    stays = {s: upto(*SECTIONS[: i + 1]) <= most for i, s in enumerate(SECTIONS)}
    cut = lambda c, n: F.array_join(F.slice(T.word_array(c), 1, F.greatest(n, F.lit(0)).cast("int")), " ")
    abstract = F.when(stays["abstract"], have["abstract"]).otherwise(cut(have["abstract"], most - size["title"] - 1))
    kept = {s: F.when(stays[s], size[s]).otherwise(0) for s in ("mesh", "keywords", "substances")}
    room = most - size["title"] - kept["mesh"] - kept["keywords"] - kept["substances"] - 1
    body = F.when(stays["body"], have["body"]).when(have["abstract"] == "", cut(have["body"], room)).otherwise("")
    final = {"title": have["title"], "abstract": abstract, "body": body} | {s: F.when(stays[s], have[s]).otherwise("") for s in kept}
    return F.concat_ws("\n\n", *[F.when(final[s] != "", F.concat(F.lit(f"{s.upper()}: "), final[s])) for s in SECTIONS])


def lead_text(body: Column) -> Column:
    """The text from its mark on, past what a first page prints before; without a mark, as it is."""
    body = F.coalesce(body, F.lit(""))
    at = F.instr(body, f"\n{LEAD}\n")
    inner = F.ltrim(body.substr(at + 3, F.length(body)), F.lit("\n"))
    return F.when(at > 0, inner).when(body.startswith(f"{LEAD}\n"), body.substr(F.lit(3), F.length(body))).otherwise(body)


def paper_text(abstract: Column, body: Column, limit: int) -> Column:
    """The abstract, or so many characters from where the body's reading starts."""
    filled = F.regexp_replace(F.coalesce(abstract, F.lit("")), r"\s+", "") != ""
    return F.when(filled, abstract).otherwise(lead_text(body).substr(1, limit))


def concept_text(title: Column, abstract: Column, body: Column, limit: int) -> Column:
    head, rest = F.trim(F.coalesce(title, F.lit(""))), paper_text(abstract, body, limit)
    return F.when((head != "") & (rest != ""), F.concat(head, F.lit("\n\n"), rest)).when(head != "", head).otherwise(rest)


def around(text: Column, at: Column, n: int) -> Column:
    """The text, or its n characters centred on a place."""
    start = F.greatest(F.lit(0), F.least(at - n // 2, F.length(text) - n))
    return F.when(F.length(text) <= n, text).otherwise(text.substr(start + 1, F.lit(n)))


def topic_text(name: Column, description: Column, keywords: Column) -> Column:
    """Name, description and keywords (display_name, score), the higher-scored first, equal ones in their order."""
    by = F.array_sort(F.transform(keywords, lambda k, i: F.struct((-F.coalesce(k["score"], F.lit(0.0))).alias("s"), i.alias("i"), k["display_name"].alias("n"))))
    words = F.array_join(F.filter(F.transform(by, lambda k: k["n"]), lambda n: n != ""), "; ")
    head = F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(". "), F.coalesce(description, F.lit(""))))
    return F.when(words != "", F.concat(head, F.lit(" Keywords: "), words)).otherwise(head)


def slim(works: DataFrame) -> DataFrame:
    """Raw works with what is kept of them: five topics, eight concepts, the best open PDF or else the publisher's."""
    pdf = F.coalesce("best_oa_location.pdf_url", "primary_location.pdf_url")
    out = works.withColumn("pdf_url", pdf).withColumn("topics", F.slice("topics", 1, TOPICS)).withColumn("top_concepts", F.slice("concepts", 1, CONCEPTS))
    return out.withColumn("venue", F.col("primary_location.source.display_name")).drop("concepts", "best_oa_location", "primary_location")


def paper_of(slim_works: DataFrame) -> DataFrame:
    """Slim works as papers: bare DOI, named authors, and the abstract out of its index."""
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    out = slim_works.withColumn("doi", F.regexp_replace("doi", r"^https://doi\.org/", "")).withColumn("authors", names)
    return out.withColumn("abstract", T.inverted_text(F.col("abstract_inverted_index"))).drop("authorships", "abstract_inverted_index")


def cards(rows: DataFrame) -> DataFrame:
    """Candidates joined with their papers (primary_topic, topics, active, score_pct, score_raw, score, abstract,
    publication_date, year, threshold, seed_sim_min) as cards."""
    all_topics = F.filter(F.concat(F.array("primary_topic"), "topics"), lambda t: t.isNotNull())
    named = lambda ts: F.array_distinct(F.filter(F.transform(ts, lambda t: t["display_name"]), lambda n: n.isNotNull() & (n != "")))
    on = F.filter(all_topics, lambda t: F.array_contains("active", t["id"]))
    ids = F.array_distinct(F.filter(F.transform(all_topics, lambda t: t["id"]), lambda i: i.isNotNull()))
    score = F.coalesce("score_pct", "score")
    date = F.coalesce(F.nullif("publication_date", F.lit("")), F.concat(F.col("year").cast("string"), F.lit("-01-01")), F.lit(""))
    match = F.when((F.size("active") > 0) & (F.size(ids) > 0), F.round(F.size(F.array_intersect(ids, "active")) / F.size(ids), 3)).otherwise(0.0)
    return rows.select(
        "paper_id",
        date.alias("date"),
        T.floor4(score).alias("score"),
        T.floor4(F.col("score_raw")).alias("similarity"),
        T.floor4(F.coalesce("score_raw", score)).alias("centroid_cos"),
        predicates.bucket(F.col("score_raw"), F.col("threshold"), F.col("seed_sim_min"), score).alias("bucket"),
        named(all_topics).alias("terms"),
        named(on).alias("matched"),
        match.alias("topic_match"),
        F.when(F.coalesce("abstract", F.lit("")) == "", 2).otherwise(T.read_minutes(F.col("abstract"))).alias("mins"),
    )


def event_line() -> Column:
    """Columns ts, action, title, doi, paper_id, score as one line of a log."""
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    who = F.coalesce(F.nullif(title, F.lit("")), F.nullif("doi", F.lit("")), F.col("paper_id"), F.lit("?"))
    score = F.when(F.col("score").isNotNull(), F.format_string("score=%.3f", "score")).otherwise("score=NA")
    return F.concat_ws("  ", F.substring(F.coalesce("ts", F.lit("")), 1, 16), F.upper(F.coalesce("action", F.lit(""))), who, score)


def prompts(chunks: DataFrame, key: str, order: str, question: str) -> DataFrame:
    """chunks (title, text) of each key as numbered passages, long ones cut, and the question below."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    words = T.word_array(text)
    body = F.when(F.size(words) <= PASSAGE_WORDS, text).otherwise(F.concat(F.array_join(F.slice(words, 1, PASSAGE_WORDS), " "), F.lit(" …")))
    title = F.coalesce(F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.lit("untitled"))
    lines = chunks.select(key, F.struct(F.col(order).alias("o"), F.concat(title, F.lit(" — "), body).alias("t")).alias("l")).groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    numbered = F.transform("ls", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"]))
    return lines.select(key, F.concat(F.lit("Passages:\n"), F.array_join(numbered, "\n"), F.lit(f"\n\nQuestion: {question}")).alias("prompt"))


def _unit(text: str | None, size: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).normal(size=size)
    return v / np.linalg.norm(v)


def unit_normal(text: str, size: int = 128) -> list[float]:
    """A vector of length 1 that depends on nothing but the text."""
    return _unit(text, size).tolist()


def unit_normals(text: pa.Array, size: int = 128) -> pa.Array:
    """unit_normal() of each text, in one buffer: a number takes eight bytes and no object of its own."""
    out = np.empty((len(text), size))
    for i, t in enumerate(text):
        out[i] = _unit(t.as_py(), size)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * size), pa.array(out.reshape(-1)))


@F.arrow_udf(ArrayType(DoubleType()))
def placeholder_vector(text: pa.Array) -> pa.Array:
    return unit_normals(text)
