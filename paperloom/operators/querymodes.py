"""The second stage's queries, in four modes, and a lexical scorer behind its interface: BM25 over the candidates' corpus."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.rerank import MOST_QUERIES
from paperloom.operators.resolve import cut

#: The modes; saturation of repeated words and weight of a text's length; pairs scored at a time by a model.
MODES, K1, B, PAIRS = ("topic", "title", "article", "terms"), 1.2, 0.75, 64
#: A word: letters and digits of ASCII, and all beyond it.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(c: Column) -> Column:
    """The words of a text, A to Z lower-cased; none of a null."""
    return F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def article_text(title: Column, abstract: Column, mode: str) -> Column:
    """A candidate as the scorer reads it: title and abstract joined by a full stop; in mode `article` by a line break, as
    the embedder reads papers."""
    t, a = F.nullif(title, F.lit("")), F.nullif(abstract, F.lit(""))
    return F.coalesce(F.concat_ws("\n" if mode == "article" else ". ", t, a), F.lit(""))


def queries_of(mode: str, topics: DataFrame, terms: DataFrame, seeds: DataFrame) -> DataFrame:
    """topics (profile, pos, name, is_on), terms (profile, pos, term), seeds (profile, pos, title, abstract) -> profile,
    query_no (from 0), query, source.

    topic: names of the topics switched on; terms: the profile's own terms, else its topics; article: whole seeds; title:
    titles of seeds, which also stand in where a mode has nothing for a profile. Null and empty texts are no queries; equal
    ones stay. At most MOST_QUERIES a profile by pos, which is the feature; ties by text."""
    if mode not in MODES:
        raise ValueError(mode)
    plain = lambda rows, text, source, turn: rows.select("profile", "pos", text.alias("query"), F.lit(source).alias("source"), F.lit(turn).alias("turn"))
    on = plain(topics.where(F.coalesce(F.col("is_on"), F.lit(True))), F.col("name"), "topic", 1)
    titles = plain(seeds, F.col("title"), "title", 2)
    offered = {
        "topic": lambda: on.unionByName(titles),
        "title": lambda: titles,
        "article": lambda: plain(seeds, article_text(F.col("title"), F.col("abstract"), "article"), "article", 0).unionByName(titles),
        "terms": lambda: plain(terms, F.col("term"), "terms", 0).unionByName(on).unionByName(titles),
    }[mode]()
    offered = offered.where(F.trim("query") != "")
    first = offered.groupBy("profile").agg(F.min("turn").alias("turn"))
    n = F.row_number().over(Window.partitionBy("profile").orderBy("pos", "query"))
    mine = offered.join(first, ["profile", "turn"]).withColumn("query_no", (n - 1).cast("long"))
    return mine.where(F.col("query_no") < MOST_QUERIES).select("profile", "query_no", "query", "source")


def query_key(queries: DataFrame) -> DataFrame:
    """profile, key: the fingerprint of a profile's queries; a logit of another key is stale."""
    q = F.array_sort(F.collect_list(F.struct("query_no", "query")))
    return queries.groupBy("profile").agg(F.sha2(F.to_json(F.transform(q, lambda x: x["query"])), 256).alias("key"))


def word_counts(articles: DataFrame) -> DataFrame:
    """articles (paper_id, text: each paper once) -> paper_id, length, word, tf; a text without words has no row."""
    w = articles.select("paper_id", words(F.col("text")).alias("w"))
    listed = w.select("paper_id", F.size("w").cast("long").alias("length"), F.explode("w").alias("word"))
    return listed.groupBy("paper_id", "length", "word").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, articles: DataFrame, members: DataFrame) -> DataFrame:
    """queries (profile, query_no, query), articles (paper_id, text: each paper once), members (profile, paper_id) ->
    profile, paper_id, query_no, logit of each query that shares a word with a member's text; the others' logit is 0.

    Frequencies and lengths are those of all articles. Query words, at most MOST_QUERIES texts a profile, come distinct with
    the queries that hold them, so that a text's words meet few rows; repeats in a query count once."""
    # texts are cut into words once; only words that are asked for leave their articles
    listed = cut(articles.select("paper_id", words(F.col("text")).alias("w")).withColumn("length", F.size("w").cast("long")))
    corpus = listed.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    asked = cut(queries.select("profile", "query_no", F.explode(F.array_distinct(words(F.col("query")))).alias("word")))
    wanted = asked.select("word").distinct()
    held = cut(listed.select("paper_id", "length", F.explode("w").alias("word")).join(wanted, "word", "left_semi").groupBy("paper_id", "length", "word").agg(F.count("*").alias("tf")))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.crossJoin(corpus).select("word", idf.alias("idf"), "mean")
    long = 1 - B + B * F.col("length") / F.col("mean")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * long)
    rated = held.join(weighted, "word").select("paper_id", "word", part.alias("part"))
    mine = rated.join(members, "paper_id").join(asked, ["profile", "word"])
    return mine.groupBy("profile", "paper_id", "query_no").agg(F.sum("part").alias("logit"))


def lexical_scores(queries: DataFrame, articles: DataFrame, members: DataFrame) -> DataFrame:
    """-> profile, paper_id, logit, mean, best_query, queries, key for every member of a profile that has queries: the
    largest and the mean logit over all of them, those that share no word being 0, and the first best query. Members of a
    profile without queries are left out, as the stage is skipped for them."""
    hits = bm25(queries, articles, members)
    order = F.struct(F.round("logit", 9).alias("l"), (-F.col("query_no")).alias("q"))
    by = hits.groupBy("profile", "paper_id").agg(F.max("logit").alias("most"), F.sum("logit").alias("total"), F.max_by("query_no", order).alias("first"))
    asked = queries.groupBy("profile").agg(F.count("*").alias("queries"), F.min("query_no").alias("lowest")).join(query_key(queries), "profile")
    out = members.join(asked, "profile").join(by, ["profile", "paper_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("profile", "paper_id", zero(F.col("most")).alias("logit"), zero(F.col("total") / F.col("queries")).alias("mean"), F.coalesce("first", "lowest").alias("best_query"), "queries", "key")


def model_scores(queries: DataFrame, articles: DataFrame, members: DataFrame, score) -> DataFrame:
    """The same interface for a model: score(list of (query, text)) -> logits, called in each task with PAIRS pairs at a
    time; -> profile, paper_id, query_no, logit. Every member meets its profile's queries, at most MOST_QUERIES."""
    import pandas as pd

    few = queries.groupBy("profile").agg(F.collect_list(F.struct("query_no", "query")).alias("qs"))
    pairs = members.join(few, "profile").join(articles, "paper_id").select("profile", "paper_id", "text", F.explode("qs").alias("q")).select("profile", "paper_id", "q.query_no", "q.query", "text")

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), PAIRS):
                part = pdf.iloc[i : i + PAIRS]
                logit = score(list(zip(part["query"], part["text"], strict=True)))
                yield pd.DataFrame({"profile": part["profile"], "paper_id": part["paper_id"], "query_no": part["query_no"], "logit": [float(x) for x in logit]})

    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"profile {kinds['profile']}, paper_id {kinds['paper_id']}, query_no {kinds['query_no']}, logit double")
