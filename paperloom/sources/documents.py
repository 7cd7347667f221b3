"""JSON documents: profiles, topics, registry records, semantic types; and JSON-lines logs, indexes and exports."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import identifiers as I
from paperloom.functions import text as T

PROFILE = "slug string, name string, threshold double, seeds array<string>, topics array<struct<id string, display_name string, count long, on boolean>>, embedding_model string"
TOPIC = "id string, display_name string, description string, keywords array<struct<display_name string, score double>>"
RECORD = "works struct<group array<struct<`external-ids` struct<`external-id` array<struct<`external-id-type` string, `external-id-value` string>>>, `work-summary` array<struct<title struct<title struct<value string>>>>>>>"
#: Semantic types that say nothing of a subject.
UNINFORMATIVE = ("T062", "T041", "T070")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles as portable JSON, one an object a line."""
    profiles.write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """The topics of pages that are JSON objects with their results."""
    pages = spark.read.schema(f"results array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _fields(TOPIC))}>>").json(path, multiLine=True)
    return pages.select(F.inline("results"))


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def write_index(index: DataFrame, path: str, model: str) -> None:
    """A topic index (topic_id, name, v) and, only once it is whole, its meta row; readers take the version it names."""
    import uuid

    version = uuid.uuid4().hex
    index.write.parquet(f"{path}/{version}")
    n, size = index.agg(F.count("*"), F.max(F.size("v"))).first()
    spark = index.sparkSession
    spark.createDataFrame([(version, model, n, size)], "version string, model string, n long, size int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The current index; a model, number of rows or size of vectors that its meta does not say is an error."""
    meta = spark.read.schema("version string, model string, n long, size int").json(f"{path}/meta").first()
    index = spark.read.parquet(f"{path}/{meta['version']}")
    n, least, most = index.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if meta["model"] != model or n != meta["n"] or {least, most} - {meta["size"], None}:
        raise ValueError(f"index of {meta['model']} with {n} vectors of {least} to {most} numbers, its meta says {meta['n']} of {meta['size']}")
    return index


def tail(spark: SparkSession, path: str, n: int = 20) -> list[str]:
    """The last n lines that are not empty of a log, oldest first: files by name, lines in their order."""
    lines = spark.read.text(path).where("value <> ''").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    last = lines.orderBy(F.desc("f"), F.desc("b"), F.desc("i")).limit(max(1, n)).collect()
    return [r["value"] for r in reversed(last)]


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def claimed_works(records: DataFrame) -> DataFrame:
    """records (person, body: JSON text or null) -> person, state, dois, title_keys. An unreadable body and one without any
    work tell apart from one that lists works: `unknown`, `empty`, `found`."""
    r = records.withColumn("j", F.from_json("body", RECORD))
    groups = F.coalesce("j.works.group", F.array())
    ids = F.flatten(F.transform(groups, lambda g: F.coalesce(g["external-ids"]["external-id"], F.array())))
    dois = F.transform(F.filter(ids, lambda e: (F.lower(e["external-id-type"]) == "doi") & (e["external-id-value"] != "")), lambda e: I.seed_doi(e["external-id-value"]))
    titles = F.transform(F.flatten(F.transform(groups, lambda g: F.coalesce(g["work-summary"], F.array()))), lambda w: T.title_key(F.coalesce(w["title"]["title"]["value"], F.lit(""))))
    state = F.when(F.try_parse_json("body").isNull(), "unknown").when(F.size(groups) == 0, "empty").otherwise("found")
    return r.select("person", state.alias("state"), F.array_sort(F.array_distinct(dois)).alias("dois"), F.array_sort(F.array_distinct(F.filter(titles, lambda t: t != ""))).alias("title_keys"))


def relevant_types(types: DataFrame) -> DataFrame:
    """Semantic types (tui, ...) that tell something of a subject."""
    return types.where(~F.col("tui").isin(*UNINFORMATIVE))


def export_rankings(ranked: DataFrame, path: str) -> None:
    """Ranked candidates as JSON, and as CSV with a summary of each profile beside it."""
    ranked.write.mode("overwrite").json(f"{path}/candidates")
    ranked.write.mode("overwrite").csv(f"{path}/rankings", header=True)
    ranked.groupBy("profile").agg(F.count("*").alias("n"), F.max("score").alias("best")).coalesce(1).write.mode("overwrite").csv(f"{path}/summary", header=True)


def settings(c: dict) -> str:
    """Settings as canonical JSON."""
    return json.dumps(c, sort_keys=True)
