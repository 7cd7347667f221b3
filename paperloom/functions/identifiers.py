"""Identifiers in the forms that sources hand out, keys made of them, and fingerprints."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions import text as T

#: Types whose short titles may stand for one work.
VERSIONED = ("dataset", "software", "preprint")


def seed_doi(c: Column) -> Column:
    """As seeds are compared: lower case, without any of the URL and scheme prefixes; empty if missing."""
    c = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(c, r"^(https://doi\.org/)?(http://doi\.org/)?(https://dx\.doi\.org/)?(http://dx\.doi\.org/)?(doi:)?", ""))


def pool_id(c: Column) -> Column:
    return F.replace(c, F.lit("https://openalex.org/"), F.lit(""))


def filter_id(c: Column) -> Column:
    """The last part of an id under the known prefix; any other stays."""
    return F.when(c.startswith("https://openalex.org/"), T.bare_id(c)).otherwise(c)


def code(c: Column) -> Column:
    return F.upper(T.bare_id(F.trim(c)))


def pmcid(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def ror(c: Column) -> Column:
    c = F.trim(F.regexp_replace(F.trim(c), r"(?i)^(https?://)?ror\.org/", ""), F.lit("/"))
    return F.nullif(F.lower(c), F.lit(""))


def orcid(c: Column) -> Column:
    """The bare iD in upper case; null unless well formed with the right check character."""
    c = F.upper(F.trim(F.trim(F.regexp_replace(F.trim(c), r"(?i)^(https?://)?(www\.)?orcid\.org/", ""), F.lit("/"))))
    return F.when(c.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$") & T.orcid_ok(c), c)


@F.pandas_udf(StringType())
def _folded(c: pd.Series) -> pd.Series:
    return c.map(lambda s: "".join(x for x in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(x)).casefold())


def institution_key(c: Column) -> Column:
    """Case, accents, punctuation and a leading `the` do not count."""
    c = F.trim(F.regexp_replace(_folded(c), "[^a-z0-9]+", " "))
    return F.regexp_replace(c, "^the ", "")


def own_doi(page: Column, meta: Column, body: Column) -> Column:
    """A paper's own DOI: from its first page, else its metadata, else the rest of the text."""
    find = lambda c: F.nullif(F.rtrim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<![\d.])10\.\d{4,9}/[-._;()/:A-Za-z0-9]{1,80}", 0), F.lit(".,;:)")), F.lit(""))
    return F.coalesce(find(page), find(meta), find(body))


def short_title_key(kind: Column, title: Column, year: Column, authors: Column, n_authors: Column) -> Column:
    """Title, year, surnames and number of authors of works that come in versions; empty for others."""
    t, names = T.normalize_title(F.coalesce(title, F.lit(""))), F.filter(authors, lambda a: a != "")
    sure = kind.isin(*VERSIONED) & (t != "") & year.isNotNull() & (F.size(names) > 0)
    of = F.array_join(F.array_sort(F.transform(names, T.surname)), ",")
    key = F.concat(F.lit("short:"), kind, F.lit("|"), t, F.lit("|"), year.cast("string"), F.lit("|"), of, F.lit("|"), F.coalesce(n_authors, F.size(names)).cast("string"))
    return F.when(sure, key).otherwise("")


def claimed(works: DataFrame, dois: DataFrame, titles: DataFrame) -> DataFrame:
    """works (person, doi, title_key) with claimed, by what registry records list: dois (person, doi), titles (person,
    title_key). True by either key; false where a key could have matched; null where nothing is comparable."""
    hit = works.join(dois.distinct().withColumn("_d", F.lit(True)), ["person", "doi"], "left").join(titles.distinct().withColumn("_t", F.lit(True)), ["person", "title_key"], "left")
    hit = hit.join(dois.select("person").distinct().withColumn("_has_d", F.lit(True)), "person", "left").join(titles.select("person").distinct().withColumn("_has_t", F.lit(True)), "person", "left")
    no = (F.col("doi").isNotNull() & F.col("_has_d")) | (F.col("title_key").isNotNull() & F.col("_has_t"))
    return hit.withColumn("claimed", F.when(F.col("_d") | F.col("_t"), True).when(no, False)).drop("_d", "_t", "_has_d", "_has_t")


def renamed(rows: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """rows with the ids of a list renamed by names (id, new_id), each once, at its first place."""
    one = rows.select(key, F.posexplode(ids).alias("at", "id")).join(names, "id", "left").select(key, "at", F.coalesce("new_id", "id").alias("id"))
    first = one.groupBy(key, "id").agg(F.min("at").alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias(ids))


def _json(c: Column, kind: str) -> Column:
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))
    return quoted if kind == "string" else c.cast("string")


def settings_hash(settings: dict[str, Column]) -> Column:
    """16 characters of the sha256 of a flat JSON object with sorted keys; text values by name, numbers as they print."""
    text = {"lang", "source", "model", "mode"}
    parts = [F.concat(F.lit(f'"{k}": '), _json(settings[k], "string" if k in text else "number")) for k in sorted(settings)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


def seeds_hash(ids: Column) -> Column:
    return F.substring(F.sha1(F.array_join(F.array_sort(ids), "\n")), 1, 16)


def queries_hash(model: str, mode: str, aggregation: str, queries: Column) -> Column:
    listed = F.concat(F.lit("["), F.array_join(F.transform(queries, lambda q: _json(q, "string")), ", "), F.lit("]"))
    return F.substring(F.sha2(F.concat(F.lit(f'["{model}", "{mode}", "{aggregation}", '), listed, F.lit("]")), 256), 1, 16)
