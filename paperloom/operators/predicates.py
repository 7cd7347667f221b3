"""The predicates that define the feed, each once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percentile limits of the buckets where a row has no raw score (fixed values).
HIGH_PCT, MEDIUM_PCT = 0.90, 0.67


def passes(score: Column, threshold: Column) -> Column:
    return score.isNull() | threshold.isNull() | (score >= threshold)


def in_years(year: Column, first: Column, last: Column) -> Column:
    return year.isNull() | ((first.isNull() | (year >= first)) & (last.isNull() | (year <= last)))


def topic_on(source_topic: Column, own: Column, on: Column, listed: Column) -> Column:
    """True without a source topic or a topic list, or if the source topic or one of the row's own topics is on."""
    return source_topic.isNull() | ~F.coalesce(listed, F.lit(False)) | F.coalesce(F.array_contains(on, source_topic), F.lit(False)) | F.coalesce(F.arrays_overlap(own, on), F.lit(False))


def json_on(on: Column) -> Column:
    """Truth of a JSON value given as text: absent is on; null, false, 0, empty text, list and object are off."""
    return F.when(on.isNull(), True).otherwise(~F.trim(on).isin("null", "false", "0", "0.0", '""', "[]", "{}"))


def bucket(score: Column, threshold: Column, seed_min: Column, pct: Column) -> Column:
    """low under the threshold, high from the least typical seed's similarity on; by percentile where score or threshold is missing."""
    by_pct = F.when(pct >= HIGH_PCT, "high").when(pct >= MEDIUM_PCT, "medium").otherwise("low")
    by_score = F.when(score < threshold, "low").when(score >= seed_min, "high").otherwise("medium")
    return F.when(score.isNotNull() & threshold.isNotNull(), by_score).otherwise(by_pct)


def plausible_year(year: Column, this_year: int) -> Column:
    return F.when(year.between(1000, this_year + 1), year)


def not_seed(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """candidates (profile, paper_id, doi) that are no seed of their profile: not by id, not as the public record of a
    seed that is a private version, and not by DOI. seeds: profile, paper_id, canonical_id, doi. Each way is an anti-join."""
    ids = seeds.select("profile", F.explode(F.array_compact(F.array("paper_id", "canonical_id"))).alias("paper_id")).distinct()
    dois = seeds.select("profile", F.lower("doi").alias("_doi")).where("_doi is not null").distinct()
    out = candidates.join(ids, ["profile", "paper_id"], "left_anti").withColumn("_doi", F.lower("doi"))
    return out.join(dois, ["profile", "_doi"], "left_anti").drop("_doi")


#: First year, most years of a fetch, papers a year and in all of a trial; topics of a wide filter; the source of guessed topics.
MIN_YEAR, MOST_YEARS, TRIAL_YEAR, TRIAL_TOTAL, WIDE, GUESSED = 1900, 15, 40, 600, 10, "pdf_content"


def truthy(v: Column) -> Column:
    """The truth of a variant value: absent is on; null, false, 0, empty text, list and object are off."""
    return F.when(v.isNull(), True).otherwise(~F.is_variant_null(v) & ~F.to_json(v).isin("false", "0", "0.0", '""', "[]", "{}"))


def enabled_ids(topics_json: Column) -> Column:
    """Of a JSON list of topics the ids of those that are on, in their order."""
    listed = F.from_json(topics_json, "array<struct<id string, on variant>>")
    return F.transform(F.filter(listed, lambda t: t["id"].isNotNull() & (t["id"] != "") & truthy(t["on"])), lambda t: t["id"])


def filter_string(parts: list[tuple[str, Column, str]], since: Column, until: Column, extras: str) -> Column:
    """Clauses joined by commas: `or` joins the ids of a key in one clause, `and` makes a clause for each; none without ids."""
    clauses = [F.concat(F.lit("from_publication_date:"), since), F.concat(F.lit("to_publication_date:"), until), F.lit(extras)]
    for key, ids, mode in parts:
        one = F.concat(F.lit(f"{key}:"), F.array_join(ids, "|"))
        each = F.concat(F.lit(f"{key}:"), F.array_join(ids, f",{key}:"))
        clauses.append(F.when(F.size(ids) > 0, one if mode == "or" else each))
    return F.concat_ws(",", *clauses)


def is_wide(c: Column) -> Column:
    """Whether a topic clause ORs more than WIDE values."""
    values = lambda x: F.substring_index(F.concat(x, F.lit(":")), ":", 1).contains("topic") & (F.size(F.split(F.substring_index(x, ":", -1), r"\|")) > WIDE)
    return F.exists(F.split(c, ","), values)


def formula_like(sentence: Column) -> Column:
    """Under half of the tokens are words."""
    t = F.filter(F.split(sentence, r"\s+"), lambda x: x != "")
    words = F.size(F.filter(t, lambda x: x.rlike(r"^[A-Za-z][a-z]{2,}[.,;:)]?$")))
    return (F.size(t) == 0) | (words / F.greatest(F.size(t), F.lit(1)) < 0.5)


def usable_mention(mention: Column, sentence: Column, abbreviation: Column) -> Column:
    """Not of three letters or fewer, unless the text defines it as an abbreviation, and not in a formula."""
    short = F.length(F.regexp_replace(mention, "[^A-Za-z0-9]", "")) <= 3
    return (~short | abbreviation) & ~formula_like(sentence)


def fair_range(first: Column, last: Column, this_year: int) -> Column:
    """Whether a range of years, open or not, lies within MIN_YEAR and this year and is in order."""
    within = lambda y: y.isNull() | y.between(MIN_YEAR, this_year)
    return within(first) & within(last) & (first.isNull() | last.isNull() | (first <= last))


def fetch_span(first: Column, last: Column, this_year: int) -> Column:
    """first and last year of a fetch: at most MOST_YEARS, the most recent ones."""
    end = F.coalesce(last, F.lit(this_year))
    return F.struct(F.greatest(first, end - (MOST_YEARS - 1)).alias("first"), end.alias("last"))


def trial_quota(years: Column) -> Column:
    return F.when(years.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(TRIAL_YEAR), F.floor(F.lit(TRIAL_TOTAL) / F.greatest(years, F.lit(1))))))


def stored_topics(raw: Column) -> Column:
    """Topics as they count: none for those that were guessed from a text."""
    return F.when(F.coalesce(F.get_json_object(raw, "$.source") == GUESSED, F.lit(False)), F.lit(None)).otherwise(raw)
