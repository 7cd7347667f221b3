"""Profiles, seeds and topic lists as a reader is shown them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import calibration, predicates

TOPIC = "id string, display_name string, count variant, papers variant, on variant, source string, profile string, llm_label string, concept string, confidence double, mention string, unmatched variant, unmatched_why string"


def profiles(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """rows (profile, slug, name, threshold, coherence_median, coherence_iqr, n_seed, seed_sim_min, seed_sim_max, is_draft,
    researcher_id, year_from, year_to), actions (profile, saves, dismisses) of the last thirty days."""
    key, n = F.coalesce(F.nullif("slug", F.lit("")), "name"), F.coalesce("n_seed", F.lit(0)).cast("int")
    median = F.col("coherence_median")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.join(actions, "profile", "left").select(
        "profile",
        key.alias("key"),
        "name",
        T.hue(key).alias("hue"),
        calibration.health(median, n).alias("health"),
        zero("threshold").alias("threshold"),
        zero("coherence_median").alias("coherence"),
        n.alias("seeds"),
        F.coalesce("saves", F.lit(0)).cast("long").alias("saves30"),
        F.coalesce("dismisses", F.lit(0)).cast("long").alias("dismisses30"),
        F.coalesce(F.col("is_draft").cast("boolean"), F.lit(False)).alias("is_draft"),
        calibration.label(median, F.col("coherence_iqr"), n).alias("coherence_label"),
        F.when(n >= 2, calibration.agreement(median)).alias("agreement"),
        "seed_sim_min",
        "seed_sim_max",
        "researcher_id",
        "year_from",
        "year_to",
    )


def seeds(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """rows (profile, paper_id, title, year, uploaded_at, canonical_id, coh), versions (paper_id, version, at) of works with
    several files: numbered from 0 in a profile's order of paper_id; when a file came is known from its row, else its version."""
    idx = F.row_number().over(Window.partitionBy("profile").orderBy("paper_id")) - 1
    return rows.join(versions, "paper_id", "left").select(
        "profile",
        "paper_id",
        "canonical_id",
        idx.alias("idx"),
        "version",
        F.coalesce("uploaded_at", "at").alias("uploaded"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("year", F.lit(0)).cast("int").alias("year"),
        F.coalesce("coh", F.lit(0.0)).alias("coh"),
    )


def topics(rows: DataFrame) -> DataFrame:
    """rows (profile, filters: JSON with a list topics; brought: ids that the seeds brought in since, or null) as one row a
    topic: place, flags and names. A topic without an id is none; one without a flag is on; null or broken JSON has none."""
    listed = F.from_json("filters", f"topics array<struct<{TOPIC}>>")["topics"]
    t = rows.select("profile", "brought", F.posexplode(listed).alias("place", "t")).where(F.coalesce("t.id", F.lit("")) != "")
    whole = lambda c: F.try_variant_get(f"t.{c}", "$", "int")
    umls = lambda c: F.when(F.col("t.source") == "umls", F.col(f"t.{c}"))
    off_list = F.when(F.col("t.unmatched").isNotNull() & predicates.truthy(F.col("t.unmatched")), True)
    return t.select(
        "profile",
        "place",
        "t.id",
        F.coalesce("t.display_name", F.lit("")).alias("name"),
        F.coalesce(whole("count"), F.lit(0)).alias("count"),
        whole("papers").alias("papers"),
        predicates.truthy(F.col("t.on")).alias("is_on"),
        "t.source",
        "t.llm_label",
        umls("concept").alias("umls_concept"),
        umls("confidence").alias("umls_confidence"),
        umls("mention").alias("umls_mention"),
        F.when(F.col("brought").isNotNull(), F.array_contains("brought", F.col("t.id"))).alias("new"),
        off_list.alias("unmatched"),
        F.when(off_list, F.coalesce(F.nullif("t.unmatched_why", F.lit("")), F.lit("no_seed"))).alias("unmatched_why"),
    )
