"""A user's vault: what is in it, its tags and counts, with private versions in place of the public works they are of."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members(*branches: DataFrame) -> DataFrame:
    """The ways into a vault (user, paper_id, at) as one table, each paper of a user once, with its latest event."""
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    return rows.groupBy("user", "paper_id").agg(F.max("at").alias("at"))


def without_shadowed(rows: DataFrame, versions: DataFrame, *keys: str) -> DataFrame:
    """rows without the public works that have a private version among the rows of the same keys.

    versions: version_id, canonical_id."""
    shadows = rows.join(versions, rows["paper_id"] == versions["version_id"]).select(*keys, F.col("canonical_id").alias("paper_id")).distinct()
    return rows.join(shadows, [*keys, "paper_id"], "left_anti")


def with_versions(tags: DataFrame, versions: DataFrame) -> DataFrame:
    """tags (user, slug, paper_id) with those of a public work on its owner's version (version_id, canonical_id, owner) too."""
    own = tags.join(versions, (tags["paper_id"] == versions["canonical_id"]) & (tags["user"] == versions["owner"]))
    own = own.select("user", "slug", F.col("version_id").alias("paper_id"))
    return tags.unionByName(own).distinct()


def owned(papers: DataFrame, *ways: DataFrame) -> DataFrame:
    """papers (user, paper_id) that any of the ways (user, paper_id) leads to: one semi-join with their union."""
    keys = ways[0].select("user", "paper_id")
    for w in ways[1:]:
        keys = keys.unionByName(w.select("user", "paper_id"))
    return papers.join(keys, ["user", "paper_id"], "left_semi")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those rows of new whose keys it has not; is_new beside them. A key that repeats in new comes once."""
    fresh = new.dropDuplicates(keys).join(stored, keys, "left_anti")
    return stored.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))


def twins(seeds: DataFrame, papers: DataFrame, versions: DataFrame) -> DataFrame:
    """(profile, paper_id, twin, way): papers that are a seed again: the same work, file or DOI. papers: paper_id, file, doi."""
    s = seeds.join(papers, "paper_id").select("profile", "paper_id", "file", "doi")
    other = papers.select(F.col("paper_id").alias("twin"), F.col("file").alias("f"), F.lower("doi").alias("d"))
    by_file = s.join(other, F.col("file") == F.col("f")).select("profile", "paper_id", "twin", F.lit("file").alias("way"))
    by_doi = s.join(other, F.lower("doi") == F.col("d")).select("profile", "paper_id", "twin", F.lit("doi").alias("way"))
    by_work = s.join(versions, F.col("paper_id") == F.col("canonical_id")).select("profile", "paper_id", F.col("version_id").alias("twin"), F.lit("work").alias("way"))
    return by_file.unionByName(by_doi).unionByName(by_work).where("twin <> paper_id").groupBy("profile", "paper_id", "twin").agg(F.min("way").alias("way"))


def ordered(rows: DataFrame, group: str, *order) -> DataFrame:
    """rows with their place, from 0, in a list of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


#: Columns of a private version that follow its public record; not title or abstract, which its vector was made from.
FOLLOWED = ("doi", "year", "venue", "publication_date", "authors", "pdf_url", "oa_status")


def following(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """papers (paper_id and FOLLOWED among others) in which versions (version_id, canonical_id) have what their public records
    have of FOLLOWED; where a record has nothing, or is not there, a version keeps its own."""
    public = papers.select(F.col("paper_id").alias("canonical_id"), *[F.col(c).alias(f"public_{c}") for c in FOLLOWED])
    told = versions.select(F.col("version_id").alias("paper_id"), "canonical_id").join(public, "canonical_id").drop("canonical_id")
    out = papers.join(told, "paper_id", "left")
    return out.select(*[F.coalesce(f"public_{c}", c).alias(c) if c in FOLLOWED else F.col(c) for c in papers.columns])


def refreshed(works: DataFrame, stored: DataFrame, marks: DataFrame) -> DataFrame:
    """works (researcher, work, doi) that a source lists now, with state: saved, skipped or new.

    stored (researcher, paper_id, source_id, doi, resolved, synthetic): a work is saved if its id or DOI is there, in rows
    that are not to be repaired (never resolved, and no synthetic id), or if marks (researcher, work, mark) say that it is a
    duplicate of a saved one; skipped if they say so. Empty DOIs match nothing."""
    good = stored.where(F.col("resolved") | F.col("synthetic"))
    keys = F.array(F.concat(F.lit("id:"), "paper_id"), F.concat(F.lit("id:"), "source_id"), F.concat(F.lit("doi:"), F.nullif("doi", F.lit(""))))
    there = good.select("researcher", F.explode(F.array_compact(keys)).alias("key")).distinct()
    asked = F.array_compact(F.array(F.concat(F.lit("id:"), "work"), F.concat(F.lit("doi:"), F.nullif("doi", F.lit("")))))
    known = works.select("researcher", "work", F.explode(asked).alias("key")).join(there, ["researcher", "key"], "left_semi").select("researcher", "work").distinct()
    mark = marks.groupBy("researcher", "work").agg(F.max(F.col("mark") == "duplicate").alias("again"), F.max(F.col("mark") == "skipped").alias("skip"))
    out = works.join(known.withColumn("known", F.lit(True)), ["researcher", "work"], "left").join(mark, ["researcher", "work"], "left")
    return out.select("researcher", "work", F.when(F.col("known") | F.col("again"), "saved").when(F.col("skip"), "skipped").otherwise("new").alias("state"))


def discarded(brought: DataFrame, uses: DataFrame, versions: DataFrame) -> DataFrame:
    """brought (draft, paper_id), uses (paper_id) of anything but these drafts -> the rows of brought that go with their draft.

    Versions (version_id, canonical_id) are looked at first: one that does not go with the same draft is a use of its public record. What several
    drafts brought in stays, for it is the other draft's too."""
    once = brought.distinct()
    alone = once.groupBy("paper_id").agg(F.min("draft").alias("draft"), F.count("*").alias("n")).where("n = 1").drop("n")
    unused = alone.join(uses.select("paper_id").distinct(), "paper_id", "left_anti")
    gone = unused.join(versions.select(F.col("version_id").alias("paper_id")), "paper_id", "left_semi")
    of = versions.join(gone.select(F.col("paper_id").alias("version_id"), F.col("draft").alias("with")), "version_id", "left").select(F.col("canonical_id").alias("paper_id"), "with")
    rest = unused.join(versions.select(F.col("version_id").alias("paper_id")), "paper_id", "left_anti")
    held = rest.join(of, "paper_id").where(~F.col("with").eqNullSafe(F.col("draft"))).select("paper_id").distinct()
    public = rest.join(held, "paper_id", "left_anti")
    return gone.unionByName(public).select("draft", "paper_id")
