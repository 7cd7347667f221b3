"""Stored candidates and their logits: upserts that keep what is known, and the refresh of stale logits by compare-and-set."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.snapshots import Snapshots

#: Rows of a profile refreshed in a pass, and passes.
REFRESHED, PASSES = 600, 3
#: Columns of a find that replace the stored ones.
SCORES = ("score", "score_raw", "score_max_seed", "score_pct", "score_norm", "score_blended", "tier", "run")
#: Columns that a find never touches once a row is stored.
TRIAGE = ("shown_at", "saved_at", "dismissed_at")


def upserted(stored: DataFrame, found: DataFrame) -> DataFrame:
    """stored and found (profile, paper_id, those of SCORES and TRIAGE that both have, logit, query_key, topic) -> the new
    table, with is_new. Scores are the find's, null too; a null logit of the find keeps the stored one, and the key goes with
    the logit it describes; the first topic that brought a paper stays, and so does its triage."""
    o, n = stored.withColumn("there", F.lit(True)).alias("o"), found.withColumn("there", F.lit(True)).alias("n")
    of = lambda side, c: F.col(f"{side}.{c}")
    both = o.join(n, (of("o", "profile") == of("n", "profile")) & (of("o", "paper_id") == of("n", "paper_id")), "full_outer")
    new, old = of("n", "there").isNotNull(), of("o", "there").isNotNull()
    pick: dict[str, Column] = {k: F.coalesce(of("o", k), of("n", k)) for k in ("profile", "paper_id")}
    pick |= {c: F.when(new, of("n", c)).otherwise(of("o", c)) for c in SCORES if c in found.columns}
    pick |= {c: F.when(old, of("o", c)).otherwise(of("n", c)) for c in TRIAGE if c in found.columns}
    fresh = of("n", "logit").isNotNull()
    pick |= {c: F.when(fresh, of("n", c)).otherwise(of("o", c)) for c in ("logit", "query_key")}
    pick["topic"] = F.coalesce(of("o", "topic"), of("n", "topic"))
    return both.select(*[v.alias(k) for k, v in pick.items()], (~old).alias("is_new"))


def stale(rows: DataFrame, keys: DataFrame, limit: int = REFRESHED) -> DataFrame:
    """rows (profile, paper_id, score_raw, logit, query_key), keys (profile, key) -> rows of profiles with queries whose logit
    is missing or of another key, with key: the best `limit` of each profile by score_raw, nulls last, ties to the smaller id.
    The limit is the feature: a pass is bounded, and the next one takes the rest."""
    late = rows.join(keys, "profile").where(F.col("logit").isNull() | ~F.col("query_key").eqNullSafe(F.col("key")))
    n = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc_nulls_last("score_raw"), "paper_id"))
    return late.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def set_logits(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """rows with logit and query_key of scored (profile, paper_id, seen_key, new_logit, key) where the row's key still is
    seen_key, the one that was read before scoring, and new_logit is a number; other rows stay as they are."""
    s = scored.where(F.col("new_logit").isNotNull() & ~F.isnan("new_logit")).select("profile", "paper_id", "seen_key", "new_logit", F.col("key").alias("new_key"))
    out = rows.join(s, ["profile", "paper_id"], "left")
    hit = F.col("new_logit").isNotNull() & F.col("query_key").eqNullSafe(F.col("seen_key"))
    put = {"logit": F.when(hit, F.col("new_logit")).otherwise(F.col("logit")), "query_key": F.when(hit, F.col("new_key")).otherwise(F.col("query_key"))}
    return out.select(*[put.get(c, F.col(c)).alias(c) for c in rows.columns])


def refresh(table: Snapshots, keys: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame], limit: int = REFRESHED, passes: int = PASSES) -> list[int]:
    """Refreshes stale logits and returns the rows scored in each pass.

    keys() tells each profile's present query key, and is asked anew for each pass, so that a change of queries while one
    runs is met by the next; another pass is run only while rows are of another key than now. score(stale rows) returns
    profile, paper_id, new_logit. Scores are written once and put to the table by compare-and-set: if another writer was
    first, they are put to its snapshot, and rows whose key that writer changed keep what it set."""
    from paperloom.operators.resolve import cut

    done, before = [], None
    for _ in range(passes):
        now = cut(keys())
        if before is not None and now.exceptAll(before).isEmpty():
            break
        before = now
        late = stale(table.read(), now, limit)
        told = score(late).select("profile", "paper_id", "new_logit")
        scored = cut(late.select("profile", "paper_id", F.col("query_key").alias("seen_key"), "key").join(told, ["profile", "paper_id"]))
        done.append(scored.count())
        if not done[-1]:
            break
        table.update(lambda rows: set_logits(rows, scored))
    return done
