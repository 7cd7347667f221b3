"""Topic lists: names of groups, readings of interests, votes of concepts, and lists rebuilt under their readers' choices."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Topics that a seed and a merge may add, weight of what other groups say, names of a group.
OF_A_SEED, OF_ALL, OTHERS, NAMES = 5, 20, 0.5, 3


def names(said: DataFrame, sizes: DataFrame) -> DataFrame:
    """said (g, t, w), sizes (g, k: papers) -> g, name, count, rank: the topics that a group has more of than the others."""
    inside = said.groupBy("g", "t").agg(F.sum("w").alias("n"))
    total = inside.groupBy("t").agg(F.sum("n").alias("total"))
    papers = sizes.agg(F.sum("k").alias("papers"))  # one row
    x = inside.join(total, "t").join(sizes, "g").crossJoin(papers)
    score = F.col("n") / F.greatest(F.col("k"), F.lit(1)) - OTHERS * (F.col("total") - F.col("n")) / F.greatest(F.col("papers") - F.col("k"), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.round(score, 9).desc(), F.desc("n"), "t"))
    return x.withColumn("rank", rank).where(F.col("rank") <= NAMES).select("g", F.col("t").alias("name"), F.col("n").alias("count"), "rank")


def interests(said: DataFrame, labels: DataFrame) -> DataFrame:
    """said (profile, name, pos, method, weight), labels (profile, label) -> profile, name, wanted, method, weight."""
    negative = F.coalesce(F.col("weight"), F.lit(0.0)) < 0
    n = F.row_number().over(Window.partitionBy("profile", "name").orderBy((F.col("method") == "declared").desc(), negative.desc(), "pos"))
    topics = said.withColumn("n", n).where("n = 1").select("profile", "name", (~negative).alias("wanted"), "method", "weight")
    covered = topics.select("profile", F.lower("name").alias("low"))
    words = labels.distinct().withColumn("low", F.lower("label")).join(covered, ["profile", "low"], "left_anti")
    return topics.unionByName(words.select("profile", F.col("label").alias("name"), F.lit(True).alias("wanted"), F.lit("label").alias("method"), F.lit(None).cast("double").alias("weight")))


def rebuilt(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored (profile, topic, is_on, seeds), new (profile, topic, is_on): the new list with the reader's switches; stored
    topics that it lacks stay, marked by whether they had a seed."""
    s = stored.select("profile", "topic", F.col("is_on").alias("was"), "seeds")
    out = new.withColumn("there", F.lit(True)).join(s, ["profile", "topic"], "full_outer")
    mark = F.when(F.col("there").isNull(), F.when(F.col("seeds") > 0, "seed_removed").otherwise("no_seed"))
    return out.select("profile", "topic", F.coalesce("was", "is_on").alias("is_on"), mark.alias("mark"))


def pruned(stored: DataFrame, chosen: DataFrame) -> DataFrame:
    out = stored.join(chosen.distinct().withColumn("c", F.lit(True)), ["profile", "topic"], "left")
    return out.select("profile", "topic", (F.col("is_on") & F.col("c").isNotNull()).alias("is_on"))


def carried(new: DataFrame, base: DataFrame, now: DataFrame) -> DataFrame:
    """new with the switches of now where these differ from base, the list that new was made from."""
    of = lambda df, c: df.select("profile", "topic", F.col("is_on").alias(c))
    out = new.join(of(base, "b"), ["profile", "topic"], "left").join(of(now, "n"), ["profile", "topic"], "left")
    changed = F.coalesce(F.col("n") != F.col("b"), F.lit(False))
    return out.select("profile", "topic", F.when(changed, F.col("n")).otherwise(F.col("is_on")).alias("is_on"))


def marked(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """topics (profile, topic) with the names of those who want them, from wanted (profile, topic, name)."""
    by = wanted.groupBy("profile", "topic").agg(F.array_sort(F.collect_set("name")).alias("n"))
    out = topics.join(by, ["profile", "topic"], "left")
    return out.select("profile", "topic", F.coalesce(F.size("n"), F.lit(0)).cast("long").alias("marks"), F.array_join("n", ",").alias("names"))


def voted(mapped: DataFrame, have: DataFrame) -> DataFrame:
    """mapped (profile, paper_id, concept, topic_id, name, similarity, confidence, rank) of concepts in seeds, have (profile,
    topic_id) -> profile, topic_id, votes, similarity, place: the topics that most seeds choose.

    Within a seed pairs go nearest first; a topic, a name and a concept count once, and listed topics not at all: one by
    one, over the pairs of one seed, which its text bounds. Votes and the twenty of a profile are aggregates."""

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for r in part.sort_values(["similarity", "confidence", "rank", "name", "topic_id"], ascending=[False, False, True, True, True]).itertuples(index=False):
            marks = {("concept", r.concept), ("topic", r.topic_id), ("name", r.name.lower())}
            if len(rows) < OF_A_SEED and not marks & used:
                used |= marks
                rows.append((r.profile, r.topic_id, r.similarity))
        return pd.DataFrame(rows, columns=["profile", "topic_id", "similarity"])

    usable = mapped.join(have, ["profile", "topic_id"], "left_anti")
    chosen = usable.groupBy("profile", "paper_id").applyInPandas(choose, "profile long, topic_id long, similarity double")
    votes = chosen.groupBy("profile", "topic_id").agg(F.count("*").alias("votes"), F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("votes"), F.desc("similarity"), "topic_id"))
    return votes.withColumn("place", place).where(F.col("place") <= OF_ALL)


def adopted(stored: DataFrame, proposed: DataFrame, choices: DataFrame) -> DataFrame:
    """A reader's profile folded into topic lists: stored (profile, topic, source, is_on), proposed (profile, topic, wanted)
    and choices (profile, topic, choice), joined on the topic.

    A wanted topic is marked `interest` where it is listed, and else comes in, on, as `researcher`. An unwanted one goes by
    its choice: `filter` marks it `not_interest` where it is listed, `add` wants it, `keep` leaves it as it is; without a
    choice it is kept where another source lists it or the profile wants it too, and filtered otherwise. `before` says
    whether a row was in the list; only rows of no list before are of the profile alone."""
    p = proposed.groupBy("profile", "topic").agg(F.max(F.col("wanted").cast("int")).alias("want"), F.min(F.col("wanted").cast("int")).alias("all"))
    c = choices.where(F.col("choice").isin("filter", "keep", "add")).groupBy("profile", "topic").agg(F.min("choice").alias("choice"))
    # a row without a source is of the seeds; rows that an earlier adoption brought are no other source
    other = F.col("before") & (F.coalesce("source", F.lit("seeds")) != "researcher")
    x = stored.withColumn("before", F.lit(True)).join(p, ["profile", "topic"], "full_outer").join(c, ["profile", "topic"], "left")
    choice = F.coalesce("choice", F.when(F.coalesce(other, F.lit(False)) | (F.col("want") == 1), "keep").otherwise("filter"))
    unwanted = F.col("all") == 0
    mark = F.when(unwanted & (choice == "add"), "interest").when(unwanted & (choice == "filter") & F.col("before"), "not_interest").when(F.col("want") == 1, "interest")
    out = x.withColumn("mark", mark).withColumn("choice", F.when(unwanted, choice)).where("before or mark is not null")
    listed = F.coalesce("before", F.lit(False))
    return out.select("profile", "topic", F.when(listed, F.col("source")).otherwise("researcher").alias("source"), F.coalesce("is_on", F.lit(True)).alias("is_on"), "mark", "choice", listed.alias("before"))


def stripped(lists: DataFrame) -> DataFrame:
    """adopted() taken back: the stored list, without the profile's own rows, of this or an earlier adoption, and marks."""
    return lists.where(F.col("before") & (F.coalesce("source", F.lit("seeds")) != "researcher")).select("profile", "topic", "source", "is_on")


def kept_as_own(lists: DataFrame) -> DataFrame:
    """Adopted rows as the list's own: the profile's rows become `adopted`, marks go, every switch stays."""
    return lists.select("profile", "topic", F.when(F.col("source") == "researcher", "adopted").otherwise(F.col("source")).alias("source"), "is_on")
