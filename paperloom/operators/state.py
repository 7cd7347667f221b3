"""Triage state of a card as a fold of its events, replayable in any order: last event wins by (ts, event_id)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(events: DataFrame) -> DataFrame:
    """events (profile, paper_id, action, ts, event_id) -> a partial state a card, which folded_again() can merge."""
    order = F.struct("ts", "event_id", "action")
    of = lambda a: F.when(F.col("action") == a, F.col("ts"))
    return events.groupBy("profile", "paper_id").agg(
        F.max(F.when(F.col("action").isin("saved", "dismissed", "unsaved"), order)).alias("last"),
        F.min(of("saved")).alias("vaulted_at"),
        F.min(of("shown")).alias("first_shown"),
        F.max(of("shown")).alias("last_shown"),
    )


def folded_again(states: DataFrame) -> DataFrame:
    """Partial states of the same cards, from different events, as one each."""
    return states.groupBy("profile", "paper_id").agg(F.max("last").alias("last"), F.min("vaulted_at").alias("vaulted_at"), F.min("first_shown").alias("first_shown"), F.max("last_shown").alias("last_shown"))


def shown(states: DataFrame) -> DataFrame:
    """saved and dismissed (exclusive), the unsaved marker, the first save (sticky), and first and last shown."""
    now = lambda a: F.coalesce(F.col("last.action") == a, F.lit(False)).alias(a)
    return states.select("profile", "paper_id", now("saved"), now("dismissed"), now("unsaved"), "vaulted_at", "first_shown", "last_shown")


def triage(events: DataFrame) -> DataFrame:
    """The state of each card after all events."""
    return shown(folded(events))
