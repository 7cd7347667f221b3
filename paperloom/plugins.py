"""Embedders, selectors, rerankers and gatherers by name: what plugs into a gather, DataFrame in, DataFrame out."""

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import works
from paperloom.operators import ranking, rerank, selection

#: Scores pass whatever they are; in place of a threshold, which else is the fitted one.
KEEP_ALL = float("-inf")

EMBEDDERS: dict[str, tuple[int, Callable[[Column], Column]]] = {"placeholder": (128, works.placeholder_vector)}
SELECTORS: dict[str, type] = {}
RERANKERS: dict[str, type] = {}
GATHERERS: dict[str, Callable] = {}


class Selector(Protocol):
    name: str

    def fit(self, seeds: DataFrame) -> "Selector": ...
    def select(self, candidates: DataFrame, threshold: float | None = None) -> DataFrame: ...
    def diagnostics(self) -> dict: ...
    def config(self) -> dict: ...


def _registered(registry: dict):
    def add(cls):
        registry[cls.name] = cls
        return cls

    return add


class _Base:
    """fit keeps the seeds (profile, paper_id, v) lazily; select scores candidates (profile, paper_id, v)."""

    def __init__(self, threshold: float | None = None):
        self.threshold, self.seeds = threshold, None

    def fit(self, seeds: DataFrame):
        self.seeds = seeds
        return self

    def config(self) -> dict:
        return {"name": self.name, "threshold": self.threshold}

    @classmethod
    def from_config(cls, config: dict):
        return cls(config.get("threshold"))

    def diagnostics(self) -> dict:
        return {"status": "unfit"} if self.seeds is None else {"status": "ok", "seeds": self.seeds.count()}

    def select(self, candidates: DataFrame, threshold: float | None = None) -> DataFrame:
        """profile, paper_id, score (rank percentile), score_raw; the percentile precedes the threshold on score_raw."""
        if self.seeds is None:
            raise ValueError(f"{self.name} is not fitted")
        bar = self.threshold if threshold is None else threshold
        out = self.scores(candidates)
        return out if bar is None or bar == KEEP_ALL else out.where(F.col("score_raw") >= bar)


def _by(raw: DataFrame, column: str) -> DataFrame:
    out = raw.select("profile", "paper_id", F.col(column).alias("score_raw"))
    out = ranking.placed(out, ["profile"], F.round("score_raw", 9).desc(), F.col("paper_id").asc())
    return out.withColumn("score", ranking.share(F.col("place"), F.col("members"))).drop("place", "members")


@_registered(SELECTORS)
class Centroid(_Base):
    name = "centroid"

    def scores(self, candidates):
        return _by(selection.scored(candidates, self.seeds), "score")


@_registered(SELECTORS)
class MaxSeed(_Base):
    name = "max_seed"

    def scores(self, candidates):
        return _by(selection.scored(candidates, self.seeds), "max_seed")


@_registered(SELECTORS)
class FullText(_Base):
    """Rows are chunks (profile, paper_id, chunk_id, v)."""

    name = "full_text"

    def scores(self, candidates):
        return _by(rerank.full_text_scores(candidates, self.seeds), "score")


@_registered(RERANKERS)
class Noop:
    name = "noop"

    def rerank(self, ranked: DataFrame, logits: DataFrame | None = None) -> DataFrame:
        return ranked


@_registered(RERANKERS)
class Blend:
    """ranked (profile, batch, paper_id, score_raw, ...) blended with the best logit of each article."""

    name = "blend"

    def rerank(self, ranked: DataFrame, logits: DataFrame) -> DataFrame:
        return rerank.batch_blend(ranked.join(rerank.aggregated(logits), ["profile", "paper_id"]))


def only_reordered(before: DataFrame, after: DataFrame) -> bool:
    """Whether a reranker kept exactly the rows it was given."""
    a, b = before.select("profile", "paper_id"), after.select("profile", "paper_id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def embed(texts: DataFrame, text: str, model: str) -> DataFrame:
    """texts with v, the vectors of a model by name."""
    size, f = EMBEDDERS[model]
    return texts.withColumn("v", f(F.col(text)))


def gatherer(name: str):
    def add(f: Callable) -> Callable:
        GATHERERS[name] = f
        return f

    return add


@gatherer("most_cited")
def most_cited(papers: DataFrame, topics: DataFrame, each: int = 40) -> DataFrame:
    """papers (topic, paper_id, cited) of each profile's topics (profile, topic), the most cited of a topic first."""
    from paperloom.operators.topics import most_cited as top

    return top(papers.join(topics, "topic").withColumn("g", F.concat_ws("|", "profile", "topic")), "g", each).drop("g")
