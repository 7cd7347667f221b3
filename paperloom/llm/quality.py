"""Quality rules whose cutoffs are chosen under a bound on false rejection.

The base rule (under 50 words, or more than half of the words in repeated windows) rejects whatever the labels say. Of
the documents that pass it, each further rule rejects those whose measure exceeds a cutoff. All labels, losses and risks
below are of documents that pass the base rule; what the base rule costs is no part of the bound. For each stratum (language), labelled documents of a third
of the doc_ids (by hash) lay a path of joint verdicts: from no cutoff on, the step that loses least good documents
(quality 1) for each bad one (quality 0) it catches, as long as the joint loss is within RISK there. On the other two
thirds the joint verdicts are tested in that order, and the exact binomial test P(Bin(n, RISK) <= good ones rejected by
any rule) <= LEVEL / strata must pass at a verdict and all before it (fixed-sequence testing, Bonferroni over strata).
As the path does not depend on the documents it is tested on, with probability 1 - LEVEL no stratum loses more than RISK
of its good documents. Of the passing verdicts the one with most bad documents rejected less good ones lost is taken,
the earlier one on ties; with none, no rule rejects anything there. A stratum whose tested part has under
log(LEVEL / strata) / log(1 - RISK) good documents (86 with four strata) cannot pass.

Defined cases: null text has no words and fails the base rule; a null language is a stratum of its own; a document with
several labels is good only if all say so; labels with nulls or of unknown documents are left out; every row is judged
by its own text, also where a doc_id is null or repeats (for the cutoffs, one row of a doc_id counts, that of least
counts); empty tables give empty tables and no rules; other columns are not read, and stay whatever their names.
"""

from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.llm import textbytes as tb
from paperloom.llm.store import bounded, named, numbered, saved

RISK, LEVEL = 0.05, 0.05
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: Rule: measure (more is worse), cutoffs from the loosest to the strictest.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "long_words": ("word_chars / greatest(n_words, 1)", [60.0, 40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]),
    "short_words": ("-(word_chars / greatest(n_words, 1))", [-1.1, -1.3, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0]),
}


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def counts_of(text: pa.Array) -> pa.Array:
    """COUNTS of whole texts."""
    cols: list[list] = [[np.zeros(0, np.int64)] for _ in COUNTS]
    for _, _, buf, offs in tb.pieces(text):
        start, end, first = tb.words(buf, offs)
        n, docs = np.diff(first), np.arange(len(offs) - 1)
        per = lambda mask, offs=offs: np.diff(np.concatenate(([0], np.cumsum(mask)))[offs])
        hasher, salt = tb.Hasher(buf), np.uint64(0xA24B_AED4_963E_E407)
        doc = np.repeat(docs, n)
        # windows of three words that stay inside one text
        w, d = tb.windows(hasher(start, end), 3), doc[: max(0, len(doc) - 2)]
        inside = np.flatnonzero(d == doc[2:]) if len(d) else np.zeros(0, np.int64)
        _, at, times = np.unique(tb.mixed(w[inside] + d[inside].astype(np.uint64) * salt), return_inverse=True, return_counts=True)
        twice, cover = inside[times[at] > 1], np.zeros(len(start) + 1, bool)
        for k in range(3):
            cover[twice + k] = True
        ls, le, lf = tb.lines(buf, offs)
        seen = np.concatenate(([0], np.cumsum(~tb.SPACE[buf])))
        full = seen[le] > seen[ls]
        ldoc = np.repeat(docs, np.diff(lf))[full]
        _, once = np.unique(tb.mixed(hasher(ls[full], le[full]) + ldoc.astype(np.uint64) * salt), return_index=True)
        n_lines, kinds = np.bincount(ldoc, minlength=len(docs)), np.bincount(ldoc[once], minlength=len(docs))
        repeat = np.bincount(doc[cover[:-1]], minlength=len(docs))
        found = (n, per(~tb.SPACE[buf] & ((buf & 0xC0) != 0x80)), per(SYMBOL[buf]), n_lines - kinds, repeat, n_lines)
        for c, x in zip(cols, found, strict=True):
            c.append(x.astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in cols], COUNTS)


#: For rows that are filtered by their counts: what is not deterministic is not evaluated once more for a filter that moves
#: below a join, which would take a second Python worker in each task.
counts_once = F.arrow_udf(counts_of.func, counts_of.returnType).asNondeterministic()


def counted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, stratum and COUNTS, a row for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), counts_of(F.col("text").cast("string")).alias("n"))
    return docs.select("doc_id", "stratum", "n.*")


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(int(k) + 1)))


def _path(at: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float) -> list[list[int]]:
    """Joint verdicts from the loosest on: for each rule the index of its cutoff, or -1. at: first cutoffs exceeded."""
    now, gone, path = [-1] * len(RULES), np.zeros(len(at), bool), []
    while True:
        steps = []
        for r, (_, cuts) in enumerate(RULES.values()):
            for k in range(now[r] + 1, len(cuts)):
                more = ~gone & (at[:, r] <= k)
                caught, lost = bad[more].sum(), good[more].sum()
                if caught > lost and good[gone].sum() + lost <= risk * good.sum():
                    steps.append((lost / caught, -caught, k, r))
        if not steps:
            return path
        *_, k, r = min(steps)
        now = [k if i == r else x for i, x in enumerate(now)]
        gone |= at[:, r] <= k
        path.append(now)


def _chosen(risk: float, level: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        at, good, bad = np.stack(part["at"].to_list()), part["good"].to_numpy(), part["bad"].to_numpy()
        test, best, most = part["tested"].to_numpy(), [-1] * len(RULES), 0
        n, level_of = int(good[test].sum()), level / part["strata"].iloc[0]
        for cut in _path(at[~test], good[~test], bad[~test], risk):
            gone = (at <= np.array(cut)).any(axis=1)
            lost = int(good[gone & test].sum())
            if lost >= n * risk or tail(n, lost, risk) > level_of:  # over the mean the tail is above any useful level
                break
            gain = bad[gone].sum() - good[gone].sum()
            if gain > most:
                best, most = cut, gain
        stratum = part["stratum"].iloc[0]
        rows = [(None if pd.isna(stratum) else stratum, name, cuts[k]) for (name, (_, cuts)), k in zip(RULES.items(), best, strict=True) if k >= 0]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff"])

    return run


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff for each stratum and rule with a safe cutoff; from counted documents and (doc_id, quality)."""
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = counts.groupBy("doc_id").agg(F.min(F.struct("stratum", *COUNTS)).alias("r")).select("doc_id", "r.*").where(f"not ({BASE})").join(labels, "doc_id")
    # with the cutoffs falling, the last of them lie under a measure; the index of the first of these
    first = [(F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), (lambda e: lambda c: c < e)(F.expr(measure))))).alias(name) for name, (measure, cuts) in RULES.items()]
    known = known.select("stratum", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("tested"), F.array(*first).alias("at"), "quality")
    # as many rows as there are combinations of cutoffs, however many documents
    seen = known.groupBy("stratum", "tested", "at").agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad"))
    seen = saved(seen, "labelled")
    many = seen.agg(F.greatest(F.countDistinct(F.struct("stratum")), F.lit(1)).alias("strata"))
    return seen.crossJoin(F.broadcast(many)).groupBy("stratum").applyInPandas(_chosen(risk, level), "stratum string, rule string, cutoff double")


def verdict(found: dict[str, Column]) -> Column:
    """True if no rule's measure exceeds its cutoff (null: no cutoff)."""
    out = F.lit(True)
    for name, (measure, _) in RULES.items():
        out = out & ~F.coalesce(F.expr(measure) > found[name], F.lit(False))
    return out


def _cutoff_columns(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each stratum (s2) with a cutoff, and a column cut_ for each rule."""
    chosen = cutoffs(counts, labels).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    return bounded(saved(chosen.withColumnRenamed("stratum", "s2").withColumnsRenamed({r: f"cut_{r}" for r in RULES}), "cutoffs"))


def _with_verdicts(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """counts plus base_failed and kept."""
    out = counts.join(chosen, F.expr("stratum <=> s2"), "left").withColumn("base_failed", F.expr(BASE))
    return out.withColumn("kept", ~F.col("base_failed") & verdict({r: F.col(f"cut_{r}") for r in RULES}))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs -> doc_id, COUNTS, base_failed, kept; a row for each row of docs."""
    counts = saved(counted(docs), "counts")
    return _with_verdicts(counts, _cutoff_columns(counts, labels)).select("doc_id", *COUNTS, "base_failed", "kept")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns; each goes or stays by its own text."""
    plain, c = numbered(docs)
    chosen = _cutoff_columns(saved(counted(docs), "counts"), labels)
    n = counts_once(F.col(c["text"]).cast("string"))
    rows = plain.withColumn("stratum", F.col(c["lang"]).cast("string")).withColumn("n", n).select(*plain.columns, "stratum", "n.*")
    return _with_verdicts(rows, chosen).where("kept").select(*named(docs))
