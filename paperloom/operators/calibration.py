"""How well seeds agree, in words and on a scale."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Medians from which seeds are focused or broad, the spread of two groups, the agreement that overrides it,
#: and the medians of agreement 0 and 100.
FOCUSED, BROAD, TWO_GROUPS, OVERRIDES, FLOOR, CEILING = 0.90, 0.86, 0.07, 80, 0.82, 0.95


def agreement(median: Column) -> Column:
    """0 to 100, linear between the medians of unlike and of nearly equal papers; null without a median."""
    share = (median - FLOOR) / (CEILING - FLOOR)
    return F.when(median.isNotNull() & ~F.isnan(median), F.bround(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), 0).cast("int"))


def label(median: Column, iqr: Column, n: Column) -> Column:
    tight = (F.coalesce(iqr, F.lit(0.0)) < TWO_GROUPS) | (agreement(median) >= OVERRIDES)
    by = F.when(median.isNull(), "none").when((median >= FOCUSED) & tight, "focused").when(median >= BROAD, "broad").otherwise("mixed")
    return F.when(n < 1, "none").when(n < 2, "single").otherwise(by)


def health(median: Column, n: Column) -> Column:
    """ok, warn or err, from the median alone."""
    of = label(median, F.lit(None).cast("double"), n)
    return F.when(of == "focused", "ok").when(of == "mixed", "err").otherwise("warn")
