"""Row filters that run before any expensive step.

Filters and limits are not pushed through a Python scorer (``mapInPandas``), so
they are applied by the API before scoring, where Catalyst can push them into
the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.functions.text import strip


def evaluable(df: DataFrame, truth: str, pred: str, error: str | None = None,
              strict_blank: bool = True) -> DataFrame:
    """Rows with a non-blank truth and prediction (and no error).  With
    ``strict_blank=False`` a NULL counts as present, the way a missing value read
    back from CSV as NaN is counted by the original evaluation (quirk Q4)."""
    def present(c):
        col = F.col(c).cast("string")
        if strict_blank:
            return F.coalesce(strip(col), F.lit("")) != ""
        return col.isNull() | (strip(col) != "")
    cond = present(truth) & present(pred)
    if error is not None:
        cond = cond & (F.coalesce(strip(F.col(error)), F.lit("")) == "")
    return df.where(cond)


def limit_cases(df: DataFrame, n: int | None, order) -> DataFrame:
    """The first ``n`` cases in ``order`` before scoring; 0 / None = all."""
    if not n:
        return df
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def image_type_filter(df: DataFrame, type_col: str, kind: str) -> DataFrame:
    """Rows whose lower-cased image type contains ``kind`` (derm / clinic)."""
    return df.where(F.lower(F.col(type_col).cast("string")).contains(kind))


def sorted_listing(df: DataFrame, col: str = "path") -> DataFrame:
    """T4: deterministic order by path."""
    return df.orderBy(col)
