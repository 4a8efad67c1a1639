"""Registry of runnable plans over the driver tables.

Each plan is a function ``(spark, sf_dir) -> DataFrame`` plus, where the result is
expressible in SQL, an equivalent DuckDB query used as the correctness oracle.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def deco(fn):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def round_half_away(c, digits: int = 6):
    """Round the *binary* double half away from zero: sign(x) * floor(|x| * 10^d + 0.5)
    / 10^d, the same IEEE operations DuckDB's ``round`` performs.  (Spark's
    ``round`` rounds the shortest decimal string instead, which differs on values
    like 0.5006875 whose binary value lies just below the half.)"""
    x = c.cast("double")
    scale = float(10 ** digits)
    mag = F.floor(F.abs(x) * scale + 0.5).cast("double") / scale
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.when(x < 0, -mag).otherwise(mag)).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every top-level double/float column (oracle hygiene)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def load_all():
    """Import every plan module so that it registers itself."""
    from caliper.plans import (  # noqa: F401
        assessment, case_plans, evaluation, ensembles, file_plans, labelling, linkage_plans,
        replies_plans, reports, sources_plans,
    )
    return PLANS, ORACLES
