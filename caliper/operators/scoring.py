"""Batch scoring with a user-supplied scorer (the only Python workers).

The network call / model forward pass of an evaluation is the user's code.  This
module runs it over a DataFrame with ``mapInPandas`` (Arrow batches), with
attempts, a fallback scorer and error rows, and materialises the result so that
nothing downstream re-runs the scorer.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caliper.session import bounded_batches
from caliper.sources.readers import with_row_id


class _Batch:
    """What is known of a batch's rows: done or not, the last error, outputs by parts."""

    def __init__(self, n: int):
        self.done = np.zeros(n, bool)
        self.errors = np.full(n, None, object)
        self.parts: list[pd.DataFrame] = []


def _out_schema(df: DataFrame, outputs: StructType) -> StructType:
    return StructType(list(df.schema.fields) + list(outputs.fields)
                      + [StructField("_error", StringType(), True)])


def score_table(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame],
                outputs: StructType, attempts: int = 3,
                fallback: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                backoff: Callable[[int], float] | None = None,
                materialize: bool = True) -> DataFrame:
    """B1: ``scorer(batch) -> DataFrame`` with the ``outputs`` columns, one row per
    input row.  Only failed rows are tried again, up to ``attempts`` times in all: rows
    that the scorer marks in an ``_error`` column go into a smaller batch; a batch for
    which it raises is scored row by row.  What still fails goes to ``fallback`` in the
    same way; a row that fails there too gets NULL outputs and the message in
    ``_error``.  Filters and limits must be applied *before* this call (they are not
    pushed through Python).  A batch holds some 8 MB, or one longer row, and is gone before
    the next one is scored: a worker's memory does not grow with the table."""
    names = [f.name for f in outputs.fields]
    schema = _out_schema(df, outputs)

    def once(fn, pdf, at, state):
        """Score the rows ``at`` in one call; False if it raised for more than one row."""
        try:
            res = fn(pdf.iloc[at].reset_index(drop=True))
            if len(res) != len(at):
                raise ValueError(f"scorer returned {len(res)} rows for {len(at)}")
        except Exception as e:  # noqa: BLE001 - the user's scorer may raise anything
            if len(at) > 1:
                return False
            state.errors[at] = str(e)
            return True
        good = np.ones(len(at), bool)
        if "_error" in res.columns:
            said = res["_error"].to_numpy(dtype=object)
            good = pd.isna(said) | (said == "")
            state.errors[at[~good]] = [str(x) for x in said[~good]]
        if good.any():
            part = res[names] if good.all() else res.loc[good, names]
            state.parts.append(part.set_axis(at[good], axis=0))
            state.done[at[good]] = True
        return True

    def all_tries(fn, pdf, at, state):
        for k in range(attempts):
            if k and backoff is not None:
                time.sleep(backoff(k))
            if not once(fn, pdf, at, state):
                for i in range(len(at)):
                    once(fn, pdf, at[i:i + 1], state)
            at = at[~state.done[at]]
            if not len(at):
                return

    def one(pdf):
        state = _Batch(len(pdf))
        if len(pdf):
            all_tries(scorer, pdf, np.arange(len(pdf)), state)
            left = np.flatnonzero(~state.done)
            if len(left) and fallback is not None:
                all_tries(fallback, pdf, left, state)
        out = pdf.copy()
        whole = pd.concat(state.parts) if state.parts else pd.DataFrame(columns=names, dtype=object)
        for n in names:
            column = whole[n]
            if not state.done.all():    # rows without outputs are NULL, whatever the column's type
                column = column.astype(object)
            column = column.reindex(pdf.index)
            out[n] = column if state.done.all() else column.where(state.done, None)
        state.errors[state.done] = None
        out["_error"] = state.errors
        return out

    def run(batches):
        # pandas' accessors (``.str``) refer to the column that refers to them, so a batch's texts
        # would lie until Python's collector happens to run; what was there before is left alone.
        gc.freeze()
        try:
            for pdf in batches:
                yield one(pdf.reset_index(drop=True))
                del pdf
                gc.collect()
        finally:
            gc.unfreeze()

    if isinstance(df, DataFrame):
        bounded_batches(df.sparkSession)
    scored = df.mapInPandas(run, schema)
    if materialize:
        from caliper.operators.prefix import materialize as _m
        scored = _m(scored)
    return scored


def score_once_per_model(cases: DataFrame, models: list, scorer: Callable,
                         outputs: StructType, model_col: str = "checkpoint",
                         attempts: int = 1, rows_per_load: int = 100_000) -> DataFrame:
    """B2: every model scores every case, and a model is loaded once for each
    ``rows_per_load`` cases (once, if there are no more).

    The cases are written once with their row numbers; salts are dealt by row number, as many
    as the cases need, so equal rows spread like any others.  The roster (a fixed, small
    list, e.g. 90 checkpoints) is exploded onto each row, with no join, and each (model,
    salt) pair goes to a partition of its own by number, not by a hash that might put
    two pairs together.  ``scorer(model_name, batch)`` returns the outputs for that batch;
    it should keep the model it loaded last."""
    numbered = with_row_id(cases, col="__row")
    salts = max(1, -(-numbered.count() // rows_per_load))
    roster = F.posexplode(F.array(*[F.lit(m) for m in models])).alias("__model", model_col)
    place = F.col("__model") * F.lit(salts) + (F.col("__row") % salts)
    x = (numbered.select("*", roster).repartitionById(len(models) * salts, place.cast("int"))
         .drop("__row", "__model"))

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for m, g in pdf.groupby(model_col, sort=False):
            r = scorer(m, g.reset_index(drop=True))
            parts.append(r.set_index(g.index))
        return pd.concat(parts).loc[pdf.index]

    return score_table(x, per_batch, outputs, attempts=attempts)


def with_scenarios(cases: DataFrame, scenarios: dict) -> DataFrame:
    """One row per (case, scenario) with the scenario's image list, e.g.
    ``{"derm_only": ["img_derm"], "derm_plus_clin": ["img_derm", "img_clin"]}``."""
    cells = F.array(*[F.struct(F.lit(name).alias("scenario"),
                               F.array(*[F.col(c) for c in cols]).alias("images"))
                      for name, cols in scenarios.items()])
    return cases.withColumn("__s", F.explode(cells)).select(
        *cases.columns, "__s.scenario", "__s.images")
