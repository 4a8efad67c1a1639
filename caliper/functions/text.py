"""String helpers as Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caliper.functions import rules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Python ``str.strip()``: removes all Unicode white space, such as tabs, newlines and
    no-break spaces (Spark's ``trim`` only spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lower_strip(c) -> Column:
    """``str(x).strip().lower()`` with null -> ''."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def norm_dx2(c) -> Column:
    """lower; runs of non [a-z0-9] -> one space; trim; null -> ''."""
    x = F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", " ")
    return F.coalesce(F.trim(x), F.lit(""))


def extract_id(c, pattern: str = rules.ID_PATTERN) -> Column:
    """first id match upper-cased; no match -> null (regexp_extract gives '')."""
    return F.nullif(F.upper(F.regexp_extract(_c(c), pattern, 0)), F.lit(""))


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)$", 1)


def file_stem(path) -> Column:
    """Name without the last extension (``Path.stem``)."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)) \
        .otherwise(name)


def file_ext(path) -> Column:
    """Last extension with the dot, as written (``Path.suffix``)."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def resolve_path(base: str, value) -> Column:
    """Stripped value; absolute stays, otherwise joined to ``base``."""
    v = strip(_c(value).cast("string"))
    return F.when(v.startswith("/"), v).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), v))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def na_strings_to_null(c, na=rules.PANDAS_NA_STRINGS) -> Column:
    """S2 helper: spellings a pandas reader treats as missing become NULL."""
    col = _c(c)
    return F.when(strip(col).isin(list(na)), F.lit(None)).otherwise(col)


def nan_to_null(c) -> Column:
    """NaN -> NULL so that averages skip it (pandas semantics)."""
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def to_double_or_null(c) -> Column:
    """float(x) with failure -> missing; numeric strings accepted; NaN -> NULL."""
    return nan_to_null(strip(_c(c).cast("string")).try_cast("double"))
