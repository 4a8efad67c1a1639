"""Truth and prediction labelling as Column expressions.

Rule tables (``caliper.functions.rules``) are turned into ``CASE WHEN`` chains
or literal maps, so they stay inside whole-stage codegen; no Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caliper.functions import rules
from caliper.functions.text import _c, lower_strip, norm_dx2, strip


def _any_contains(c: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def label_binary(dx, malignant_terms=rules.MALIGNANT_TERMS,
                 melanoma_terms=rules.MELANOMA_TERMS) -> Column:
    """struct(y_malignant, y_melanoma) from contains-rules on the diagnosis text."""
    t = lower_strip(dx)
    return F.struct(
        _any_contains(t, malignant_terms).cast("int").alias("y_malignant"),
        _any_contains(t, melanoma_terms).cast("int").alias("y_melanoma"),
    )


def label_family(dx, family_rules=rules.FAMILY_RULES, exact_codes=None,
                 default=rules.FAMILY_DEFAULT) -> Column:
    """ordered contains-rules; ``exact_codes`` adds whole-text code matches
    (``{"BCC": ["bcc"], ...}``) to the rule of that family."""
    t = lower_strip(dx)
    exact_codes = exact_codes or {}
    expr = None
    for fam, terms in family_rules:
        cond = _any_contains(t, terms)
        if fam in exact_codes:
            cond = cond | t.isin(list(exact_codes[fam]))
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit(default))


def labels_from_family(fam, malignant=rules.MALIGNANT_FAMILIES,
                       melanoma=rules.MELANOMA_FAMILIES) -> Column:
    """struct(y_malignant, y_melanoma) from the family code."""
    f = _c(fam)
    return F.struct(
        F.coalesce(f.isin(list(malignant)), F.lit(False)).cast("int").alias("y_malignant"),
        F.coalesce(f.isin(list(melanoma)), F.lit(False)).cast("int").alias("y_melanoma"),
    )


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_family(x, aliases=rules.FAMILY_ALIASES, default=rules.FAMILY_DEFAULT) -> Column:
    """strip + upper, alias lookup in a literal map; unknown or null -> default."""
    key = F.upper(strip(_c(x).cast("string")))
    return F.coalesce(F.element_at(_literal_map(aliases), key), F.lit(default))


def canon_truth_two_class(raw) -> Column:
    """'' stays ''; indeterminate first; then melanoma/malignant; nevus/naevus/benign."""
    t = lower_strip(raw)
    mel, nev = rules.TWO_CLASSES
    return (F.when(t == "", F.lit(""))
            .when(t.contains(rules.INDETERMINATE_TOKEN), F.lit(nev))
            .when(t.contains("melanoma") | t.contains("malignant"), F.lit(mel))
            .when(t.contains("nevus") | t.contains("naevus") | t.contains("benign"), F.lit(nev))
            .otherwise(F.lit("")))


def canon_truth_melanoma(raw) -> Column:
    """F6 on one chosen column: indeterminate -> non-melanoma; malignant/melanoma ->
    melanoma; benign -> non-melanoma; else ''."""
    t = lower_strip(raw)
    non, mel = rules.MELANOMA_LABELS
    return (F.when(t.contains(rules.INDETERMINATE_TOKEN), F.lit(non))
            .when(t.contains("malignant") | t.contains("melanoma"), F.lit(mel))
            .when(t.contains("benign"), F.lit(non))
            .otherwise(F.lit("")))


def truth_melanoma_from(df_columns, force_col: str | None = None,
                        fallback_col: str = rules.ARCHIVE_TRUTH_COLUMN) -> Column:
    """F6 column choice: a forced column if it exists, else the fallback column when
    non-blank, else ''.  Dotted names are backtick-quoted."""
    if force_col and force_col in df_columns:
        return canon_truth_melanoma(F.col(f"`{force_col}`").cast("string"))
    if fallback_col in df_columns:
        fb = F.col(f"`{fallback_col}`").cast("string")
        return F.when(F.coalesce(strip(fb), F.lit("")) != "", canon_truth_melanoma(fb)) \
            .otherwise(F.lit(""))
    return F.lit("")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).
    Inside higher-order lambdas Catalyst does not eliminate common subexpressions,
    so a rule chain that tests one derived value many times would recompute it for
    every rule."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_regex(terms) -> str:
    return r"\b(" + "|".join(terms) + r")\b"


def dx_to_group(text, group_rules=rules.DX_GROUP_RULES) -> Column:
    """F8: normalise, then ordered word-boundary rules; no hit or null input -> null."""
    raw = _c(text)

    def chain(p):
        expr = None
        for terms, group in group_rules:
            cond = p.rlike(_word_regex(terms))
            expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
        return expr

    return F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(let(norm_dx2(raw), chain))


def is_malignant_group(g, groups=rules.MALIGNANT_DX_GROUPS) -> Column:
    """membership of the normalised group in the malignant set (null -> false)."""
    return F.coalesce(norm_dx2(g).isin(list(groups)), F.lit(False))


def hit_at_k(truth, preds, k: int, group_rules=rules.DX_GROUP_RULES) -> Column:
    """normalised truth non-empty and among the mapped groups of the first k
    predictions (array<string> column)."""
    t = norm_dx2(truth)
    first_k = F.coalesce(F.slice(_c(preds), 1, k), F.array().cast("array<string>"))
    hit = F.exists(first_k, lambda p: norm_dx2(dx_to_group(p, group_rules)) == t)
    return (t != "") & hit


def collapse_two_class(diag) -> Column:
    """prediction text containing 'melanoma' -> melanoma, else melanocytic nevus."""
    mel, nev = rules.TWO_CLASSES
    d = F.lower(F.coalesce(_c(diag).cast("string"), F.lit("")))
    return F.when(d.contains("melanoma"), F.lit(mel)).otherwise(F.lit(nev))


def flag_equal(a, b) -> Column:
    """equality as 0/1 (null -> 0)."""
    return F.coalesce(_c(a) == _c(b), F.lit(False)).cast("int")


def flag_in(a, cols) -> Column:
    """membership of ``a`` in several columns as 0/1."""
    return F.coalesce(_c(a).isin([_c(x) for x in cols]), F.lit(False)).cast("int")


def correct_flag(pred, truth) -> Column:
    """Both non-empty and equal; nulls -> false."""
    p, t = F.coalesce(_c(pred), F.lit("")), F.coalesce(_c(truth), F.lit(""))
    return (p != "") & (t != "") & (p == t)


def threshold_flag(p, thr: float) -> Column:
    """p >= thr as 0/1 (null -> 0, like a float default of 0 below the cut)."""
    return F.coalesce(_c(p) >= F.lit(float(thr)), F.lit(False)).cast("int")


def prob_from_label(pred, conf, positive: str = "Malignant") -> Column:
    """F16: P(positive) = conf if pred is the positive label else 1 - conf."""
    c = _c(conf).cast("double")
    return F.when(_c(pred) == positive, c).otherwise(F.lit(1.0) - c)


def first_present(df_columns, names, default=None, text: bool = False) -> Column:
    """first column that exists and is not null, else the default (``text``: each
    as its own text, with no common type in between)."""
    present = [F.col(f"`{n}`") for n in names if n in df_columns]
    if text:
        present, default = [c.cast("string") for c in present], str(default)
    return F.coalesce(*present, F.lit(default)) if present else F.lit(default)
