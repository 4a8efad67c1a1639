"""Model replies (free text that should hold JSON) -> typed rows, as a table job.

A bad reply yields an error row (``_error``), it never fails the job unless
``on_error="fail"``.  All parsing is JVM-side with the VARIANT type:

* R0 strictness: Spark's ``try_parse_json`` alone accepts trailing text in some
  shapes; wrapping the text as ``[s]`` *and* ``{"r": s}`` and requiring both to
  parse to one element gives what a strict JSON reader accepts.
* absent vs JSON null (F22): ``try_variant_get(v, path, 'variant')`` is SQL NULL
  when the key is absent and a variant null (``is_variant_null``) for ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions import labels as L
from caliper.functions import rules
from caliper.functions.text import strip

MODES = ("fenced", "fenced_or_embedded", "embedded", "strict")
ERR_PARSE = "could not parse JSON"
ERR_NOT_OBJECT = "reply is not a JSON object"
ERR_SHAPE = "expected a list of exactly {k} items"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_json_strict(s) -> Column:
    """VARIANT of the whole text when it is exactly one JSON value, else NULL."""
    s = _c(s)
    a = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    b = F.try_parse_json(F.concat(F.lit('{"r":'), s, F.lit("}")))
    first = F.try_variant_get(a, "$[0]", "variant")
    one = F.try_variant_get(a, "$[1]", "variant").isNull()
    return F.when(a.isNotNull() & b.isNotNull() & one & first.isNotNull(), first)


def _first_to_last_brace(s: Column) -> Column:
    """Text from the first '{' to the last '}' (greedy, across lines), or NULL."""
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))


def extract_json(text, mode) -> Column:
    """The reply's JSON value as VARIANT (NULL when it cannot be parsed).
    ``mode`` is a mode name, or a Column holding one per row."""
    t = _c(text)
    if isinstance(mode, Column):
        expr = None
        for m in MODES:
            e = extract_json(t, m)
            expr = F.when(mode == m, e) if expr is None else expr.when(mode == m, e)
        return expr
    first, second = _candidates(t, mode)
    found = parse_json_strict(first)
    return found if second is None else F.coalesce(found, parse_json_strict(second))


def is_object(v) -> Column:
    """True for a JSON object: a cast to the empty struct succeeds only for objects
    (cheap; ``schema_of_variant`` would build the whole schema string)."""
    return F.try_variant_get(_c(v), "$", "struct<>").isNotNull()


def field(v, key: str) -> Column:
    """Variant of ``v.key``: SQL NULL if absent, variant null if JSON null."""
    return F.try_variant_get(_c(v), f"$.{key}", "variant")


def default_if_absent(value: Column, default: Column) -> Column:
    """``dict.get(key, default)``: the default only when the key is absent."""
    return F.when(value.isNull(), default).otherwise(value)


def variant_string(v) -> Column:
    """``str``-like text of a scalar variant; JSON null -> NULL."""
    return F.try_variant_get(_c(v), "$", "string")


def to_double_or_null(v) -> Column:
    """F19 on a variant: numbers, numeric strings and booleans convert; null, lists,
    objects and other strings give NULL (NaN -> NULL)."""
    d = F.try_variant_get(_c(v), "$", "double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def truthy(v) -> Column:
    """Python ``bool`` of a reply field: absent/null/false/0/""/[]/{} -> false."""
    v = _c(v)
    t = F.schema_of_variant(v)
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def variant_list(v, key: str) -> Column:
    """The list under ``key`` as array<variant>; not a list -> empty array."""
    arr = F.try_variant_get(_c(v), f"$.{key}", "array<variant>")
    return F.coalesce(arr, F.array().cast("array<variant>"))


def pad_topk(arr, k: int, filler: Column) -> Column:
    """pad to k with ``filler`` and cut to k (``filler`` has the element type)."""
    a = _c(arr)
    return F.slice(F.concat(a, F.array_repeat(filler, k)), 1, k)


def list_to_json(arr) -> Column:
    """F13d: the padded list kept verbatim as JSON text."""
    return F.to_json(_c(arr))


def _candidates(text: Column, mode: str):
    """(primary, fallback) candidate texts of one mode; None without a fallback."""
    if mode == "fenced":
        st = strip(text)
        return F.when(st.startswith("```"), strip(F.replace(F.replace(
            st, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))).otherwise(st), None
    if mode == "fenced_or_embedded":
        st = F.regexp_replace(F.regexp_replace(strip(text), r"(?iU)^```(?:json)?\s*", ""),
                              r"(?U)\s*```$", "")
        return st, _first_to_last_brace(st)
    if mode == "embedded":
        return text, _first_to_last_brace(text)
    if mode == "strict":
        return strip(text), None
    raise ValueError(f"unknown mode {mode!r}; one of {MODES}")


def parse_replies(df: DataFrame, text_col: str, mode="fenced_or_embedded",
                  on_error: str = "keep", list_key: str | None = None,
                  exact_items: int | None = None) -> DataFrame:
    """Add ``_reply`` (VARIANT object) and ``_error`` (NULL when fine).

    ``mode`` is a mode name, a Column naming one per row, or a list of names: then a text
    is parsed once for all of them that take the same part of it, and each row has in
    ``modes`` those that it holds for (every one of the list in one row of each text).
    ``exact_items`` (R5)
    requires ``list_key`` to be a list of exactly that many items.  ``on_error``:
    ``keep`` (error row kept, fields null), ``drop`` (error rows removed) or
    ``fail`` (the job raises on the first bad reply).

    Staged projections: candidate texts, then each wrapper parsed once, then the
    checks read the parsed columns (one parse per candidate and wrapper per row)."""
    cols = df.columns
    text = F.col(text_col)
    several = not isinstance(mode, (str, Column))
    second = "__c" if several else "__q"
    if several:
        parts = F.array(*[F.struct(F.lit(m).alias("mode"), p.cast("string").alias("p"),
                                   (F.lit(None) if q is None else q).cast("string").alias("q"))
                          for m in mode for p, q in [_candidates(text, m)]])
        each = df.select(*cols, parts.alias("__c")).select(
            "*", F.explode(F.array_distinct(F.transform("__c", lambda c: c["p"]))).alias("__p"))
        staged = each.select(*cols, "__p", F.filter("__c", lambda c: c["p"].eqNullSafe(F.col("__p"))).alias("__c"))
    else:
        if isinstance(mode, Column):
            prim = fall = None
            for m in MODES:
                p, q = _candidates(text, m)
                q = F.lit(None) if q is None else q
                prim = F.when(mode == m, p) if prim is None else prim.when(mode == m, p)
                fall = F.when(mode == m, q) if fall is None else fall.when(mode == m, q)
        else:
            prim, fall = _candidates(text, mode)
            fall = F.lit(None) if fall is None else fall
        staged = df.select(*cols, prim.cast("string").alias("__p"), fall.cast("string").alias("__q"))

    def wrap_a(c):
        return F.try_parse_json(F.concat(F.lit("["), F.col(c), F.lit("]")))

    def strict_ok(a, c):
        # ``&`` short-circuits: the second wrapper is parsed only when the first passed.
        return (F.col(a).isNotNull()
                & F.try_variant_get(F.col(a), "$[1]", "variant").isNull()
                & F.try_variant_get(F.col(a), "$[0]", "variant").isNotNull()
                & F.try_parse_json(F.concat(F.lit('{"r":'), F.col(c), F.lit("}"))).isNotNull())

    p1 = staged.select(*cols, "__p", second, wrap_a("__p").alias("__pa"))
    p2 = p1.select(*cols, second, "__pa", strict_ok("__pa", "__p").alias("__pok"))
    if several:     # modes whose first part failed go on by their second parts
        none = F.lit(None).cast("string")
        rest = F.when(F.col("__pok"), F.array(none)).otherwise(
            F.array_distinct(F.transform("__c", lambda c: c["q"])))
        held = F.filter("__c", lambda c: F.col("__pok") | c["q"].eqNullSafe(F.col("__q")))
        p2 = p2.select("*", F.explode(rest).alias("__q")).select(
            *cols, "__q", "__pa", "__pok", F.transform(held, lambda c: c["mode"]).alias("modes"))
        cols = [*cols, "modes"]
    # The fallback candidate is parsed only for rows whose primary candidate failed.
    p3 = p2.select(*cols, "__q", "__pa", "__pok",
                   F.when(~F.col("__pok"), wrap_a("__q")).alias("__qa"))
    p4 = p3.select(*cols, "__pa", "__pok", "__qa",
                   F.when(~F.col("__pok"), strict_ok("__qa", "__q")).alias("__qok"))
    v = p4.select(*cols, F.when(F.col("__pok"), F.try_variant_get("__pa", "$[0]", "variant"))
                  .when(F.col("__qok"), F.try_variant_get("__qa", "$[0]", "variant"))
                  .alias("_reply"))
    rv = F.col("_reply")
    err = F.when(rv.isNull(), F.lit(ERR_PARSE)).when(~is_object(rv), F.lit(ERR_NOT_OBJECT))
    if exact_items is not None and list_key is not None:
        n = F.size(F.try_variant_get(rv, f"$.{list_key}", "array<variant>"))
        err = err.when(F.coalesce(n, F.lit(-1)) != exact_items,
                       F.lit(ERR_SHAPE.format(k=exact_items)))
    out = v.withColumn("_error", err)
    out = out.withColumn("_reply", F.when(F.col("_error").isNull(), F.col("_reply")))
    if on_error == "drop":
        # Keep-or-drop as a 0/1-element explode rather than a Filter: a Filter on
        # _error is pushed below the staged projections with the whole parse inlined
        # into its condition (parsing twice and overflowing generated code).
        keep = F.explode(F.when(F.col("_error").isNull(), F.array(F.lit(True)))
                         .otherwise(F.array().cast("array<boolean>")))
        return out.select("*", keep.alias("__keep")).drop("__keep")
    if on_error == "fail":
        return out.withColumn("_error", F.when(F.col("_error").isNotNull(), F.raise_error(
            F.concat(F.lit("bad reply: "), F.col("_error")))).cast("string"))
    if on_error != "keep":
        raise ValueError("on_error must be keep, drop or fail")
    return out


def _json_lit(text: str) -> Column:
    return F.parse_json(F.lit(text))


def family_top3(df: DataFrame, reply: str = "_reply", list_key: str = "top3_differential",
                k: int = 3) -> DataFrame:
    """Typed fields of the paired-image reply shape: top{r}_diagnosis / _family /
    _probability for r = 1..k and ``n_items``; the primary fields use the
    absent-vs-null defaults of F22 and the list is padded with ('', MISC, 0.0)
    (F12).  A JSON-null family normalises to MISC; a probability that does not
    convert is NULL (F19).  Rows whose reply is NULL get NULL fields.

    List items are read by path (``$.list[i].field``) with an existence test per
    index, so no ``array<variant>`` copy of the list is built; one variant per field
    is projected first, then the typed conversions read those columns."""
    import json

    cols = df.columns
    rv = F.col(reply)
    filler = rules.TOPK_FILLER_FAMILY

    def item(i, name, default):
        exists = F.try_variant_get(rv, f"$.{list_key}[{i}]", "variant").isNotNull()
        val = F.try_variant_get(rv, f"$.{list_key}[{i}].{name}", "variant")
        return F.when(~exists, _json_lit(json.dumps(filler[name]))) \
            .otherwise(default_if_absent(val, default))

    raw = [
        default_if_absent(field(rv, "primary_diagnosis"), item(0, "diagnosis", _json_lit('""'))),
        default_if_absent(field(rv, "primary_family"), item(0, "family", _json_lit('"MISC"'))),
        default_if_absent(field(rv, "top1_probability"),
                          item(0, "probability", F.lit(None).cast("variant"))),
    ]
    for i in range(1, k):
        raw += [item(i, "diagnosis", _json_lit('""')), item(i, "family", _json_lit('"MISC"')),
                item(i, "probability", _json_lit("0.0"))]
    s2 = df.select(*cols, F.size(variant_list(rv, list_key)).alias("__n"),
                   *[r.alias(f"__v{i}") for i, r in enumerate(raw)])
    typed = []
    for r in range(k):
        d, f, p = (F.col(f"__v{3 * r + j}") for j in range(3))
        typed += [(f"top{r + 1}_diagnosis", variant_string(d)),
                  (f"top{r + 1}_family", L.normalize_family(variant_string(f))),
                  (f"top{r + 1}_probability", to_double_or_null(p))]
    typed.append(("n_items", F.col("__n")))
    return s2.select(*cols, *[F.when(rv.isNotNull(), e).alias(name) for name, e in typed])


def differential(reply="_reply", list_key: str = "differential", k: int = 3,
                 two_class: bool = False) -> Column:
    """Archive / lesion reply shape ``{"differential": [{diagnosis, confidence}]}``:
    array<struct(diagnosis, confidence)> of the first k items; with ``two_class``
    each diagnosis collapses to melanoma / melanocytic nevus (F11) and the list is
    padded with the two-class filler (F12)."""
    items = F.slice(variant_list(reply, list_key), 1, k)
    typed = F.transform(items, lambda it: F.struct(
        F.coalesce(variant_string(field(it, "diagnosis")), F.lit("")).alias("diagnosis"),
        F.coalesce(to_double_or_null(default_if_absent(field(it, "confidence"),
                                                       _json_lit("0.0"))), F.lit(None))
        .alias("confidence")))
    if not two_class:
        return typed
    collapsed = F.transform(typed, lambda it: F.struct(
        L.collapse_two_class(it["diagnosis"]).alias("diagnosis"),
        it["confidence"].alias("confidence")))
    f = rules.TOPK_FILLER_TWO_CLASS
    filler = F.struct(F.lit(f["diagnosis"]).alias("diagnosis"),
                      F.lit(float(f["confidence"])).alias("confidence"))
    return pad_topk(collapsed, k, filler)


def _number(reply, key: str) -> Column:
    """A reply field as double; absent, null or not a number -> NULL."""
    return to_double_or_null(field(reply, key))


def _flag(reply, key: str) -> Column:
    """A reply field as 0/1 (absent -> 0); numeric text and booleans convert."""
    f = field(reply, key)
    return F.when(f.isNull(), F.lit(0)).otherwise(to_double_or_null(f).cast("int"))


def _text(reply, key: str) -> Column:
    return F.coalesce(variant_string(field(reply, key)), F.lit(""))


def target_fields(df: DataFrame, reply: str = "_reply", targets=("melanoma", "malignancy"),
                  rationale: str = "brief_rationale") -> DataFrame:
    """Per target the reply's ``<t>_probability`` (absent or no number -> NULL) and
    ``<t>_prediction`` (absent -> 0), and its rationale ('' if absent)."""
    cols = {}
    for t in targets:
        cols[f"{t}_probability"] = _number(reply, f"{t}_probability")
        cols[f"{t}_prediction"] = _flag(reply, f"{t}_prediction")
    return df.withColumns({**cols, "rationale": _text(reply, rationale)})


#: Fields of a fusion reply: flags, numbers and texts.
FUSION_FLAGS = ("followed_resnet", "followed_siim")
FUSION_NUMBERS = {"resnet_weight": "resnet_weight", "siim_weight": "siim_weight", "confidence": "fusion_confidence"}
FUSION_TEXTS = ("melanoma_decision_basis", "malignancy_decision_basis")


def fusion_fields(df: DataFrame, reply: str = "_reply", flags=FUSION_FLAGS, numbers=None,
                  texts=FUSION_TEXTS) -> DataFrame:
    """``target_fields`` and what else a fusion reply says: which model it followed
    (Python truth value), the weights and its confidence, and its reasons."""
    numbers = FUSION_NUMBERS if numbers is None else numbers
    return target_fields(df, reply).withColumns({
        **{k: truthy(field(reply, k)) for k in flags},
        **{out: _number(reply, k) for k, out in numbers.items()},
        **{k: _text(reply, k) for k in texts}})


def binary_fields(df: DataFrame, reply: str = "_reply", flag: str = "is_melanoma",
                  number: str = "likelihood", rationale: str = "rationale",
                  labels=tuple(rules.MELANOMA_LABELS)) -> DataFrame:
    """A yes/no reply: pred_is_positive (truth value), pred_label (the second of
    ``labels`` if positive), pred_likelihood (absent -> 0.0), pred_rationale.  Error
    rows (no reply) get an empty label and NULLs."""
    ok = F.col(reply).isNotNull()
    yes = truthy(field(reply, flag))
    n = field(reply, number)
    return df.withColumns({
        "pred_is_positive": F.when(ok, yes),
        "pred_label": F.when(ok, F.when(yes, labels[1]).otherwise(labels[0])).otherwise(""),
        "pred_likelihood": F.when(ok, F.when(n.isNull(), 0.0).otherwise(to_double_or_null(n))),
        "pred_rationale": F.when(ok, _text(reply, rationale))})


def label_confidence(df: DataFrame, reply: str = "_reply", label: str = "pred",
                     number: str = "confidence") -> DataFrame:
    """A reply of a label and its confidence: pred_label ('' if absent), confidence."""
    return df.withColumns({"pred_label": _text(reply, label), "confidence": _number(reply, number)})
