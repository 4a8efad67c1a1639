"""Reply parsing on the driver tables.

Recipe: every event gets a model-reply text assembled from its columns, with the
shape chosen by ``event_id % 8``: 0 clean JSON, 1 fenced in a code block, 2
embedded in prose, 3 a list of two items, 4 ``primary_family`` null, 5
``primary_family`` and ``top1_probability`` absent, 6 probability as a string,
7 two objects back to back (even user) or no JSON at all (odd user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions import rules
from caliper.operators import replies as R
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import dealt, table

REPLY_DX = ["Melanoma", "melanocytic nevus", "Basal cell carcinoma", "Seborrheic keratosis",
            "Dermatofibroma", "Hemangioma", "Squamous cell carcinoma", "Lentigo maligna",
            "Solar lentigo", "Actinic keratosis"]
REPLY_FAM = ["MEL", "melanoma", "NV", "nevus", "BCC", "SK", "vascular", "scc", "misc", "unknown",
             "DF"]
FENCE = "```"


def _arr(xs):
    return F.array(*[F.lit(x) for x in xs])


def reply_text(spark: SparkSession, d: str) -> DataFrame:
    e = dealt(table(spark, d, "events").select("event_id", "user_id"))
    eid, uid = F.col("event_id"), F.col("user_id")
    k = eid % 8

    def dx(off):
        return F.element_at(_arr(REPLY_DX), ((uid + off) % len(REPLY_DX) + 1).cast("int"))

    def fam(off):
        return F.element_at(_arr(REPLY_FAM), ((uid + off) % len(REPLY_FAM) + 1).cast("int"))

    def prob(mult):
        return F.concat(F.lit("0."), F.lpad(((eid * mult) % 100).cast("string"), 2, "0"))

    def item(i):
        return F.concat(F.lit('{"diagnosis": "'), dx(i), F.lit('", "family": "'), fam(i),
                        F.lit('", "probability": '), prob(i + 3), F.lit("}"))

    items = F.when(k == 3, F.concat(F.lit("["), item(0), F.lit(", "), item(1), F.lit("]"))) \
        .otherwise(F.concat(F.lit("["), item(0), F.lit(", "), item(1), F.lit(", "), item(2),
                            F.lit("]")))
    head_fam = (F.when(k == 4, F.lit('"primary_family": null, ')).when(k == 5, F.lit(""))
                .otherwise(F.concat(F.lit('"primary_family": "'), fam(7), F.lit('", '))))
    head_prob = (F.when(k == 5, F.lit(""))
                 .when(k == 6, F.concat(F.lit('"top1_probability": "'), prob(11), F.lit('", ')))
                 .otherwise(F.concat(F.lit('"top1_probability": '), prob(11), F.lit(", "))))
    obj = F.concat(F.lit('{"primary_diagnosis": "'), dx(0), F.lit('", '), head_fam, head_prob,
                   F.lit('"top3_differential": '), items, F.lit("}"))
    text = (F.when(k == 1, F.concat(F.lit(FENCE + "json\n"), obj, F.lit("\n" + FENCE)))
            .when(k == 2, F.concat(F.lit("Sure, here it is: "), obj, F.lit(" Hope this helps.")))
            .when((k == 7) & (uid % 2 == 0), F.concat(obj, F.lit(" "), obj))
            .when(k == 7, F.lit("I cannot tell from this image."))
            .otherwise(obj))
    return e.select("event_id", "user_id", text.alias("text"))


# ------------------------------------------------------------------ SQL oracle
def _sl(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_DX = lambda off: f"{_sl(REPLY_DX)}[(user_id + {off}) % {len(REPLY_DX)} + 1]"
_FM = lambda off: f"{_sl(REPLY_FAM)}[(user_id + {off}) % {len(REPLY_FAM)} + 1]"
_PR = lambda m: f"('0.' || lpad(CAST((event_id * {m}) % 100 AS VARCHAR), 2, '0'))"


def _item_sql(i):
    return (f"'{{\"diagnosis\": \"' || {_DX(i)} || '\", \"family\": \"' || {_FM(i)} "
            f"|| '\", \"probability\": ' || {_PR(i + 3)} || '}}'")


REPLY_SQL = f"""
rt0 AS (
  SELECT event_id, user_id, event_id % 8 AS k,
    '{{"primary_diagnosis": "' || {_DX(0)} || '", ' ||
    CASE WHEN event_id % 8 = 4 THEN '"primary_family": null, '
         WHEN event_id % 8 = 5 THEN ''
         ELSE '"primary_family": "' || {_FM(7)} || '", ' END ||
    CASE WHEN event_id % 8 = 5 THEN ''
         WHEN event_id % 8 = 6 THEN '"top1_probability": "' || {_PR(11)} || '", '
         ELSE '"top1_probability": ' || {_PR(11)} || ', ' END ||
    '"top3_differential": ' ||
    CASE WHEN event_id % 8 = 3 THEN '[' || {_item_sql(0)} || ', ' || {_item_sql(1)} || ']'
         ELSE '[' || {_item_sql(0)} || ', ' || {_item_sql(1)} || ', ' || {_item_sql(2)} || ']'
    END || '}}' AS obj
  FROM events),
rt AS (
  SELECT event_id, user_id,
    CASE WHEN k = 1 THEN '{FENCE}json' || chr(10) || obj || chr(10) || '{FENCE}'
         WHEN k = 2 THEN 'Sure, here it is: ' || obj || ' Hope this helps.'
         WHEN k = 7 AND user_id % 2 = 0 THEN obj || ' ' || obj
         WHEN k = 7 THEN 'I cannot tell from this image.'
         ELSE obj END AS text
  FROM rt0)"""


def _strip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _ok(e):
    return f"(CASE WHEN json_valid({e}) THEN {e} END)"


def _brace(e):
    return f"nullif(regexp_extract({e}, '(?s)\\{{.*\\}}', 0), '')"


_ST = _strip("text")
_UNFENCED = f"replace(replace({_ST}, '{FENCE}json', ''), '{FENCE}', '')"
_R1 = f"CASE WHEN starts_with({_ST}, '{FENCE}') THEN {_strip(_UNFENCED)} ELSE {_ST} END"
_R2S = f"regexp_replace(regexp_replace({_strip('text')}, '(?i)^{FENCE}(?:json)?\\s*', ''), '\\s*{FENCE}$', '')"

PARSED_SQL = f"""
pm AS (
  SELECT event_id, 'fenced' AS mode, {_ok(_R1)} AS j FROM rt
  UNION ALL SELECT event_id, 'fenced_or_embedded', coalesce({_ok(_R2S)}, {_ok(_brace(_R2S))}) FROM rt
  UNION ALL SELECT event_id, 'embedded', coalesce({_ok('text')}, {_ok(_brace('text'))}) FROM rt
  UNION ALL SELECT event_id, 'strict', {_ok(_strip('text'))} FROM rt),
pj AS (
  SELECT event_id, mode,
         CASE WHEN j IS NULL THEN '{R.ERR_PARSE}'
              WHEN json_type(j) <> 'OBJECT' THEN '{R.ERR_NOT_OBJECT}' END AS error,
         CASE WHEN j IS NOT NULL AND json_type(j) = 'OBJECT' THEN j END AS j
  FROM pm)"""

_ALIAS_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in rules.FAMILY_ALIASES.items()) + "}"


def _norm_fam(e):
    return f"coalesce(map_extract({_ALIAS_MAP}, upper({_strip(e)}))[1], 'MISC')"


def _n_items():
    return ("CASE WHEN json_type(j, '$.top3_differential') = 'ARRAY' "
            "THEN json_array_length(j, '$.top3_differential') ELSE 0 END")


def _item_field(i, name, default_sql):
    """Field of padded item i: filler when i >= n; key absent -> default."""
    f = rules.TOPK_FILLER_FAMILY[name]
    filler = f"'{f}'" if isinstance(f, str) else f"'{f}'"
    path = f"'$.top3_differential[{i}].{name}'"
    return (f"CASE WHEN {i} >= {_n_items()} THEN {filler} "
            f"WHEN json_extract(j, {path}) IS NULL THEN {default_sql} "
            f"ELSE json_extract_string(j, {path}) END")


def _dbl(e):
    return f"try_cast({_strip(e)} AS DOUBLE)"


FIELDS_SQL = f"""
SELECT event_id, mode, error,
  CASE WHEN j IS NOT NULL THEN
    CASE WHEN json_extract(j, '$.primary_diagnosis') IS NULL THEN {_item_field(0, 'diagnosis', "''")}
         ELSE json_extract_string(j, '$.primary_diagnosis') END END AS top1_diagnosis,
  CASE WHEN j IS NOT NULL THEN {_norm_fam(
      "CASE WHEN json_extract(j, '$.primary_family') IS NULL THEN " + _item_field(0, 'family', "'MISC'")
      + " ELSE json_extract_string(j, '$.primary_family') END")} END AS top1_family,
  CASE WHEN j IS NOT NULL THEN round({_dbl(
      "CASE WHEN json_extract(j, '$.top1_probability') IS NULL THEN " + _item_field(0, 'probability', 'NULL')
      + " ELSE json_extract_string(j, '$.top1_probability') END")}, 6) END AS top1_probability,
  CASE WHEN j IS NOT NULL THEN {_item_field(1, 'diagnosis', "''")} END AS top2_diagnosis,
  CASE WHEN j IS NOT NULL THEN {_norm_fam(_item_field(1, 'family', "'MISC'"))} END AS top2_family,
  CASE WHEN j IS NOT NULL THEN round({_dbl(_item_field(1, 'probability', "'0.0'"))}, 6) END
    AS top2_probability,
  CASE WHEN j IS NOT NULL THEN {_item_field(2, 'diagnosis', "''")} END AS top3_diagnosis,
  CASE WHEN j IS NOT NULL THEN {_norm_fam(_item_field(2, 'family', "'MISC'"))} END AS top3_family,
  CASE WHEN j IS NOT NULL THEN round({_dbl(_item_field(2, 'probability', "'0.0'"))}, 6) END
    AS top3_probability,
  CASE WHEN j IS NOT NULL THEN CAST({_n_items()} AS INTEGER) END AS n_items
FROM pj"""


def _typed(df: DataFrame) -> DataFrame:
    typed = R.family_top3(df.select("event_id", "modes", F.col("_error").alias("error"), "_reply"),
                          "_reply").drop("_reply")
    return typed.select("event_id", F.explode("modes").alias("mode"), *typed.columns[2:])


@plan("parse_replies", f"""
WITH {REPLY_SQL},
{PARSED_SQL}
{FIELDS_SQL}""")
def parse_replies(spark, d):
    """R0-R4 + R6 keep + F12 + F19 + F22: four parse modes over every reply."""
    parsed = R.parse_replies(reply_text(spark, d).drop("user_id"), "text", mode=R.MODES, on_error="keep")
    return rounded(_typed(parsed))
