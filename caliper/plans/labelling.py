"""Truth / prediction labelling rules on the driver tables.

Recipe: every part row gets a diagnosis text ``element_at(DX_TEXTS, 1 + p_partkey
% n)`` (null when p_partkey % 37 = 0) and a reply family text
``element_at(FAMILY_TEXTS, 1 + p_size % m)``.  The two lists are invented test
inputs covering every rule branch; the same lists are inlined in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions import labels as L
from caliper.functions import rules
from caliper.functions.text import norm_dx2
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import dealt, table

DX_TEXTS = [
    "Melanoma (in situ)", "basal cell carcinoma", "clark nevus", "seborrheic keratosis", "BCC",
    "nevus with squamous cell carcinoma", "Dermatofibroma", "hemangioma",
    "squamous cell carcinoma", "  Seborrhoeic Keratosis\t", "lentigo maligna", "solar lentigo",
    "Dysplastic nevus", "Bowen's disease", "actinic keratoses", "Cherry angioma", "scc",
    "Indeterminate (malignant?)", "Benign", "Malignant", "naevus", "wart", "tinea corporis",
    "tattoo", "poroma", "mastocytoma", "", "vascular lesion", "keratoacanthoma", "miscellaneous",
    "atypical nevus", "lichenoid keratosis", "ACTINIC KERATOSIS", "mole on back",
]
FAMILY_TEXTS = [
    "melanoma", " mel ", "Basal Cell Carcinoma", "sk", "Nevus", "VASCULAR", "scc", "misc",
    "unknown", "Seborrhoeic keratosis", "DF", "naevus", "SCCKA", "bkl", "",
]


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"
                           for x in xs) + "]"


def _sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _sql_lower_strip(e: str) -> str:
    return f"coalesce(lower({_sql_strip(e)}), '')"


def _sql_norm(e: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({_sql_strip(e)}), '[^a-z0-9]+', ' ', 'g')), '')"


def _sql_any(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, '{x}')" for x in terms) + ")"


def _sql_family(t: str, exact=None) -> str:
    exact = exact or {}
    parts = []
    for fam, terms in rules.FAMILY_RULES:
        cond = _sql_any(t, terms)
        if fam in exact:
            cond = f"({cond} OR {t} IN ({', '.join(repr(x) for x in exact[fam])}))"
        parts.append(f"WHEN {cond} THEN '{fam}'")
    return "CASE " + " ".join(parts) + f" ELSE '{rules.FAMILY_DEFAULT}' END"


def _sql_group(e: str) -> str:
    p = _sql_norm(e)
    parts = [f"WHEN regexp_matches({p}, '\\b(" + "|".join(terms) + f")\\b') THEN '{g}'"
             for terms, g in rules.DX_GROUP_RULES]
    return f"CASE WHEN {e} IS NULL THEN NULL " + " ".join(parts) + " ELSE NULL END"


PART_DX_SQL = f"""
px AS (
  SELECT p_partkey, p_size, p_retailprice,
         CASE WHEN p_partkey % 37 = 0 THEN NULL
              ELSE {_sql_list(DX_TEXTS)}[1 + p_partkey % {len(DX_TEXTS)}] END AS dx,
         {_sql_list(DX_TEXTS)}[1 + (p_partkey + 1) % {len(DX_TEXTS)}] AS dx_next1,
         {_sql_list(DX_TEXTS)}[1 + (p_partkey + 2) % {len(DX_TEXTS)}] AS dx_next2,
         {_sql_list(DX_TEXTS)}[1 + (p_partkey + 5) % {len(DX_TEXTS)}] AS dx_truth,
         {_sql_list(FAMILY_TEXTS)}[1 + p_size % {len(FAMILY_TEXTS)}] AS fam_text
  FROM part)"""


def part_dx(spark: SparkSession, d: str) -> DataFrame:
    dx = F.array(*[F.lit(x) for x in DX_TEXTS])
    fams = F.array(*[F.lit(x) for x in FAMILY_TEXTS])
    k = F.col("p_partkey")
    n = len(DX_TEXTS)
    return table(spark, d, "part").select(
        "p_partkey", "p_size", "p_retailprice",
        F.when(k % 37 == 0, F.lit(None)).otherwise(F.element_at(dx, (k % n + 1).cast("int")))
        .alias("dx"),
        F.element_at(dx, ((k + 1) % n + 1).cast("int")).alias("dx_next1"),
        F.element_at(dx, ((k + 2) % n + 1).cast("int")).alias("dx_next2"),
        F.element_at(dx, ((k + 5) % n + 1).cast("int")).alias("dx_truth"),
        F.element_at(fams, (F.col("p_size") % len(FAMILY_TEXTS) + 1).cast("int")).alias("fam_text"))


_T = _sql_lower_strip("dx")


@plan("label_rules", f"""
WITH {PART_DX_SQL},
lb AS (
  SELECT p_partkey, dx,
         CAST({_sql_any(_T, rules.MALIGNANT_TERMS)} AS INTEGER) AS y_malignant,
         CAST({_sql_any(_T, rules.MELANOMA_TERMS)} AS INTEGER) AS y_melanoma,
         {_sql_family(_T)} AS family,
         {_sql_family(_T, rules.FAMILY_EXACT_CODES)} AS family_codes,
         coalesce(map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in rules.FAMILY_ALIASES.items())}}},
                              upper({_sql_strip("fam_text")}))[1], 'MISC') AS reply_family
  FROM px)
SELECT p_partkey, dx, y_malignant, y_melanoma, family, family_codes,
       CAST(family_codes IN ({", ".join(f"'{x}'" for x in rules.MALIGNANT_FAMILIES)}) AS INTEGER)
         AS y_malignant_family,
       CAST(family_codes IN ({", ".join(f"'{x}'" for x in rules.MELANOMA_FAMILIES)}) AS INTEGER)
         AS y_melanoma_family,
       reply_family
FROM lb""")
def label_rules(spark, d):
    """F1 + F2 (both variants) + F3 + F4 per part row."""
    p = part_dx(spark, d)
    out = p.select(
        "p_partkey", "dx",
        L.label_binary("dx").alias("b"),
        L.label_family("dx").alias("family"),
        L.label_family("dx", exact_codes=rules.FAMILY_EXACT_CODES).alias("family_codes"),
        L.normalize_family("fam_text").alias("reply_family"))
    return out.select(
        "p_partkey", "dx", "b.y_malignant", "b.y_melanoma", "family", "family_codes",
        L.labels_from_family("family_codes").alias("f"), "reply_family",
    ).select("p_partkey", "dx", "y_malignant", "y_melanoma", "family", "family_codes",
             F.col("f.y_malignant").alias("y_malignant_family"),
             F.col("f.y_melanoma").alias("y_melanoma_family"), "reply_family")


def _sql_two_class(e: str) -> str:
    t = _sql_lower_strip(e)
    mel, nev = rules.TWO_CLASSES
    return (f"CASE WHEN {t} = '' THEN '' WHEN contains({t}, 'indeterminate') THEN '{nev}' "
            f"WHEN contains({t}, 'melanoma') OR contains({t}, 'malignant') THEN '{mel}' "
            f"WHEN contains({t}, 'nevus') OR contains({t}, 'naevus') OR contains({t}, 'benign') "
            f"THEN '{nev}' ELSE '' END")


def _sql_melanoma(e: str) -> str:
    t = _sql_lower_strip(e)
    non, mel = rules.MELANOMA_LABELS
    return (f"CASE WHEN contains({t}, 'indeterminate') THEN '{non}' "
            f"WHEN contains({t}, 'malignant') OR contains({t}, 'melanoma') THEN '{mel}' "
            f"WHEN contains({t}, 'benign') THEN '{non}' ELSE '' END")


@plan("truth_canon", f"""
WITH {PART_DX_SQL}
SELECT p_partkey, dx, {_sql_two_class("dx")} AS truth_two_class,
       {_sql_melanoma("dx")} AS truth_melanoma,
       CASE WHEN contains(lower(coalesce(dx, '')), 'melanoma') THEN 'melanoma'
            ELSE 'melanocytic nevus' END AS pred_two_class
FROM px""")
def truth_canon(spark, d):
    """F5 + F6 + F11: archive truth canonicalisation and two-class collapse."""
    p = part_dx(spark, d)
    return p.select("p_partkey", "dx",
                    L.canon_truth_two_class("dx").alias("truth_two_class"),
                    L.canon_truth_melanoma("dx").alias("truth_melanoma"),
                    L.collapse_two_class("dx").alias("pred_two_class"))


_MAL_GROUPS = ", ".join(f"'{g}'" for g in rules.MALIGNANT_DX_GROUPS)


@plan("dx_groups", f"""
WITH {PART_DX_SQL},
g AS (SELECT p_partkey, dx, dx_next1, dx_next2, dx_truth,
             {_sql_norm("dx")} AS dx_norm, {_sql_group("dx")} AS grp,
             {_sql_group("dx_next1")} AS g1, {_sql_group("dx_next2")} AS g2,
             {_sql_norm(_sql_group("dx_truth"))} AS truth_norm
      FROM px)
SELECT p_partkey, dx_norm, grp,
       coalesce({_sql_norm("grp")} IN ({_MAL_GROUPS}), false) AS grp_malignant,
       truth_norm <> '' AND (truth_norm = {_sql_norm("grp")}
                             OR truth_norm = {_sql_norm("g1")}
                             OR truth_norm = {_sql_norm("g2")}) AS hit_at3,
       truth_norm <> '' AND truth_norm = {_sql_norm("grp")} AS hit_at1
FROM g""")
def dx_groups(spark, d):
    """F7 + F8 + F9 + F10: normalise, map to groups, malignant flag, hit@1 / hit@3."""
    p = dealt(part_dx(spark, d))
    preds = F.array("dx", "dx_next1", "dx_next2")
    truth = L.dx_to_group("dx_truth")
    return p.select(
        "p_partkey", norm_dx2("dx").alias("dx_norm"), L.dx_to_group("dx").alias("grp"),
        L.is_malignant_group(L.dx_to_group("dx")).alias("grp_malignant"),
        L.hit_at_k(truth, preds, 3).alias("hit_at3"),
        L.hit_at_k(truth, preds, 1).alias("hit_at1"))


@plan("prediction_flags", f"""
WITH {PART_DX_SQL},
s AS (SELECT p_partkey, dx, CAST(p_retailprice AS DOUBLE) / 2000.0 AS score,
             CASE WHEN p_size % 2 = 0 THEN 'Malignant' ELSE 'Benign' END AS pred_label,
             CAST(p_size AS DOUBLE) / 50.0 AS conf,
             {_sql_family(_sql_lower_strip("dx"))} AS family,
             {_sql_family(_sql_lower_strip("dx_next1"))} AS family1,
             {_sql_family(_sql_lower_strip("dx_next2"))} AS family2,
             {_sql_family(_sql_lower_strip("dx_truth"))} AS gt_family
      FROM px)
SELECT p_partkey,
       CAST(coalesce(score >= {rules.RESNET_MEL_THRESHOLD}, false) AS INTEGER) AS mel_flag,
       CAST(coalesce(score >= {rules.RESNET_MALIGNANCY_THRESHOLD}, false) AS INTEGER) AS mal_flag,
       CAST(coalesce(score >= {rules.SIIM_MEL_THRESHOLD}, false) AS INTEGER) AS siim_flag,
       round(CASE WHEN pred_label = 'Malignant' THEN conf ELSE 1.0 - conf END, 6) AS p_malignant,
       CAST(coalesce(family = gt_family, false) AS INTEGER) AS top1_correct,
       CAST(coalesce(gt_family IN (family, family1, family2), false) AS INTEGER) AS top3_correct,
       coalesce(family, '') <> '' AND coalesce(gt_family, '') <> '' AND family = gt_family
         AS correct
FROM s""")
def prediction_flags(spark, d):
    """F13 + F13b + F15 + F16: top-1/top-3 flags, threshold flags, P(malignant)."""
    p = part_dx(spark, d).select(
        "p_partkey", (F.col("p_retailprice") / 2000.0).alias("score"),
        F.when(F.col("p_size") % 2 == 0, "Malignant").otherwise("Benign").alias("pred_label"),
        (F.col("p_size").cast("double") / 50.0).alias("conf"),
        L.label_family("dx").alias("family"), L.label_family("dx_next1").alias("family1"),
        L.label_family("dx_next2").alias("family2"), L.label_family("dx_truth").alias("gt_family"))
    return rounded(p.select(
        "p_partkey",
        L.threshold_flag("score", rules.RESNET_MEL_THRESHOLD).alias("mel_flag"),
        L.threshold_flag("score", rules.RESNET_MALIGNANCY_THRESHOLD).alias("mal_flag"),
        L.threshold_flag("score", rules.SIIM_MEL_THRESHOLD).alias("siim_flag"),
        L.prob_from_label("pred_label", "conf").alias("p_malignant"),
        L.flag_equal("family", "gt_family").alias("top1_correct"),
        L.flag_in("gt_family", ["family", "family1", "family2"]).alias("top3_correct"),
        L.correct_flag("family", "gt_family").alias("correct")))
