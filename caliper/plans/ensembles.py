"""Ensembles, family roll-ups and top-k on the driver tables.

Recipes (shared with the SQL oracles):
  * checkpoint scores: one row per order; six checkpoints from numeric expressions
    over the order columns, architecture = checkpoint index % 3; one checkpoint is
    null for status 'P' orders (skipped by the means).
  * class scores: ``embeddings.embedding`` (64 values) are the logits; fold f in
    0..4 scales them by (10 + f) / 10; class i is ``class_i`` of family
    MODEL_FAMILIES[i % 11]; the truth family is MODEL_FAMILIES[label].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions import rules
from caliper.operators import ensemble, prefix
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import dealt, table

_CHECKPOINTS = [
    ("c0", "arch0", "CAST(o_totalprice AS DOUBLE) / 600000.0"),
    ("c1", "arch1", "CAST(o_custkey % 97 AS DOUBLE) / 97.0"),
    ("c2", "arch2", "CAST(o_orderkey % 101 AS DOUBLE) / 101.0"),
    ("c3", "arch0", "CASE WHEN o_orderstatus = 'P' THEN NULL "
                    "ELSE CAST(o_orderkey % 89 AS DOUBLE) / 89.0 END"),
    ("c4", "arch1", "CAST((o_orderkey * 7 + o_custkey) % 113 AS DOUBLE) / 113.0"),
    ("c5", "arch2", "CAST(o_custkey % 13 AS DOUBLE) / 13.0"),
]

CHECKPOINT_SQL = "ck AS (" + "\n  UNION ALL ".join(
    f"SELECT o_orderkey AS row_id, '{c}' AS checkpoint, '{a}' AS arch, {e} AS prob FROM orders"
    for c, a, e in _CHECKPOINTS) + ")"


def checkpoint_scores(spark: SparkSession, d: str) -> DataFrame:
    """Long (row_id, checkpoint, arch, prob): one generator over the orders scan."""
    o = table(spark, d, "orders")
    cells = F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.lit(a).alias("arch"),
                               F.expr(e).cast("double").alias("prob"))
                      for c, a, e in _CHECKPOINTS])
    return (o.select(F.col("o_orderkey").alias("row_id"), F.explode(cells).alias("__c"))
            .select("row_id", "__c.checkpoint", "__c.arch", "__c.prob"))


@plan("ensemble_scores", f"""
WITH {CHECKPOINT_SQL},
am AS (SELECT row_id, arch, avg(prob) AS arch_mean FROM ck GROUP BY row_id, arch),
nn AS (SELECT row_id, arch, arch_mean,
              (rank() OVER (PARTITION BY arch ORDER BY arch_mean)
               + (count(*) OVER (PARTITION BY arch, arch_mean) - 1) / 2.0)
              / count(*) OVER (PARTITION BY arch) AS arch_rank
       FROM am WHERE arch_mean IS NOT NULL),
rk AS (SELECT am.row_id, am.arch, am.arch_mean, nn.arch_rank FROM am LEFT JOIN nn
       ON am.row_id = nn.row_id AND am.arch = nn.arch)
SELECT row_id, round(avg(arch_mean), 6) AS prob_ensemble, round(avg(arch_rank), 6) AS rank_ensemble
FROM rk GROUP BY row_id""")
def ensemble_scores(spark, d):
    """A23 + A24 + W1: two-level mean and mean per-architecture percentile rank."""
    return rounded(ensemble.ensemble_scores(checkpoint_scores(spark, d)))


@plan("architecture_pct_rank", f"""
WITH {CHECKPOINT_SQL},
am AS (SELECT row_id, arch, avg(prob) AS arch_mean FROM ck GROUP BY row_id, arch),
nn AS (SELECT row_id, arch,
              (rank() OVER (PARTITION BY arch ORDER BY arch_mean)
               + (count(*) OVER (PARTITION BY arch, arch_mean) - 1) / 2.0)
              / count(*) OVER (PARTITION BY arch) AS arch_rank
       FROM am WHERE arch_mean IS NOT NULL)
SELECT am.row_id, am.arch, round(am.arch_mean, 6) AS arch_mean, round(nn.arch_rank, 6) AS arch_rank
FROM am LEFT JOIN nn ON am.row_id = nn.row_id AND am.arch = nn.arch""")
def architecture_pct_rank(spark, d):
    """W1 on its own: average-tie percentile rank of each architecture mean."""
    am = ensemble.ensemble_mean(checkpoint_scores(spark, d))
    return rounded(ensemble.pct_rank_avg(am, ["arch"], "arch_mean", out="arch_rank")
                   .select("row_id", "arch", "arch_mean", "arch_rank"))


@plan("checkpoint_matrix", f"""
WITH {CHECKPOINT_SQL}
SELECT row_id, {", ".join(f"round(max(prob) FILTER (WHERE checkpoint = '{c}'), 6) AS {c}"
                          for c, _, _ in _CHECKPOINTS)}
FROM ck GROUP BY row_id""")
def checkpoint_matrix(spark, d):
    """Wide matrix, one column per checkpoint of the (fixed) roster."""
    return rounded(ensemble.wide_checkpoint_matrix(
        checkpoint_scores(spark, d), [c for c, _, _ in _CHECKPOINTS]))


# ---------------------------------------------------------------- class scores
_FAMS = ", ".join(f"'{f}'" for f in rules.MODEL_FAMILIES)
N_FOLDS = 5

FOLD_SQL = f"""
lx AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS class_idx,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
lg AS (SELECT vec_id, label, f.range AS fold, class_idx,
              x * (CAST(10 + f.range AS DOUBLE) / 10.0) AS logit
       FROM lx, range({N_FOLDS}) f),
mx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id, fold)) AS e FROM lg),
sm AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, fold) AS p FROM mx),
cp AS (SELECT vec_id, class_idx, avg(p) AS mean, stddev_samp(p) AS sd
       FROM sm GROUP BY vec_id, class_idx),
cf AS (SELECT cp.*, 'class_' || CAST(class_idx AS VARCHAR) AS class,
              [{_FAMS}][class_idx % 11 + 1] AS family FROM cp)"""


def fold_logits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return (e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1))).alias("fold"),
                     "embedding")
            .select("vec_id", "fold", F.transform(
                "embedding", lambda x: x.cast("double")
                * ((F.lit(10) + F.col("fold")).cast("double") / 10.0)).alias("logits")))


def class_dim(spark: SparkSession) -> DataFrame:
    fams = F.array(*[F.lit(f) for f in rules.MODEL_FAMILIES])
    return ensemble.class_dim(
        spark, 64, lambda i: F.concat(F.lit("class_"), i.cast("string")),
        lambda i: F.element_at(fams, (i % 11) + 1))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    probs = ensemble.class_probabilities(fold_logits(spark, d), "vec_id", "fold", "logits")
    return ensemble.map_class_to_family(probs, class_dim(spark))


@plan("fold_mean_sd", f"""
WITH {FOLD_SQL}
SELECT vec_id, class_idx, round(mean, 6) AS mean, round(sd, 6) AS sd FROM cp""")
def fold_mean_sd(spark, d):
    """F21 + A20: softmax per fold, mean and sample sd across folds per class."""
    probs = ensemble.class_probabilities(fold_logits(spark, d), "vec_id", "fold", "logits")
    return rounded(probs)


@plan("family_probability", f"""
WITH {FOLD_SQL}
SELECT vec_id, family, round(sum(mean), 6) AS prob FROM cf GROUP BY vec_id, family""")
def family_probability(spark, d):
    """J7 + A21: class -> family (broadcast class dim), summed per row."""
    return rounded(ensemble.family_probability(class_scores(spark, d), "vec_id"))


@plan("composite_probability", f"""
WITH {FOLD_SQL},
fp AS (SELECT vec_id, family, sum(mean) AS prob FROM cf GROUP BY vec_id, family)
SELECT vec_id,
  round(sum(CASE WHEN family IN ({", ".join(f"'{x}'" for x in rules.MALIGNANT_FAMILIES)})
                 THEN prob ELSE 0 END), 6) AS invasive,
  round(sum(CASE WHEN family IN ({", ".join(f"'{x}'" for x in rules.PREMALIGNANT_FAMILIES)})
                 THEN prob ELSE 0 END), 6) AS premalignant,
  round(sum(CASE WHEN family IN ({", ".join(f"'{x}'" for x in rules.MALIGNANT_FAMILIES
                                          + rules.PREMALIGNANT_FAMILIES)})
                 THEN prob ELSE 0 END), 6) AS concerning,
  round(sum(CASE WHEN family IN ({", ".join(f"'{x}'" for x in rules.BENIGN_FAMILIES)})
                 THEN prob ELSE 0 END), 6) AS benign
FROM fp GROUP BY vec_id""")
def composite_probability(spark, d):
    """Invasive / premalignant / concerning / benign composites per row."""
    fam = ensemble.family_probability(class_scores(spark, d), "vec_id")
    return rounded(ensemble.composite_probability(fam, "vec_id"))


@plan("top_families", f"""
WITH {FOLD_SQL},
fb AS (SELECT *, row_number() OVER (PARTITION BY vec_id, family ORDER BY mean DESC, class_idx)
              AS rf FROM cf),
ff AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mean DESC, class_idx) AS r
       FROM fb WHERE rf = 1),
tw AS (SELECT vec_id,
  max(class) FILTER (WHERE r = 1) AS top1_diagnosis, max(family) FILTER (WHERE r = 1) AS top1_family,
  max(mean) FILTER (WHERE r = 1) AS top1_probability,
  max(class) FILTER (WHERE r = 2) AS top2_diagnosis, max(family) FILTER (WHERE r = 2) AS top2_family,
  max(mean) FILTER (WHERE r = 2) AS top2_probability,
  max(class) FILTER (WHERE r = 3) AS top3_diagnosis, max(family) FILTER (WHERE r = 3) AS top3_family,
  max(mean) FILTER (WHERE r = 3) AS top3_probability
  FROM ff GROUP BY vec_id),
gt AS (SELECT vec_id, [{_FAMS}][label + 1] AS gt_family FROM embeddings)
SELECT tw.vec_id, top1_diagnosis, top1_family, round(top1_probability, 6) AS top1_probability,
       top2_diagnosis, top2_family, round(top2_probability, 6) AS top2_probability,
       top3_diagnosis, top3_family, round(top3_probability, 6) AS top3_probability,
       gt.gt_family,
       CAST(coalesce(top1_family = gt.gt_family, false) AS INTEGER) AS top1_family_correct,
       CAST(coalesce(gt.gt_family IN (top1_family, top2_family, top3_family), false) AS INTEGER)
         AS top3_family_correct
FROM tw JOIN gt ON tw.vec_id = gt.vec_id""")
def top_families(spark, d):
    """T1 + T2 + T3: unique-family top-3 per row, wide, with hit flags vs truth."""
    top = ensemble.top_families(class_scores(spark, d), "vec_id", k=3)
    fams = F.array(*[F.lit(f) for f in rules.MODEL_FAMILIES])
    gt = table(spark, d, "embeddings").select(
        "vec_id", F.element_at(fams, F.col("label") + 1).alias("gt_family"))
    return rounded(top.join(gt, "vec_id").select(
        "vec_id", *ensemble.topk_columns("top", 3), "gt_family",
        ensemble.topk_hit("top", "gt_family", 1).cast("int").alias("top1_family_correct"),
        ensemble.topk_hit("top", "gt_family", 3).cast("int").alias("top3_family_correct")))


# ---------------------------------------------------------------- fusion
def base_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Two models joined on the row id: the class-score model (top families, family
    probabilities and the concerning share, per embedding) and the checkpoint ensemble
    (per order, joined on the same id value)."""
    from caliper.operators import linkage as J

    model_a = (ensemble.class_outputs(class_scores(spark, d), "vec_id", 3)
               .select(F.col("vec_id").alias("row_id"), *ensemble.topk_columns("top", 3),
                       *[f"family_prob_{f}" for f in rules.MODEL_FAMILIES],
                       F.col("family_prob_MEL").alias("melanoma_probability"),
                       F.col("concerning").alias("concerning_probability")))
    model_b = (ensemble.ensemble_scores(checkpoint_scores(spark, d))
               .select("row_id", F.col("prob_ensemble").alias("specialist_probability"),
                       F.col("rank_ensemble").alias("specialist_rank")))
    return J.join_model_outputs(model_a, model_b, "row_id", "row_id",
                                ["specialist_probability", "specialist_rank",
                                 "melanoma_probability", "concerning_probability"])


def fusion_replies(spark: SparkSession, d: str) -> DataFrame:
    """Recipe: every event gets a fusion reply whose fields follow from its ids; some
    leave fields out, hold text for numbers, or are no JSON at all."""
    e = dealt(table(spark, d, "events").select("event_id", "user_id"))
    i, u = F.col("event_id"), F.col("user_id")
    fams = F.array(*[F.lit(f) for f in FUSION_FAMILIES])

    def num(mult, of=100):
        return F.concat(F.lit("0."), F.lpad(((i * mult) % of).cast("string"), 2, "0"))

    body = F.concat(
        F.lit('{"primary_family": "'), F.element_at(fams, (u % len(FUSION_FAMILIES) + 1).cast("int")),
        F.lit('", "melanoma_probability": '), F.when(i % 9 == 4, F.lit('"n/a"')).otherwise(num(7)),
        F.when(i % 10 == 3, F.lit("")).otherwise(F.concat(F.lit(', "malignancy_probability": '), num(13))),
        F.when(i % 5 == 2, F.lit("")).otherwise(F.concat(F.lit(', "melanoma_prediction": '), (u % 2).cast("string"))),
        F.lit(', "malignancy_prediction": '), F.when(u % 3 == 0, F.lit("true")).otherwise(F.lit("0")),
        F.lit(', "followed_resnet": '), F.when(i % 4 == 0, F.lit("false")).when(i % 4 == 1, F.lit('""')).otherwise(F.lit("1")),
        F.lit(', "resnet_weight": '), num(3), F.lit(', "siim_weight": "'), num(11), F.lit('", "confidence": '), num(17),
        F.lit(', "brief_rationale": "r'), u.cast("string"), F.lit('"}'))
    return e.select(F.col("event_id").alias("row_id"),
                    F.when(i % 8 == 7, F.lit("no answer")).when(i % 8 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
                    .otherwise(body).alias("text"))


FUSION_FAMILIES = ["MEL", "melanoma", "NV", "nevus", "BCC", "SK", "vascular", "scc", "misc", "unknown", "DF"]
_TWO = lambda m: f"(CAST((event_id * {m}) % 100 AS DOUBLE) / 100.0)"

#: The fields of the replies above, written down directly from the recipe.
FUSION_SQL = f"""
fu AS (
  SELECT event_id AS row_id,
         [{", ".join(f"'{f}'" for f in FUSION_FAMILIES)}][user_id % {len(FUSION_FAMILIES)} + 1] AS ffam_raw,
         CASE WHEN event_id % 9 <> 4 THEN {_TWO(7)} END AS mel_p,
         CASE WHEN event_id % 10 <> 3 THEN {_TWO(13)} END AS mal_p,
         CAST(CASE WHEN event_id % 5 = 2 THEN 0 ELSE user_id % 2 END AS INTEGER) AS fmel,
         CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS fmal,
         event_id % 4 >= 2 AS followed_resnet, 'r' || CAST(user_id AS VARCHAR) AS rationale,
         {_TWO(3)} AS rw, {_TWO(11)} AS sw, {_TWO(17)} AS conf
  FROM events WHERE event_id % 8 <> 7)"""


@plan("parse_fusion_replies", f"""
WITH {FUSION_SQL}
SELECT row_id, mel_p AS melanoma_probability, mal_p AS malignancy_probability,
       fmel AS melanoma_prediction, fmal AS malignancy_prediction, rationale,
       followed_resnet, false AS followed_siim, rw AS resnet_weight, sw AS siim_weight,
       conf AS fusion_confidence, '' AS melanoma_decision_basis, '' AS malignancy_decision_basis
FROM fu""")
def parse_fusion_replies(spark, d):
    """R1 (fenced, drop) + F19 + F20 + F22: the fields of a fusion reply."""
    from caliper.operators import replies as R

    found = R.parse_replies(fusion_replies(spark, d), "text", mode="fenced", on_error="drop")
    return rounded(R.fusion_fields(found).drop("text", "_reply", "_error"))


def _fusion_sql() -> str:
    conc = ", ".join(f"'{x}'" for x in rules.MALIGNANT_FAMILIES + rules.PREMALIGNANT_FAMILIES)
    alias = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in rules.FAMILY_ALIASES.items()) + "}"

    def norm(e):
        return f"coalesce(map_extract({alias}, upper(trim({e})))[1], 'MISC')"

    return f"""
WITH {FOLD_SQL},
fb AS (SELECT *, row_number() OVER (PARTITION BY vec_id, family ORDER BY mean DESC, class_idx)
              AS rf FROM cf),
ff AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mean DESC, class_idx) AS r
       FROM fb WHERE rf = 1),
t1 AS (SELECT vec_id, max(family) FILTER (WHERE r = 1) AS top1_family FROM ff GROUP BY vec_id),
fp AS (SELECT vec_id, family, sum(mean) AS prob FROM cf GROUP BY vec_id, family),
ma AS (SELECT fp.vec_id AS row_id,
              coalesce(max(prob) FILTER (WHERE family = 'MEL'), 0.0) AS rmel,
              sum(CASE WHEN family IN ({conc}) THEN prob ELSE 0 END) AS rconc
       FROM fp GROUP BY fp.vec_id),
{CHECKPOINT_SQL},
am AS (SELECT row_id, arch, avg(prob) AS arch_mean FROM ck GROUP BY row_id, arch),
mb AS (SELECT row_id, avg(arch_mean) AS smel FROM am GROUP BY row_id),
{FUSION_SQL},
x AS (
  SELECT {norm("fu.ffam_raw")} AS ffam, {norm("t1.top1_family")} AS rfam, fu.fmel, fu.fmal, fu.rw, fu.sw, fu.conf,
         CAST(ma.rmel >= {rules.RESNET_MEL_THRESHOLD} AS INTEGER) AS rm,
         CAST(ma.rconc >= {rules.RESNET_MALIGNANCY_THRESHOLD} AS INTEGER) AS rg,
         CAST(mb.smel >= {rules.SIIM_MEL_THRESHOLD} AS INTEGER) AS sm
  FROM ma JOIN t1 ON ma.row_id = t1.vec_id JOIN mb ON ma.row_id = mb.row_id
          JOIN fu ON ma.row_id = fu.row_id
  WHERE mb.smel IS NOT NULL AND fu.mel_p IS NOT NULL AND fu.mal_p IS NOT NULL)
SELECT round(avg(CAST(ffam <> rfam AS INTEGER)), 6) AS changed_family_from_base,
       round(avg(CAST(fmel <> rm AS INTEGER)), 6) AS changed_melanoma_from_base,
       round(avg(CAST(fmal <> rg AS INTEGER)), 6) AS changed_malignancy_from_base,
       round(avg(CAST(fmel <> sm AS INTEGER)), 6) AS changed_melanoma_from_specialist,
       round(avg(CAST(rm = sm AS INTEGER)), 6) AS base_specialist_melanoma_agree,
       round(avg(rw), 6) AS mean_resnet_weight, round(avg(sw), 6) AS mean_siim_weight,
       round(avg(conf), 6) AS mean_fusion_confidence
FROM x"""


@plan("fusion_behaviour", _fusion_sql())
def fusion_behaviour(spark, d):
    """J6 + P2 + F4 + F14 + F15 + A17: the fusion replies' own fields against the flags of
    the two base models; replies without both probabilities are dropped; one aggregate."""
    from caliper.operators import fusion
    from caliper.operators import linkage as J
    from caliper.operators import replies as R

    found = R.parse_replies(fusion_replies(spark, d), "text", mode="fenced", on_error="drop")
    found = prefix.materialize(R.family_top3(R.fusion_fields(found)).select(
        "row_id", F.col("top1_family").alias("fusion_family"),
        F.col("melanoma_probability").alias("fusion_mel_p"), F.col("malignancy_probability").alias("fusion_mal_p"),
        "melanoma_prediction", "malignancy_prediction", "resnet_weight", "siim_weight", "fusion_confidence"))
    found = J.drop_incomplete(found, ["fusion_mel_p", "fusion_mal_p"])
    x = fusion.base_flags(base_outputs(spark, d).join(found, "row_id"), "melanoma_probability",
                          "concerning_probability", "specialist_probability")
    x = fusion.change_flags(x, "fusion_family", "top1_family", "melanoma_prediction", "malignancy_prediction")
    return rounded(fusion.fusion_behaviour(x))


def _prompt_sql() -> str:
    """The same evidence lines; numbers as decimal text of six places on both sides."""
    from caliper.operators import fusion

    fams = ", ".join(f"max(CASE WHEN family = '{f}' THEN prob END) AS family_prob_{f}" for f in rules.MODEL_FAMILIES)
    tops = ", ".join(f"max({c}) FILTER (WHERE r = {r}) AS top{r}_{n}" for r in (1, 2, 3)
                     for c, n in (("class", "diagnosis"), ("family", "family"), ("mean", "probability")))
    conc = ", ".join(f"'{x}'" for x in rules.MALIGNANT_FAMILIES + rules.PREMALIGNANT_FAMILIES)

    def text(names, default):
        if not isinstance(names, list):
            return f"'{names}'"
        c = names[0]
        if c.endswith("probability") or c.startswith("family_prob") or c.endswith("_rank"):
            return f"coalesce(CAST(CAST(round({c}, 6) AS DECIMAL(12, 6)) AS VARCHAR), '{default}')"
        return f"coalesce(CAST({c} AS VARCHAR), '{default}')"

    lines = " || ".join(f"chr(10) || '{label}: ' || {text(names, default)}" for label, names, default in fusion.EVIDENCE)
    return f"""
WITH {FOLD_SQL},
fb AS (SELECT *, row_number() OVER (PARTITION BY vec_id, family ORDER BY mean DESC, class_idx) AS rf FROM cf),
ff AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mean DESC, class_idx) AS r FROM fb WHERE rf = 1),
t3 AS (SELECT vec_id, {tops} FROM ff GROUP BY vec_id),
fp AS (SELECT vec_id, family, sum(mean) AS prob FROM cf GROUP BY vec_id, family),
ma AS (SELECT vec_id, {fams}, sum(CASE WHEN family IN ({conc}) THEN prob ELSE 0 END) AS concerning_probability
       FROM fp GROUP BY vec_id),
{CHECKPOINT_SQL},
am AS (SELECT row_id, arch, avg(prob) AS arch_mean FROM ck GROUP BY row_id, arch),
nn AS (SELECT row_id, arch,
              (rank() OVER (PARTITION BY arch ORDER BY arch_mean)
               + (count(*) OVER (PARTITION BY arch, arch_mean) - 1) / 2.0)
              / count(*) OVER (PARTITION BY arch) AS arch_rank
       FROM am WHERE arch_mean IS NOT NULL),
mb AS (SELECT am.row_id, avg(am.arch_mean) AS specialist_probability, avg(nn.arch_rank) AS specialist_rank
       FROM am LEFT JOIN nn ON am.row_id = nn.row_id AND am.arch = nn.arch GROUP BY am.row_id),
x AS (SELECT ma.*, t3.* EXCLUDE (vec_id), mb.row_id, mb.specialist_probability, mb.specialist_rank,
             coalesce(ma.family_prob_MEL, 0.0) AS melanoma_probability,
             CAST(coalesce(ma.family_prob_MEL, 0.0) >= {rules.RESNET_MEL_THRESHOLD} AS INTEGER) AS base_melanoma_prediction,
             CAST(ma.concerning_probability >= {rules.RESNET_MALIGNANCY_THRESHOLD} AS INTEGER) AS base_malignancy_prediction,
             CAST(mb.specialist_probability >= {rules.SIIM_MEL_THRESHOLD} AS INTEGER) AS specialist_melanoma_prediction
      FROM ma JOIN t3 ON ma.vec_id = t3.vec_id JOIN mb ON ma.vec_id = mb.row_id
      WHERE mb.specialist_probability IS NOT NULL AND mb.specialist_rank IS NOT NULL)
SELECT row_id, 'Weigh the evidence of two models; answer in JSON.' || {lines} || chr(10) AS prompt FROM x"""


@plan("fusion_prompts", _prompt_sql())
def fusion_prompts(spark, d):
    """F17 + F23: evidence prompts for the fusion model from whichever base-model
    columns exist; probabilities stand as decimal text of six places."""
    from caliper.operators import fusion

    x = fusion.base_flags(base_outputs(spark, d), "melanoma_probability", "concerning_probability",
                          "specialist_probability")
    x = rounded(x)
    x = x.select(*[F.col(c).cast("decimal(12,6)") if t == "double" else F.col(c) for c, t in x.dtypes])
    return fusion.render_prompts(x, fusion.evidence_template(x.columns)).select("row_id", "prompt")
