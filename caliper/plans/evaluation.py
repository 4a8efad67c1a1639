"""Binary metrics, curves and the metrics grid on the driver tables.

Recipes (shared with the SQL oracles):
  * documents x labels: y = quality or toxic, score = least(n_chars / 20000, 1),
    group = lang.
  * lineitem: y = (l_returnflag = 'R'), score = l_extendedprice / 105000 (59k+
    distinct values) or l_discount (11 values: heavy ties), group = l_linestatus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.operators import curves, metrics
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import table

DOC_EVAL_SQL = """
doc_eval AS (
  SELECT d.doc_id, d.lang, l.quality AS y_quality, l.toxic AS y_toxic,
         least(CAST(d.n_chars AS DOUBLE) / 20000.0, CAST(1.0 AS DOUBLE)) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

LINE_EVAL_SQL = """
line_eval AS (
  SELECT l_linestatus AS grp,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_r,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y_o,
         l_extendedprice / 105000.0 AS s_price,
         l_discount AS s_disc
  FROM lineitem)"""


def doc_eval(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang",
        F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic"),
        F.least(F.col("n_chars").cast("double") / 20000.0, F.lit(1.0)).alias("score"))


def line_eval(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("grp"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_r"),
        (F.col("l_linestatus") == "O").cast("int").alias("y_o"),
        (F.col("l_extendedprice") / 105000.0).alias("s_price"),
        F.col("l_discount").alias("s_disc"))


def _metric_sql(src: str, by: str, y: str, pred: str) -> str:
    return f"""
c AS (
  SELECT {by},
         count(*) FILTER (WHERE {y} = 1 AND {pred} = 1) AS tp,
         count(*) FILTER (WHERE {y} <> 1 AND {pred} = 1) AS fp,
         count(*) FILTER (WHERE {y} <> 1 AND {pred} <> 1) AS tn,
         count(*) FILTER (WHERE {y} = 1 AND {pred} <> 1) AS fn,
         count(*) AS n
  FROM {src} GROUP BY {by})
SELECT {by}, tp, fp, tn, fn, n,
       round(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 6) AS accuracy,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
       round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 6) AS npv,
       round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM c"""


@plan("binary_metrics_by_lang", f"""
WITH {DOC_EVAL_SQL},
p AS (SELECT lang, y_quality AS y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred
      FROM doc_eval),
{_metric_sql("p", "lang", "y", "pred")}""")
def binary_metrics_by_lang(spark, d):
    """A1 + A2: documents scored by length, truth = quality, per language."""
    e = doc_eval(spark, d)
    c = metrics.confusion_counts(e, "y_quality", (F.col("score") >= 0.5).cast("int"), ["lang"])
    return rounded(metrics.binary_metrics(c))


@plan("binary_metrics_lineitem", f"""
WITH {LINE_EVAL_SQL},
p AS (SELECT grp, y_r AS y, CASE WHEN s_price >= 0.5 THEN 1 ELSE 0 END AS pred FROM line_eval),
{_metric_sql("p", "grp", "y", "pred")}""")
def binary_metrics_lineitem(spark, d):
    """A1 + A2 on the big table: one hash aggregate, partial aggregation map-side."""
    e = line_eval(spark, d)
    c = metrics.confusion_counts(e, "y_r", (F.col("s_price") >= 0.5).cast("int"), ["grp"])
    return rounded(metrics.binary_metrics(c))


@plan("binary_metrics_eps_lineitem", f"""
WITH {LINE_EVAL_SQL},
p AS (SELECT grp, y_r AS y, CASE WHEN s_disc >= 0.05 THEN 1 ELSE 0 END AS pred FROM line_eval),
c AS (
  SELECT grp,
         count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
         count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
         count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS tn,
         count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn,
         count(*) AS n
  FROM p GROUP BY grp),
m AS (
  SELECT grp, tp, fp, tn, fn, n,
         CAST(tp + tn AS DOUBLE) / greatest(tp + fp + tn + fn, 1) AS accuracy,
         CAST(tp AS DOUBLE) / greatest(tp + fn, 1) AS recall,
         CAST(tn AS DOUBLE) / greatest(tn + fp, 1) AS specificity,
         CAST(tp AS DOUBLE) / greatest(tp + fp, 1) AS prec
  FROM c)
SELECT grp, tp, fp, tn, fn, n, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall,
       round(specificity, 6) AS specificity, round(prec, 6) AS "precision",
       round(2 * prec * recall / greatest(prec + recall, 1e-12), 6) AS f1
FROM m""")
def binary_metrics_eps_lineitem(spark, d):
    """A3: the max(den, 1) variant; the matrix column is dropped for the oracle."""
    e = line_eval(spark, d)
    c = metrics.confusion_counts(e, "y_r", (F.col("s_disc") >= 0.05).cast("int"), ["grp"])
    return rounded(metrics.binary_metrics(c, style="eps").drop("confusion_matrix"))


def _points_sql(src: str, by: str, y: str, s: str) -> str:
    return f"""
pts AS (
  SELECT {by}, {s} AS score, count(*) FILTER (WHERE {y} = 1) AS pos,
         count(*) FILTER (WHERE {y} <> 1) AS neg
  FROM {src} WHERE {s} IS NOT NULL AND {y} IS NOT NULL GROUP BY {by}, {s}),
cum AS (
  SELECT {by}, score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
         CAST(sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS tp,
         CAST(sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS fp,
         CAST(sum(pos) OVER (PARTITION BY {by}) AS DOUBLE) AS np,
         CAST(sum(neg) OVER (PARTITION BY {by}) AS DOUBLE) AS nn
  FROM pts)"""


def _summary_sql(by: str) -> str:
    return f"""
jj AS (SELECT *, tp / np - fp / nn AS j FROM cum WHERE np > 0 AND nn > 0),
best AS (SELECT {by}, max(j) AS bj FROM jj GROUP BY {by}),
bt AS (SELECT jj.{by}, max(jj.score) AS thr FROM jj JOIN best b
       ON jj.{by} = b.{by} AND jj.j = b.bj GROUP BY jj.{by}),
agg AS (SELECT {by}, max(np) AS np, max(nn) AS nn,
               sum(neg * (tp - pos / 2.0)) AS auc_num, sum(pos * (tp / (tp + fp))) AS ap_num
        FROM cum GROUP BY {by})
SELECT agg.{by}, CAST(np + nn AS BIGINT) AS n, CAST(np AS BIGINT) AS n_pos,
       CAST(nn AS BIGINT) AS n_neg,
       CASE WHEN np > 0 AND nn > 0 THEN round(auc_num / (np * nn), 6) END AS roc_auc,
       CASE WHEN np > 0 AND nn > 0 THEN round(ap_num / np, 6) END AS pr_auc,
       CASE WHEN np > 0 AND nn > 0 THEN
            CASE WHEN b.bj > 0 THEN round(bt.thr, 6) ELSE CAST('inf' AS DOUBLE) END END
            AS youden_threshold,
       CASE WHEN np > 0 AND nn > 0 THEN
            CASE WHEN b.bj > 0 THEN round(b.bj, 6) ELSE 0.0 END END AS youden_j
FROM agg LEFT JOIN best b ON agg.{by} = b.{by} LEFT JOIN bt ON agg.{by} = bt.{by}"""


@plan("roc_curve_discount", f"""
WITH {LINE_EVAL_SQL},
{_points_sql("line_eval", "grp", "y_r", "s_disc")}
SELECT grp, round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM cum
UNION ALL
SELECT grp, CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0, 0.0
FROM (SELECT DISTINCT grp FROM line_eval)""")
def roc_curve_discount(spark, d):
    """A8 + W4: one point per distinct discount (heavy ties) per line status."""
    e = line_eval(spark, d)
    return rounded(curves.roc_curve(e, "y_r", "s_disc", by=["grp"]))


@plan("roc_curve_price", f"""
WITH {LINE_EVAL_SQL},
{_points_sql("line_eval", "grp", "y_r", "s_price")}
SELECT grp, round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM cum
UNION ALL
SELECT grp, CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0, 0.0
FROM (SELECT DISTINCT grp FROM line_eval)""")
def roc_curve_price(spark, d):
    """A8 with ~all-distinct scores: the bucketed running sum carries the work."""
    e = line_eval(spark, d)
    return rounded(curves.roc_curve(e, "y_r", "s_price", by=["grp"]))


@plan("curve_summary_price", f"""
WITH {LINE_EVAL_SQL},
{_points_sql("line_eval", "grp", "y_r", "s_price")},
{_summary_sql("grp")}""")
def curve_summary_price(spark, d):
    """A9 + A10 + A11 per line status, one aggregate over the points table."""
    e = line_eval(spark, d)
    s = curves.curve_summary(e, "y_r", "s_price", by=["grp"], thresholds=())
    return rounded(s.select("grp", "n", "n_pos", "n_neg", "roc_auc", "pr_auc",
                            "youden_threshold", "youden_j"))


@plan("curve_summary_null_group", f"""
WITH line_eval AS (SELECT coalesce(nullif(l_linestatus, 'F'), '~') AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_r,
                          l_extendedprice / 105000.0 AS s_price FROM lineitem),
{_points_sql("line_eval", "grp", "y_r", "s_price")},
res AS ({_summary_sql("grp").replace("jj AS", "WITH jj AS", 1)})
SELECT nullif(grp, '~') AS grp, n, n_pos, n_neg, roc_auc, pr_auc, youden_threshold, youden_j FROM res""")
def curve_summary_null_group(spark, d):
    """W4 + A9 to A11 with a NULL group, cut into many buckets."""
    li = table(spark, d, "lineitem")
    e = li.select(F.nullif("l_linestatus", F.lit("F")).alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y_r"),
                  (F.col("l_extendedprice") / 105000.0).alias("s_price"))
    s = curves.curve_summary(e, "y_r", "s_price", by=["grp"], thresholds=(), buckets=23)
    return rounded(s.select("grp", "n", "n_pos", "n_neg", "roc_auc", "pr_auc", "youden_threshold", "youden_j"))


@plan("curve_summary_docs", f"""
WITH {DOC_EVAL_SQL},
{_points_sql("doc_eval", "lang", "y_toxic", "score")},
{_summary_sql("lang")}""")
def curve_summary_docs(spark, d):
    """A9 + A10 + A11 on the small labelled set, per language."""
    e = doc_eval(spark, d)
    s = curves.curve_summary(e, "y_toxic", "score", by=["lang"], thresholds=())
    return rounded(s.select("lang", "n", "n_pos", "n_neg", "roc_auc", "pr_auc",
                            "youden_threshold", "youden_j"))


def _grid_sql() -> str:
    cells = []
    for tn, ycol in (("returned", "y_r"), ("open", "y_o")):
        for sn, scol in (("discount", "s_disc"), ("price", "s_price")):
            cells.append(f"SELECT '{tn}' AS target, '{sn}' AS score_name, {ycol} AS y, "
                         f"{scol} AS s FROM line_eval")
    long = "\nUNION ALL ".join(cells)
    by = "target, score_name"
    return f"""
WITH {LINE_EVAL_SQL},
long AS ({long}),
pts AS (
  SELECT {by}, s AS score, count(*) FILTER (WHERE y = 1) AS pos,
         count(*) FILTER (WHERE y <> 1) AS neg
  FROM long GROUP BY {by}, s),
cum AS (
  SELECT {by}, score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
         CAST(sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS tp,
         CAST(sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS fp,
         CAST(sum(pos) OVER (PARTITION BY {by}) AS DOUBLE) AS np,
         CAST(sum(neg) OVER (PARTITION BY {by}) AS DOUBLE) AS nn
  FROM pts),
jj AS (SELECT *, tp / np - fp / nn AS j FROM cum WHERE np > 0 AND nn > 0),
best AS (SELECT {by}, max(j) AS bj FROM jj GROUP BY {by}),
bt AS (SELECT jj.target, jj.score_name, max(jj.score) AS thr, arg_max(jj.tp, jj.score) AS btp, arg_max(jj.fp, jj.score) AS bfp
       FROM jj JOIN best b ON jj.target = b.target AND jj.score_name = b.score_name AND jj.j = b.bj
       GROUP BY jj.target, jj.score_name),
agg AS (SELECT {by}, max(np) AS np, max(nn) AS nn,
               sum(neg * (tp - pos / 2.0)) AS auc_num, sum(pos * (tp / (tp + fp))) AS ap_num,
               sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) AS tp5,
               sum(CASE WHEN score >= 0.5 THEN neg ELSE 0 END) AS fp5
        FROM cum GROUP BY {by}),
modes AS (
  SELECT a.target, a.score_name, 'fixed_threshold' AS mode, 0.5 AS threshold, np, nn,
         tp5 AS tp, fp5 AS fp, auc_num, ap_num FROM agg a
  UNION ALL
  SELECT a.target, a.score_name, 'optimal_youden_threshold',
         CASE WHEN b.bj > 0 THEN bt.thr ELSE CAST('inf' AS DOUBLE) END, np, nn,
         CASE WHEN b.bj > 0 THEN bt.btp ELSE 0 END, CASE WHEN b.bj > 0 THEN bt.bfp ELSE 0 END,
         auc_num, ap_num
  FROM agg a JOIN best b ON a.target = b.target AND a.score_name = b.score_name
             JOIN bt ON a.target = bt.target AND a.score_name = bt.score_name),
cnt AS (SELECT *, nn - fp AS tn, np - tp AS fn FROM modes)
SELECT target, score_name, mode, round(threshold, 6) AS threshold, CAST(np + nn AS BIGINT) AS n,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
       CAST(fn AS BIGINT) AS fn, round(auc_num / (np * nn), 6) AS roc_auc,
       round(ap_num / np, 6) AS pr_auc, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg,
       round((tp + tn) / (np + nn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(tn / nullif(tn + fp, 0), 6) AS specificity,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(tn / nullif(tn + fn, 0), 6) AS npv,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM cnt"""


@plan("metrics_grid", _grid_sql())
def metrics_grid(spark, d):
    """A13 (+ A12): 2 targets x 2 scores x {fixed 0.5, Youden} in one pass."""
    e = line_eval(spark, d)
    g = curves.metrics_grid(
        e, targets={"returned": F.col("y_r"), "open": F.col("y_o")},
        scores={"discount": F.col("s_disc"), "price": F.col("s_price")}, threshold=0.5)
    return rounded(g)


@plan("class_balance_docs", """
SELECT t.target, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(t.v), 0) AS BIGINT) AS n_positive
FROM (SELECT 'quality' AS target, quality AS v FROM labels
      UNION ALL SELECT 'toxic', toxic FROM labels) t
GROUP BY t.target""")
def class_balance_docs(spark, d):
    """N and positives per target."""
    return metrics.class_balance(table(spark, d, "labels"), ["quality", "toxic"])
