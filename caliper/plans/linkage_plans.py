"""Record linkage on the driver tables.

Recipes (shared with the SQL oracles):
  * file catalog: ``img/<p_brand>.jpg`` per distinct brand, ``img/<c_name>.png`` per
    customer and ``notes/<n_name>.txt`` per nation (not an image, filtered out).
  * wanted keys per part, by ``p_partkey % 4``: the size as text, ``brand#<size>``,
    ``BRAND#<size>``, or ``p_partkey % 1500`` as text (numeric keys resolve by
    substring into customer names; sizes above 25 name no brand).
  * truth: documents vs labels, with a second, later copy of every fifth label
    whose quality is flipped (last wins); ids differ in case and padding.
  * views: conversation turns, user turns paired with assistant turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.operators import linkage as J
from caliper.plans.registry import plan
from caliper.plans.tables import table


def file_catalog(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(
        F.concat(F.lit("img/"), "p_brand", F.lit(".jpg")).alias("path")).distinct()
    custs = table(spark, d, "customer").select(
        F.concat(F.lit("img/"), "c_name", F.lit(".png")).alias("path"))
    notes = table(spark, d, "nation").select(
        F.concat(F.lit("notes/"), "n_name", F.lit(".txt")).alias("path"))
    return brands.unionByName(custs).unionByName(notes)


def wanted_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    key = (F.when(k == 0, size).when(k == 1, F.concat(F.lit("brand#"), size))
           .when(k == 2, F.concat(F.lit("BRAND#"), size))
           .otherwise((F.col("p_partkey") % 1500).cast("string")))
    return table(spark, d, "part").select("p_partkey", key.alias("key"))


FILES_SQL = """
files AS (
  SELECT DISTINCT 'img/' || p_brand || '.jpg' AS path FROM part
  UNION ALL SELECT 'img/' || c_name || '.png' FROM customer
  UNION ALL SELECT 'notes/' || n_name || '.txt' FROM nation),
img AS (
  SELECT path, regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^(.+)\\.[^.]*$', 1) AS stem
  FROM files
  WHERE lower(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^.+(\\.[^.]*)$', 1))
        IN ('.jpg', '.jpeg', '.png'))"""

WANTED_SQL = """
wanted AS (
  SELECT p_partkey,
         CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR)
                            WHEN 1 THEN 'brand#' || CAST(p_size AS VARCHAR)
                            WHEN 2 THEN 'BRAND#' || CAST(p_size AS VARCHAR)
                            ELSE CAST(p_partkey % 1500 AS VARCHAR) END AS key
  FROM part)"""


@plan("resolve_files", f"""
WITH {FILES_SQL},
{WANTED_SQL},
al AS (
  SELECT alias, min(path) AS path FROM (
    SELECT path, stem AS alias FROM img
    UNION ALL SELECT path, upper(stem) FROM img
    UNION ALL SELECT path, lower(stem) FROM img
    UNION ALL SELECT path, replace(upper(stem), 'ISIC_', '') FROM img WHERE starts_with(upper(stem), 'ISIC_')
    UNION ALL SELECT path, replace(lower(stem), 'isic_', '') FROM img WHERE starts_with(upper(stem), 'ISIC_'))
  GROUP BY alias),
keys AS (SELECT DISTINCT key FROM wanted),
cand AS (
  SELECT key, 0 AS priority, key AS alias FROM keys
  UNION ALL SELECT key, 1, upper(key) FROM keys
  UNION ALL SELECT key, 2, lower(key) FROM keys
  UNION ALL SELECT key, 3, upper('ISIC_' || key) FROM keys),
exact AS (
  SELECT key, path, priority FROM (
    SELECT c.key, a.path, c.priority,
           row_number() OVER (PARTITION BY c.key ORDER BY c.priority, a.path) AS rn
    FROM cand c JOIN al a ON c.alias = a.alias) WHERE rn = 1),
sub AS (
  SELECT key, path FROM (
    SELECT k.key, i.path,
           row_number() OVER (PARTITION BY k.key ORDER BY length(i.stem), i.path) AS rn
    FROM keys k JOIN img i ON contains(i.stem, k.key)
    WHERE k.key NOT IN (SELECT key FROM exact)) WHERE rn = 1),
res AS (SELECT key, path, CAST(priority AS VARCHAR) AS by FROM exact
        UNION ALL SELECT key, path, 'substring' FROM sub)
SELECT w.p_partkey, w.key, r.path, r.by AS path_by
FROM wanted w LEFT JOIN res r ON w.key = r.key""")
def resolve_files(spark, d):
    """S4 + J1 + J2: image filter, cascading alias lookup, substring fallback."""
    files = J.image_files(file_catalog(spark, d))
    return J.find_files(wanted_keys(spark, d), "key", files).select(
        "p_partkey", "key", "path", "path_by")


@plan("missing_files", f"""
WITH {FILES_SQL},
{WANTED_SQL},
al AS (
  SELECT alias, min(path) AS path FROM (
    SELECT path, stem AS alias FROM img UNION ALL SELECT path, upper(stem) FROM img
    UNION ALL SELECT path, lower(stem) FROM img) GROUP BY alias),
keys AS (SELECT DISTINCT key FROM wanted),
hit AS (
  SELECT DISTINCT k.key FROM keys k JOIN al a
    ON a.alias IN (k.key, upper(k.key), lower(k.key), upper('ISIC_' || k.key))
  UNION SELECT DISTINCT k.key FROM keys k JOIN img i ON contains(i.stem, k.key)),
miss AS (SELECT key FROM keys WHERE key NOT IN (SELECT key FROM hit))
SELECT CAST(count(*) AS BIGINT) AS n_missing,
       (SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT key FROM miss ORDER BY key LIMIT 10))
         AS first_missing
FROM miss""")
def missing_files(spark, d):
    """Count of unresolved keys and the first ten (sorted), as text."""
    files = J.image_files(file_catalog(spark, d))
    res = J.find_files(wanted_keys(spark, d), "key", files)
    rep = J.missing_report(res, "key", "path", n=10)
    return rep.select("n_missing", F.array_join("first_missing", ",").alias("first_missing"))


def _truth_copies(spark, d):
    lab = table(spark, d, "labels")
    first = lab.select(F.concat(F.lit("  DOC_"), F.col("doc_id").cast("string"), F.lit(" "))
                       .alias("truth_id"), "quality", "toxic",
                       (F.col("doc_id") * 2).alias("ord"))
    second = lab.where(F.col("doc_id") % 5 == 0).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("truth_id"),
        (F.lit(1) - F.col("quality")).alias("quality"), "toxic",
        (F.col("doc_id") * 2 + 1).alias("ord"))
    return first.unionByName(second)


@plan("attach_truth", """
WITH t AS (
  SELECT '  DOC_' || CAST(doc_id AS VARCHAR) || ' ' AS truth_id, quality, toxic, doc_id * 2 AS ord
  FROM labels
  UNION ALL SELECT 'doc_' || CAST(doc_id AS VARCHAR), 1 - quality, toxic, doc_id * 2 + 1
  FROM labels WHERE doc_id % 5 = 0),
tl AS (SELECT upper(trim(truth_id)) AS id, quality, toxic FROM (
         SELECT *, row_number() OVER (PARTITION BY upper(trim(truth_id)) ORDER BY ord DESC) AS rn
         FROM t) WHERE rn = 1),
p AS (SELECT doc_id, lang, 'doc_' || CAST(doc_id AS VARCHAR) AS pred_id FROM documents)
SELECT p.doc_id, p.lang, p.pred_id, tl.quality, tl.toxic
FROM p JOIN tl ON upper(trim(p.pred_id)) = tl.id""")
def attach_truth(spark, d):
    """J3 + W2 (last wins): case-insensitive trimmed id match, inner."""
    preds = table(spark, d, "documents").select(
        "doc_id", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("pred_id"))
    return J.attach_truth(preds, "pred_id", _truth_copies(spark, d), "truth_id",
                          ["quality", "toxic"], "ord").select(
        "doc_id", "lang", "pred_id", "quality", "toxic")


@plan("left_join_labels", """
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_join_labels(spark, d):
    """Every metadata row kept; no match -> NULL prediction."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "quality", "toxic")


@plan("pair_turns", """
WITH a AS (SELECT conv_id, arg_min(turn, turn) AS turn_user, arg_min(length(text), turn) AS len_user
           FROM conversations WHERE contains(lower(role), 'user') GROUP BY conv_id),
     b AS (SELECT conv_id, arg_min(turn, turn) AS turn_assistant,
                  arg_min(length(text), turn) AS len_assistant
           FROM conversations WHERE contains(lower(role), 'assistant') GROUP BY conv_id)
SELECT a.conv_id, turn_user, CAST(len_user AS INTEGER) AS len_user, turn_assistant,
       CAST(len_assistant AS INTEGER) AS len_assistant
FROM a JOIN b ON a.conv_id = b.conv_id""")
def pair_turns(spark, d):
    """The two kinds paired on the case key (first turn of each side); a key
    missing a side vanishes.  One row per key, however many turns a key has."""
    conv = table(spark, d, "conversations").select(
        "conv_id", "role", "turn", F.length("text").alias("len"))
    return J.pair_views(conv, "conv_id", "role", ["turn", "len"], "first", left_kind="user",
                        right_kind="assistant", left_suffix="_user",
                        right_suffix="_assistant")


@plan("pair_turns_all", """
SELECT a.conv_id, a.turn AS turn_user, b.turn AS turn_assistant
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id
WHERE contains(lower(a.role), 'user') AND contains(lower(b.role), 'assistant')""")
def pair_turns_all(spark, d):
    """J5 as a merge does it: every combination of the two kinds of a key."""
    conv = table(spark, d, "conversations").select("conv_id", "role", "turn")
    return J.pair_views(conv, "conv_id", "role", ["turn"], "all", left_kind="user",
                        right_kind="assistant", left_suffix="_user", right_suffix="_assistant")


@plan("remaining_docs", """
SELECT doc_id, lang FROM documents
WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def remaining_docs(spark, d):
    """Cases not yet in the done table (anti-join on the string key)."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return J.not_yet_done(docs, table(spark, d, "labels").select("doc_id"), "doc_id")


@plan("matched_ids", """
SELECT DISTINCT upper(trim('doc_' || CAST(d.doc_id AS VARCHAR))) AS id
FROM documents d
WHERE upper(trim('doc_' || CAST(d.doc_id AS VARCHAR))) IN
      (SELECT upper(trim(' DOC_' || CAST(doc_id AS VARCHAR))) FROM labels)""")
def matched_ids(spark, d):
    """Normalised id intersection (raises when empty)."""
    files = table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("fid"))
    meta = table(spark, d, "labels").select(
        F.concat(F.lit(" DOC_"), F.col("doc_id").cast("string")).alias("mid"))
    return J.matched_ids(files, "fid", meta, "mid")


@plan("present_cases", f"""
WITH {FILES_SQL},
c AS (SELECT o_orderkey,
             'img/Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '.png' AS img_a,
             'img/Brand#' || CAST(o_orderkey % 30 AS VARCHAR) || '.jpg' AS img_b
      FROM orders)
SELECT o_orderkey, img_a, img_b FROM c
WHERE img_a IN (SELECT path FROM img) AND img_b IN (SELECT path FROM img)""")
def present_cases(spark, d):
    """P5: keep a case only when all of its images exist (one semi-join per column)."""
    cases = table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit("img/Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"),
                 F.lit(".png")).alias("img_a"),
        F.concat(F.lit("img/Brand#"), (F.col("o_orderkey") % 30).cast("string"),
                 F.lit(".jpg")).alias("img_b"))
    kept, _ = J.present_only(cases, J.image_files(file_catalog(spark, d)), ["img_a", "img_b"])
    return kept


@plan("existing_images", f"""
WITH {FILES_SQL},
ids AS (SELECT DISTINCT p_brand AS id FROM part UNION SELECT c_name FROM customer
        UNION SELECT n_name FROM nation),
hit AS (
  SELECT id, path FROM (
    SELECT ids.id, f.path, row_number() OVER (PARTITION BY ids.id ORDER BY c.prio, f.path) AS rn
    FROM ids JOIN (SELECT 0 AS prio, '.jpg' AS ext UNION ALL SELECT 1, '.png') c ON true
    JOIN files f ON regexp_extract(f.path, '([^/]+)$', 1) = ids.id || c.ext) WHERE rn = 1)
SELECT ids.id, hit.path AS existing_path,
       CASE WHEN hit.path IS NOT NULL THEN 'existing' END AS image_src
FROM ids LEFT JOIN hit ON ids.id = hit.id""")
def existing_images(spark, d):
    """Ids whose .jpg (first) or .png already exists."""
    ids = (table(spark, d, "part").select(F.col("p_brand").alias("id"))
           .unionByName(table(spark, d, "customer").select(F.col("c_name").alias("id")))
           .unionByName(table(spark, d, "nation").select(F.col("n_name").alias("id")))
           .distinct())
    return J.skip_existing(ids, "id", file_catalog(spark, d)).select(
        "id", "existing_path", "image_src")
