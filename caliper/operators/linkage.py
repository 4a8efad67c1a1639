"""Record linkage: cases <-> files <-> truth, as joins.

* Cascading lookup (J1): every wanted key expands to its candidate spellings in
  priority order; one equi-join against the catalog's alias table; the best
  priority wins per key.  Keys are deduplicated first, so a key wanted by many
  cases is resolved once and cannot skew the join.
* Substring fallback (J2): "file stem contains key, shortest stem wins".  Exact
  without a theta join or candidates to verify: a stem contains a key if one of its
  substrings of the key's length equals it, so stems are cut into their substrings of
  the lengths that keys have, those that are no wanted key are dropped at once, and the
  best file of each key is found by one map-side combined aggregate of the hits.  Files are
  put in order once and go by their number: a least number is kept in a hash table, where a
  least path would have every hit sorted inside its task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions import rules
from caliper.functions.text import file_ext, file_name, file_stem, strip
from caliper.operators.metrics import attach_single_row
from caliper.operators.prefix import broadcast_if_small, materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- alias rules
def aliases_lesion(stem: Column, path: Column):
    """Stem as is, upper, lower, and without the id prefix (both cases)."""
    up, lo = F.upper(stem), F.lower(stem)
    pre = up.startswith(rules.ID_PREFIX)
    return [stem, up, lo,
            F.when(pre, F.replace(up, F.lit(rules.ID_PREFIX), F.lit(""))),
            F.when(pre, F.replace(lo, F.lit(rules.ID_PREFIX.lower()), F.lit("")))]


def aliases_stem_prefix(stem: Column, path: Column):
    """Stem, and the stem without the id prefix when it has one."""
    return [stem, F.when(stem.startswith(rules.ID_PREFIX),
                         F.replace(stem, F.lit(rules.ID_PREFIX), F.lit("")))]


def aliases_path(stem: Column, path: Column):
    """Full path, file name and stem."""
    return [path, file_name(path), stem]


def candidates_lesion(key: Column):
    """Exact, upper, lower, then prefix + key upper-cased."""
    return [key, F.upper(key), F.lower(key), F.upper(F.concat(F.lit(rules.ID_PREFIX), key))]


def candidates_prefix(key: Column):
    """Exact, then prefix + key."""
    return [key, F.concat(F.lit(rules.ID_PREFIX), key)]


def candidates_path(base: str, extensions=rules.RESOLVE_EXTENSIONS):
    """Absolute value, base/value, exact name, file name of value, stem of value,
    then value + each extension (the ensemble lookup order)."""
    def fn(key: Column):
        b = base.rstrip("/")
        return ([F.when(key.startswith("/"), key), F.concat(F.lit(b + "/"), key), key,
                 file_name(key), file_stem(key)]
                + [F.concat(key, F.lit(e)) for e in extensions])
    return fn


# --------------------------------------------------------------------- catalog
def image_files(catalog: DataFrame, path_col: str = "path",
                extensions=rules.IMAGE_EXTENSIONS) -> DataFrame:
    """Catalog rows whose extension (case-insensitive) is an image extension."""
    return catalog.where(F.lower(file_ext(F.col(path_col))).isin(list(extensions)))


def alias_table(catalog: DataFrame, path_col: str = "path", alias_rule=aliases_lesion) -> DataFrame:
    """(alias, path): one row per alias; duplicate aliases -> smallest path (Q11)."""
    p = F.col(path_col)
    stem = strip(file_stem(p))
    arr = F.array(*[a.cast("string") for a in alias_rule(stem, p)])
    return (catalog.select(p.alias("path"), F.explode(arr).alias("alias"))
            .where(F.col("alias").isNotNull())
            .groupBy("alias").agg(F.min("path").alias("path")))


# --------------------------------------------------------------------- lookups
def resolve_keys(wanted: DataFrame, key_col: str, aliases: DataFrame,
                 candidate_rule=candidates_lesion) -> DataFrame:
    """Distinct keys -> (key, path, priority) for keys with a hit (first hit in
    priority order wins)."""
    keys = (wanted.select(strip(F.col(key_col).cast("string")).alias("key"))
            .where(F.col("key").isNotNull()).distinct())
    k = F.col("key")
    cands = F.array(*[F.struct(F.lit(i).alias("priority"), c.cast("string").alias("cand"))
                      for i, c in enumerate(candidate_rule(k))])
    exploded = (keys.select("key", F.explode(cands).alias("c"))
                .select("key", "c.priority", F.col("c.cand").alias("alias"))
                .where(F.col("alias").isNotNull()))
    hits = exploded.join(aliases, "alias")
    return hits.groupBy("key").agg(
        F.min_by(F.struct("path", "priority"), F.struct("priority", "path")).alias("b")
    ).select("key", "b.path", "b.priority")


def ordered_files(catalog: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, rank): every path once, written in the order of stem length and path, which the
    ranks follow (with gaps).  Paths are dealt first, however few files hold the catalog, so
    what a task holds does not grow with the table."""
    paths = catalog.select(F.col(path_col).alias("path")).repartition("path").distinct()
    order = [F.length(file_stem(F.col("path"))), F.col("path")]
    return materialize(paths.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("rank", F.monotonically_increasing_id()))


def substring_hits(keys: DataFrame, key_col: str, catalog: DataFrame, path_col: str = "path",
                   carry: str | None = None) -> DataFrame:
    """(key, path, n): every file whose stem contains a wanted key at some place, n the stem's
    length; with ``carry``, (key, that column of the catalog).  Substrings that are no key are dropped where they are cut, in a join with the keys,
    broadcast up to a counted bound; beyond it the join shuffles them."""
    k = keys.select(F.col(key_col).alias("key")).where(
        F.col("key").isNotNull() & (F.length("key") > 0)).distinct()
    lengths = k.agg(F.collect_set(F.length("key")).alias("sizes"))    # one row: the few distinct lengths
    stem, size = F.col("stem"), F.col("size")
    file = [F.col(path_col).alias("path"), F.length("stem").alias("n")] if carry is None else [F.col(carry)]
    stems = catalog.withColumn("stem", file_stem(F.col(path_col))).select("stem", *file)
    cut = (attach_single_row(stems, lengths).select("*", F.explode("sizes").alias("size"))
           .where(F.length("stem") >= size)
           .select(*stems.columns[1:], F.explode(F.array_distinct(F.transform(
               F.sequence(F.lit(1), F.length("stem") - size + 1),
               lambda i: F.substring(stem, i, size)))).alias("key")))
    return cut.join(broadcast_if_small(k, MOST_BROADCAST_KEYS), "key", "left_semi").select("key", *stems.columns[1:])


#: Up to so many wanted keys are broadcast to the cutting of the stems.
MOST_BROADCAST_KEYS = 1_000_000


def resolve_by_substring(keys: DataFrame, key_col: str, catalog: DataFrame,
                         path_col: str = "path") -> DataFrame:
    """For each key, the file whose stem contains it; several -> shortest stem,
    then smallest path.  Keys without a hit are absent from the result."""
    return _by_substring(keys, key_col, ordered_files(catalog, path_col))


def _by_substring(keys: DataFrame, key_col: str, files: DataFrame) -> DataFrame:
    wanted = materialize(keys.select(F.col(key_col).alias("key")).distinct())
    hits = substring_hits(wanted, "key", files, "path", carry="rank")
    return hits.groupBy("key").agg(F.min("rank").alias("rank")).join(files, "rank").select("key", "path")


def find_files(wanted: DataFrame, key_col: str, catalog: DataFrame, path_col: str = "path",
               alias_rule=aliases_lesion, candidate_rule=candidates_lesion,
               substring_fallback: bool = True, out: str = "path") -> DataFrame:
    """J1 then J2 on the remainder: ``wanted`` + ``out`` (NULL when unresolved) +
    ``<out>_by`` (candidate priority, 'substring' or NULL)."""
    files = ordered_files(catalog, path_col) if substring_fallback else catalog.select(F.col(path_col).alias("path"))
    exact = resolve_keys(wanted, key_col, alias_table(files, "path", alias_rule), candidate_rule)
    res = exact.select("key", "path", F.col("priority").cast("string").alias("by"))
    if substring_fallback:
        # Without remaining keys there is no length to cut, and the stems yield no row.
        remaining = (wanted.select(strip(F.col(key_col).cast("string")).alias("key"))
                     .where(F.col("key").isNotNull()).distinct()
                     .join(exact.select("key"), "key", "left_anti"))
        sub = _by_substring(remaining, "key", files)
        res = res.unionByName(sub.select("key", "path", F.lit("substring").alias("by")))
    w = wanted.withColumn("__key", strip(F.col(key_col).cast("string")))
    found = (w.where(F.col("__key").isNotNull())
             .join(res.select(F.col("key").alias("__key"), F.col("path").alias(out), F.col("by").alias(f"{out}_by")),
                   "__key", "left").drop("__key"))
    # Rows without a key match nothing: they stay out of the join, where all would meet in one task.
    none = w.where(F.col("__key").isNull()).drop("__key").withColumns(
        {c: F.lit(None).cast("string") for c in (out, f"{out}_by")})
    return found.unionByName(none)


# ------------------------------------------------------------------ truth joins
def dedupe_last(df: DataFrame, key: str, order: str, cols) -> DataFrame:
    """W2 last-wins: per key, the values of the row with the largest ``order``."""
    return df.groupBy(key).agg(*[F.max_by(F.col(c), F.col(order)).alias(c) for c in cols])


def dedupe_first(df: DataFrame, key: str, order: str, cols=()) -> DataFrame:
    """W2 first-wins: per key, the row with the smallest ``order`` (order kept)."""
    return df.groupBy(key).agg(F.min(order).alias(order),
                               *[F.min_by(F.col(c), F.col(order)).alias(c) for c in cols])


def attach_truth(preds: DataFrame, pred_id: str, truth: DataFrame, truth_id: str,
                 truth_cols, order: str) -> DataFrame:
    """Case-insensitive, trimmed id match; duplicate truth ids -> last row wins;
    only matched predictions kept (inner)."""
    t = truth.withColumn("__id", F.upper(strip(F.col(truth_id))))
    t = dedupe_last(t, "__id", order, list(truth_cols))
    p = preds.withColumn("__id", F.upper(strip(F.col(pred_id))))
    return p.join(t, "__id").drop("__id")


def pair_views(df: DataFrame, key: str, type_col: str, cols, multiple: str,
               left_kind: str = "derm", right_kind: str = "clinic",
               left_suffix: str = "_derm", right_suffix: str = "_clin",
               order: str | None = None) -> DataFrame:
    """Rows whose lower-cased type contains ``left_kind`` paired with rows of the
    same key containing ``right_kind``; a key missing a side vanishes.

    ``multiple="all"`` gives every left x right combination of a key, as a merge does;
    ``multiple="first"`` keeps one row per side and key: the one with the smallest
    ``order`` value (default: the first listed column)."""
    if multiple not in ("first", "all"):
        raise ValueError("multiple must be 'first' or 'all'")
    t = F.lower(F.col(type_col).cast("string"))
    order = order or cols[0]

    def side(kind, suffix):
        x = df.where(t.contains(kind))
        if multiple == "first":
            x = x.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order))
                                   .alias("__s")).select(key, "__s.*")
        return x.select(key, *[F.col(c).alias(c + suffix) for c in cols])

    return side(left_kind, left_suffix).join(side(right_kind, right_suffix), key)


def join_model_outputs(a: DataFrame, b: DataFrame, a_key: str, b_key: str,
                       required=()) -> DataFrame:
    """J6 (+P2): left join of two models' outputs on the row id followed by dropping
    rows missing any required column -- written as an inner join plus per-column
    null filters, which is what the pair computes and what Catalyst can push down."""
    j = a.join(b.withColumnRenamed(b_key, a_key), a_key, "inner")
    return drop_incomplete(j, required)


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    """Drop rows with NULL (or NaN) in any listed column, one filter per column."""
    conds = []
    for c in cols:
        col = F.col(c)
        dt = dict(df.dtypes)[c]
        conds.append(col.isNotNull() & (~F.isnan(col) if dt in ("double", "float") else F.lit(True)))
    return df.where(reduce(lambda x, y: x & y, conds)) if conds else df


def not_yet_done(cases: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Cases whose key is not in the done table (absent table -> all)."""
    if done is None:
        return cases
    d = done.select(F.col(key).cast("string").alias("__k")).where(F.col("__k").isNotNull())
    return (cases.withColumn("__k", F.col(key).cast("string"))
            .join(d, "__k", "left_anti").drop("__k"))


def matched_ids(files: DataFrame, file_id: str, meta: DataFrame, meta_id: str) -> DataFrame:
    """File ids (normalised upper/trim) that also occur in the metadata.  Raises
    with help text when the intersection is empty (a one-row probe, no full count)."""
    f = files.select(F.upper(strip(F.col(file_id))).alias("id")).where(F.col("id").isNotNull())
    m = meta.select(F.upper(strip(F.col(meta_id))).alias("id"))
    both = f.join(m, "id", "left_semi").distinct()
    if not both.limit(1).collect():
        raise ValueError("no file id matches a metadata id; check the id columns "
                         f"({file_id!r} vs {meta_id!r}) and their normalisation")
    return both


def present_only(cases: DataFrame, catalog: DataFrame, cols, path_col: str = "path"):
    """P5: (kept, skipped): a case is kept only when every listed image column
    resolves to a catalog path.

    A case with a NULL among them is skipped without a lookup.  The paths of the others, one
    row each, are looked up in one join, whatever the number of columns; one aggregate by
    the case's number, which brings its row along, tells whether all were found.  It is
    written once, and both parts are filters of it."""
    cols = list(cols)
    files = catalog.select(F.col(path_col).alias("__path")).where(F.col("__path").isNotNull()).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in cases.columns])
    every = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
    whole = materialize(cases.where(every).select(row.alias("__row"), F.monotonically_increasing_id().alias("__case")))
    paths = F.array_distinct(F.array(*[F.col("__row")[c].cast("string") for c in cols]))
    wanted = whole.select("__case", "__row", F.explode(paths).alias("__path"))
    found = wanted.join(files.withColumn("__there", F.lit(True)), "__path", "left")
    judged = materialize(found.groupBy("__case").agg(F.first("__row").alias("__row"),
                                                     F.bool_and(F.col("__there").isNotNull()).alias("__all")))
    skipped = judged.where(~F.col("__all")).select("__row.*")
    return judged.where("__all").select("__row.*"), skipped.unionByName(cases.where(~every))


def missing_report(resolved: DataFrame, key: str, path: str, n: int = 10) -> DataFrame:
    """Number of unresolved keys and the first ``n`` of them (sorted)."""
    miss = resolved.where(F.col(path).isNull()).select(key).distinct()
    head = miss.orderBy(key).limit(n).agg(F.sort_array(F.collect_list(key)).alias("first_missing"))
    cnt = miss.agg(F.count(F.lit(1)).alias("n_missing"))
    return attach_single_row(cnt, head)


def skip_existing(ids: DataFrame, id_col: str, catalog: DataFrame, path_col: str = "path",
                  exts=(".jpg", ".png")) -> DataFrame:
    """Ids whose ``<id>.jpg`` (first) or ``<id>.png`` exists in the catalog get
    that path and source 'existing'; others get NULLs."""
    files = catalog.select(F.col(path_col).alias("path"),
                           file_name(F.col(path_col)).alias("fname"))
    cand = ids.select(F.col(id_col).alias("__id"),
                      F.explode(F.array(*[F.struct(F.lit(i).alias("prio"),
                                                   F.concat(F.col(id_col), F.lit(e)).alias("fname"))
                                          for i, e in enumerate(exts)])).alias("c"))
    hits = (cand.select("__id", "c.prio", "c.fname").join(files, "fname")
            .groupBy("__id").agg(F.min_by("path", F.struct("prio", "path")).alias("existing_path")))
    return (ids.join(hits.withColumnRenamed("__id", id_col), id_col, "left")
            .withColumn("image_src", F.when(F.col("existing_path").isNotNull(), F.lit("existing"))))


def stack_scenarios(frames: dict) -> DataFrame:
    """The same cases under several scenarios, tagged by ``scenario``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn("scenario", F.lit(name)) for name, df in frames.items()])
