"""Sources: id lists, CSV tables, file catalogs, class maps, nested JSON records.

Everything returns a lazy DataFrame; schemas are explicit where the data has
types (no ``inferSchema``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caliper.functions import rules
from caliper.functions.text import file_ext, file_name, na_strings_to_null, strip


def require_columns(df: DataFrame, cols, what: str = "table") -> DataFrame:
    """Fail before any work, naming the missing column and what exists."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found in {what}; available: {df.columns}")
    return df


def with_row_id(df: DataFrame, order_cols=None, col: str = "row_id") -> DataFrame:
    """Consecutive 0-based ids in ``order_cols`` order or, without them, in source order.

    Two phases, no single-partition window: ``monotonically_increasing_id`` (partition
    index in the high bits, position in the low 33 bits) is frozen by a checkpoint,
    per-partition counts (one row per partition) give each partition its start
    offset, broadcast back.  Without ``order_cols``, rows read from files are numbered by
    ``with_file_position``; other rows in the order of their partitions."""
    from caliper.operators.prefix import materialize

    if order_cols:
        df = df.orderBy(*order_cols)
    elif _has_files(df):
        return with_file_position(df, col)
    tagged = materialize(df.withColumn("__mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumns({"__pid": F.shiftright("__mid", 33),
                                 "__pos": F.col("__mid").bitwiseAND((1 << 33) - 1)})
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__pid", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("__start"))
    out = tagged.join(F.broadcast(starts), "__pid")
    return out.select(*df.columns, (F.col("__start") + F.col("__pos")).alias(col))


def _has_files(df: DataFrame) -> bool:
    """Whether the rows know the file they come from."""
    try:
        return bool(df.select("_metadata.file_path").columns)
    except AnalysisException:
        return False


def with_file_position(df: DataFrame, col: str = "pos") -> DataFrame:
    """Consecutive 0-based positions of rows read from files: files by path, lines in order.

    Spark deals files and their blocks to partitions by size, so a partition's number says
    nothing about order.  A block (path and start in the file) is read by one task, in order: a
    row's place in it is its distance from the block's first row, and the counts of the blocks
    before it come from a distributed running sum over the blocks, a row each."""
    from caliper.operators.prefix import broadcast_if_small, materialize, running_sums

    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    tagged = materialize(df.select(*[F.col(f"`{c}`") for c in df.columns], block.alias("__block"),
                                   F.monotonically_increasing_id().alias("__mid")))
    blocks = materialize(tagged.groupBy("__block").agg(F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n")))
    starts = running_sums(blocks, [], "__block", ["__n"], inclusive=False)
    starts = materialize(starts.select(F.col("__block").alias("__of"), "__first", F.col("cum___n").alias("__start")))
    out = tagged.join(broadcast_if_small(starts), F.col("__block") == F.col("__of"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      (F.col("__start") + F.col("__mid") - F.col("__first")).alias(col))


def read_ids(spark: SparkSession, path: str, id_col: str | None = None) -> DataFrame:
    """Ids from a text file (one per line) or one CSV column, or from a folder of them;
    stripped, blanks dropped, de-duplicated keeping the first occurrence; ``pos`` is its line
    (blank ones count) in the order of the files' paths."""
    if path.lower().endswith(".csv"):
        if not id_col:
            raise ValueError("id_col is required for CSV input")
        raw = spark.read.option("header", True).csv(path)
        require_columns(raw, [id_col], path)
        value = F.col(f"`{id_col}`").cast("string")
    else:
        raw, value = spark.read.text(path), F.col("value")
    ids = with_file_position(raw).select(strip(value).alias("id"), "pos")
    ids = ids.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return ids.groupBy("id").agg(F.min("pos").alias("pos"))


def read_table_csv(spark: SparkSession, path: str, schema: StructType,
                   pandas_nulls: bool = True) -> DataFrame:
    """CSV with header and an explicit schema.  With ``pandas_nulls`` the usual
    missing-value spellings (NA, N/A, NaN, null, None, '' ...) become NULL first,
    then values are cast (a failed cast is NULL)."""
    as_str = StructType([StructField(f.name, StringType(), True) for f in schema.fields])
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(as_str).csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if pandas_nulls:
            c = na_strings_to_null(c)
        cols.append((c if isinstance(f.dataType, StringType) else c.try_cast(f.dataType))
                    .alias(f.name))
    return raw.select(*cols)


def read_table_strings(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV with header, every column a string, missing -> ''."""
    df = spark.read.option("header", True).csv(path)
    return df.na.fill("")


def read_file_catalog(spark: SparkSession, root: str, recursive: bool = True,
                      extensions=rules.IMAGE_EXTENSIONS, name_regex: str | None = None,
                      limit: int | None = None, with_content: bool = False) -> DataFrame:
    """Files under ``root`` with an image extension (case-insensitive), optional
    name regex, sorted by path, optional first ``limit``.  Without ``with_content``
    the scan's ReadSchema holds only path/length/modificationTime, so file bytes
    are never read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    df = df.select(*cols)
    if not recursive:
        base = root.rstrip("/").removeprefix("file:") + "/"
        p = F.regexp_replace(F.col("path"), r"^file:", "")
        # literal prefix test (no regex built from the path): top level = no "/" left
        rel = F.substring(p, len(base) + 1, 1 << 30)
        df = df.where(p.startswith(base) & ~rel.contains("/"))
    df = df.where(F.lower(file_ext(F.col("path"))).isin(list(extensions)))
    if name_regex:
        df = df.where(file_name(F.col("path")).rlike(name_regex))
    df = df.orderBy("path")
    return df.limit(limit) if limit else df


def data_url(content, path, style: str = "png_else_jpeg") -> Column:
    """Bytes -> ``data:<mime>;base64,<b64>``; Spark's base64 wraps lines, the
    line breaks are removed.  ``style``: png_else_jpeg, or extension (jpg -> jpeg)."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.lower(F.regexp_replace(file_ext(p), r"^\.", ""))
    if style == "png_else_jpeg":
        mime = F.when(ext == "png", F.lit("image/png")).otherwise(F.lit("image/jpeg"))
    elif style == "extension":
        mime = F.concat(F.lit("image/"), F.when(ext == "jpg", F.lit("jpeg")).otherwise(ext))
    else:
        raise ValueError(style)
    b64 = F.regexp_replace(F.base64(F.col(content) if isinstance(content, str) else content),
                           r"[\r\n]", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), b64)


def image_payloads(catalog: DataFrame, style: str = "png_else_jpeg") -> DataFrame:
    """S5 over a catalog read ``with_content=True``."""
    return catalog.select("path", data_url("content", "path", style).alias("data_url"))


def read_class_map(spark: SparkSession, idx_json: str, fam_json: str,
                   unmapped: str = rules.UNMAPPED_FAMILY) -> DataFrame:
    """Index->class and class->family JSON objects as one dimension
    (class_idx, class, family); unmapped class -> 'NA'."""
    m = "map<string,string>"
    idx = (spark.read.text(idx_json, wholetext=True)
           .select(F.explode(F.from_json("value", m)).alias("k", "class"))
           .select(F.col("k").cast("int").alias("class_idx"), "class"))
    fam = (spark.read.text(fam_json, wholetext=True)
           .select(F.explode(F.from_json("value", m)).alias("class", "family")))
    from caliper.operators.prefix import broadcast_if_small

    return (idx.join(broadcast_if_small(fam), "class", "left")
            .select("class_idx", "class", F.coalesce("family", F.lit(unmapped)).alias("family")))


ERR_RECORD = "could not parse JSON"


_NODE = "struct<key:string,v:variant>"
#: Levels walked in one pass: the first and the most (each pass takes twice as many as the one before).
LEVELS = (3, 24)


def _one_level(rows: DataFrame) -> DataFrame:
    """Objects and lists give way to their children, scalars stay as they are."""
    v, key = F.col("n.v"), F.col("n.key")

    def child_key(name):
        return F.when(key.isNull(), name).otherwise(F.concat(key, F.lit("."), name))

    objs = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")),
                       lambda e: F.struct(child_key(e["key"]).alias("key"), e["value"].alias("v")))
    arrs = F.transform(F.try_variant_get(v, "$", "array<variant>"),
                       lambda x, i: F.struct(F.concat(F.coalesce(key, F.lit("")), F.lit("["), i.cast("string"), F.lit("]"))
                                             .alias("key"), x.alias("v")))
    children = F.coalesce(objs.cast(f"array<{_NODE}>"), arrs.cast(f"array<{_NODE}>"), F.array(F.col("n")).cast(f"array<{_NODE}>"))
    return rows.select("__id", F.explode(children).alias("n"))


def flatten_json(df: DataFrame, id_col: str, json_col: str, error_key: str = "_error") -> DataFrame:
    """Nested JSON text -> long (id, key, value) with keys ``a.b`` and ``c[0]``;
    empty objects / lists emit nothing; JSON null is emitted (value NULL); values
    are the scalar's text.  A text that is no JSON gives one row under ``error_key``.

    A frontier walk with no shuffle: a pass takes a block of levels, one explode a level, and
    writes what it reaches once; scalars are finished there, and only containers that are still
    open go on to the next pass, until there are none.  No text is measured beforehand: broken
    records end in the first pass, and the depth is bounded by what the parser accepts (it
    refuses records of more than 1,000 levels or of too many bytes, which are error rows)."""
    from caliper.operators.prefix import materialize

    v = F.col("n.v")
    is_open = F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull()
    text = F.when(F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.try_variant_get(v, "$", "string"))
    rows = df.select(F.col(id_col).alias("__id"), F.col(json_col).alias("__text")).where(F.col("__text").isNotNull()) \
        .select("__id", F.struct(F.lit(None).cast("string").alias("key"), F.try_parse_json("__text").alias("v")).alias("n"))
    done, levels = [], LEVELS[0]
    while True:
        for _ in range(levels):
            rows = _one_level(rows)
        bad = v.isNull()
        reached = materialize(rows.select("__id", "n.key", bad.alias("bad"), F.when(is_open, v).alias("open"),
                                          F.when(~bad & ~is_open, text).alias("value")))
        done.append(reached.where("open IS NULL"))
        still = reached.where("open IS NOT NULL")
        if not still.limit(1).count():
            break
        rows = still.select("__id", F.struct("key", F.col("open").alias("v")).alias("n"))
        levels = min(2 * levels, LEVELS[1])
    whole = reduce(DataFrame.unionByName, done)
    return whole.select(F.col("__id").alias(id_col), F.when(F.col("bad"), F.lit(error_key)).otherwise(F.col("key")).alias("key"),
                        F.when(F.col("bad"), F.lit(ERR_RECORD)).otherwise(F.col("value")).alias("value"))


def widen_metadata(long: DataFrame, id_col: str, keys, first_cols=rules.PREFERRED_METADATA_COLUMNS,
                   key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Pivot flat keys to columns (missing -> ''), preferred columns first, then
    the remaining keys in the given order.  ``keys`` is the column roster, a list that
    the caller chooses (``metadata_keys`` lists what there is), so the pivot needs no
    extra job."""
    keys = list(keys)
    wide = long.groupBy(id_col).pivot(key_col, keys).agg(F.first(value_col))
    ordered = [c for c in first_cols if c in keys] + [k for k in keys if k not in first_cols]
    return wide.select(id_col, *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k)
                                 for k in ordered if k != id_col]).na.fill("")


def metadata_keys(long: DataFrame, id_order: str, key_col: str = "key") -> DataFrame:
    """Key roster as a table (key, first): every key and the least ``id_order`` that has
    it.  The long form needs no roster; the wide form takes one as a list."""
    return long.groupBy(key_col).agg(F.min(id_order).alias("first"))


def fetch_status(attempts: DataFrame, sources=rules.FETCH_SOURCES) -> DataFrame:
    """Per id, from attempts (id, kind 'meta'|'image', source, ok, http_code,
    message, seq): the first successful image source in preference order and the
    status text ``OK`` / ``HTTPError <code>`` / ``Error: <msg>``, with
    `` (image error: <last image message>)`` when no image source worked."""
    prio = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    meta = attempts.where(F.col("kind") == "meta").groupBy("id").agg(
        F.max_by(F.struct("ok", "http_code", "message"), F.col("seq")).alias("m"))
    img = attempts.where(F.col("kind") == "image").groupBy("id").agg(
        F.min_by(F.col("source"), F.when(F.col("ok"), F.element_at(prio, F.col("source"))))
        .alias("src"),
        F.max(F.col("ok").cast("int")).alias("img_ok"),
        F.max_by(F.col("message"), F.col("seq")).alias("img_msg"))
    j = meta.join(img, "id", "full")
    base = (F.when(F.col("m.ok"), F.lit("OK"))
            .when(F.col("m.http_code").isNotNull(),
                  F.concat(F.lit("HTTPError "), F.col("m.http_code").cast("string")))
            .otherwise(F.concat(F.lit("Error: "), F.coalesce(F.col("m.message"), F.lit("")))))
    failed = F.coalesce(F.col("img_ok"), F.lit(0)) == 0
    status = F.when(failed, F.concat(base, F.lit(" (image error: "),
                                     F.coalesce(F.col("img_msg"), F.lit("")), F.lit(")"))) \
        .otherwise(base)
    return j.select("id", status.alias("_status"),
                    F.when(~failed, F.col("src")).otherwise(F.lit("")).alias("_image_src"))
