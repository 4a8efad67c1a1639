"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm import (
    decontaminate, html_text, lexical_search, line_dedup, masked_lm, mixing, near_dedup,
    periodic_runs, quality_rules, sentencepiece_trie, substring_dedup, token_file, tool_chat,
)
from caliper.llm.registry import query
from caliper.plans.tables import table


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_token_ids")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_line_dedup", r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
bad AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
        HAVING count(DISTINCT coalesce('=' || source, '-')) >= 10),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM l
         WHERE line NOT IN (SELECT line FROM bad) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_decontaminate", r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
       FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM bw),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s
       FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
dwin AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM dw),
hit AS (SELECT x.doc_id, x.s, x.n, y.item_id FROM dwin x JOIN win y ON x.win = y.win AND x.n = y.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_masked_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.masked_lm(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_trie.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op9_tool_chat")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.chat(table(spark, sf_dir, "conversations"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.planted(table(spark, sf_dir, "documents")))


@query("op12_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
       FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM b) GROUP BY doc_id, n, term),
df AS (SELECT term, floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
       FROM tf, total GROUP BY term),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf
             + 8 * (100 - 90 + (90 * tf.n * total.n) // total.l))))::BIGINT AS score
      FROM b JOIN df USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
             / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE
                 * (length(text) - length(translate(text, '0123456789#*$%&|<>[]{}=_~^@', '')))
                 / nullif(length(text), 0)), 1.0::DOUBLE) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
c AS (SELECT *, sum(size) OVER () - 3 * coalesce(sum(size) OVER before, 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS share
      FROM s WINDOW before AS (ORDER BY size::DOUBLE / w, source NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest, share FROM c WHERE w * rest <= 3 * size * share ORDER BY share DESC LIMIT 1),
t AS (SELECT source, s.size AS source_size, least(3.0::DOUBLE * s.size, (w * rest)::DOUBLE / share::DOUBLE) AS target
      FROM s, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (SELECT doc_id, d.size, source_size, target, epochs, floor(target - epochs * source_size)::BIGINT
             - (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id) - d.size) AS rest
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest)))::BIGINT AS taken FROM p""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
