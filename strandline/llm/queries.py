"""The registered query of each training-data operator, with its production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decontamination
from . import html_text, line_dedup, mixing, near_dedup, packing, quality, token_count, toxicity, warc
from .common import LOWER, UPPER, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n_words=4)


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_OP1 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, p, p + 9), ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0) x),
ms AS (SELECT DISTINCT m FROM win),
dw AS (SELECT r, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS t FROM (SELECT r, w, m, unnest(range(1, CAST(len(w) AS BIGINT) - m + 2)) AS p FROM d, ms WHERE len(w) >= m) x),
hit AS MATERIALIZED (SELECT r, p, win.m, item FROM dw JOIN win ON dw.t = win.t AND dw.m = win.m),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) x GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""
_OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS MATERIALIZED (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d) x),
f AS (SELECT k, min(doc_id) AS first FROM e WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
g AS (SELECT r, e.doc_id, i, line, coalesce(e.doc_id <> first, false) AS gone FROM e LEFT JOIN f ON e.k = f.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id"""
_OP10 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, CAST(len(w) AS BIGINT) - 3) + 1)) AS p FROM d WHERE len(w) > 0) x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id"""

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_packing, op3_token_counts, op4_quality_rules, op5_line_dedup, op6_source_mix, op7_toxicity, op8_warc_revisits, op9_html_extraction, op10_near_duplicates)}
ORACLES = {"op1_decontaminate": _OP1, "op4_quality_rules": quality.oracle_sql(), "op5_line_dedup": _OP5, "op6_source_mix": mixing.oracle_sql(), "op8_warc_revisits": warc.oracle_sql(), "op10_near_duplicates": _OP10}
