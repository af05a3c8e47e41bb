"""Registered queries of the engine on the driver's tables, with DuckDB SQL.

Documents serve as targets and benchmark items as reads, their letters mapped to nucleotides; languages and sources make the
taxonomy. Other operators run on the star schema: customers under nations under regions as a tree, order lines as an index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna, ids, ranks
from ..operators import abundance, align, candidates, classify, evaluate, index, sketch, taxonomy
from ..options import ClassifyOptions, FormatOptions, SketchOptions
from ..sources.sequences import filter_reads
from ..sources.taxonomy_files import assign_parents
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPTIONS = SketchOptions()
CLASSIFY = ClassifyOptions().normalised(OPTIONS.size)
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTNCGTACNTAN"


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dna(c):
    return F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", ""), _FROM, _TO)


# Inputs, in both forms.
_DNA = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}')"


def _targets(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", _dna(F.col("text")).alias("seq"))
    return docs.select(F.col("doc_id").alias("tgt"), (-F.col("doc_id") - 1).alias("id"), F.concat(F.lit("D_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("name"), "lang", "source", "seq")


def _reads(spark, d):
    items = _t(spark, d, "benchmark").select(F.col("item_id"), _dna(F.col("text")).alias("s"))
    half = F.floor(F.length("s") / 2).cast("int")
    two = dna.reverse_complement(F.expr("substring(s, cast(floor(length(s) / 2) as int) + 1)"))
    return items.select(F.col("item_id").alias("query_id"), F.concat(F.lit("D_"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("header"), F.substring(F.col("s"), F.lit(1), half).alias("seq1"), two.alias("seq2"), F.lit("benchmark").alias("file"))


def _taxa(spark, d):
    pairs = _t(spark, d, "documents").groupBy("lang", "source").count()  # a row for each language and source
    w = lambda *c: F.dense_rank().over(Window.orderBy(*c))
    rows = pairs.select("lang", "source", (10 + w("lang")).cast("bigint").alias("genus"), (1000 + w("lang", "source")).cast("bigint").alias("species"))
    species = rows.select(F.col("species").alias("id"), F.col("genus").alias("parent"), F.concat_ws("/", "lang", "source").alias("name"), F.lit(ranks.SPECIES).alias("rank"))
    genera = rows.select(F.col("genus").alias("id"), F.lit(1).cast("bigint").alias("parent"), F.col("lang").alias("name"), F.lit(ranks.GENUS).alias("rank")).distinct()
    root = spark.range(1, 2).select("id", F.lit(1).cast("bigint").alias("parent"), F.lit("root").alias("name"), F.lit(ranks.ROOT).alias("rank"))
    return species.union(genera).union(root), rows


def _lineages(spark, d):
    taxa, rows = _taxa(spark, d)
    t = _targets(spark, d).select("tgt", "id", "lang", "source").join(rows, ["lang", "source"])
    nodes = taxa.select("id", "parent", "rank").union(t.select("id", F.col("species").alias("parent"), F.lit(0).alias("rank")))
    lines = taxonomy.ranked_lineages(nodes, 4)
    return taxa, lines, lines.where("id < 0").select((-F.col("id") - 1).alias("tgt"), "lineage")


def _sketch_ctes(name: str, owner: str, src: str) -> str:
    """Least 16 distinct features of each window of 112 k-mers: k-mers by doubling, over neighbours."""
    lead = lambda c, n: f"lead({c}, {n}) OVER (PARTITION BY o, part ORDER BY i)"
    return f"""
{name}_c AS (SELECT o, part, i, CASE WHEN c IN ('A', 'C', 'G', 'T') THEN 0 ELSE 1 END AS bad, greatest(instr('ACGT', c) - 1, 0)::BIGINT AS f1 FROM (SELECT o, part, i, s[i + 1] AS c FROM (SELECT {owner} AS o, part, s, unnest(range(length(s))) AS i FROM {src}) u) v),
{name}_2 AS (SELECT *, f1 * 4 + {lead('f1', 1)} AS f2, (3 - f1) + 4 * (3 - {lead('f1', 1)}) AS r2 FROM {name}_c),
{name}_4 AS (SELECT *, f2 * 16 + {lead('f2', 2)} AS f4, r2 + 16 * {lead('r2', 2)} AS r4 FROM {name}_2),
{name}_8 AS (SELECT *, f4 * 256 + {lead('f4', 4)} AS f8, r4 + 256 * {lead('r4', 4)} AS r8 FROM {name}_4),
{name}_k AS (SELECT o, part, i, f8 * 65536 + {lead('f8', 8)} AS f, r8 + 65536 * {lead('r8', 8)} AS r, sum(bad) OVER (PARTITION BY o, part ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS bad FROM {name}_8),
{name}_h1 AS (SELECT o, part, i, xor(least(f, r) >> 16, least(f, r)) * 73244475 & 4294967295 AS x FROM {name}_k WHERE bad = 0 AND f IS NOT NULL AND r IS NOT NULL),
{name}_h2 AS (SELECT o, part, i, xor(x >> 16, x) * 73244475 & 4294967295 AS x FROM {name}_h1),
{name}_h AS (SELECT DISTINCT o, part, i // 112 AS win, xor(x >> 16, x) AS feature FROM {name}_h2 WHERE xor(x >> 16, x) <> 4294967295),
{name} AS MATERIALIZED (SELECT o AS owner, part, win, feature FROM {name}_h QUALIFY row_number() OVER (PARTITION BY o, part, win ORDER BY feature) <= 16)"""


_DOCS = f"docs AS (SELECT doc_id, 1 AS part, {_DNA} AS s FROM documents), {_sketch_ctes('dsk', 'doc_id', 'docs')}"
_ITEMS = f"""item0 AS (SELECT item_id, {_DNA} AS s FROM benchmark),
items AS (SELECT item_id, 1 AS part, substr(s, 1, length(s) // 2) AS s FROM item0 UNION ALL SELECT item_id, 2, reverse(translate(substr(s, length(s) // 2 + 1), 'ACGT', 'TGCA')) FROM item0), {_sketch_ctes('isk', 'item_id', 'items')}"""
_INDEX = "idx AS MATERIALIZED (SELECT feature, owner AS tgt, win FROM dsk QUALIFY row_number() OVER (PARTITION BY feature ORDER BY owner, win) <= 254)"
_HITS = "hits AS MATERIALIZED (SELECT isk.owner AS query_id, tgt, idx.win, CAST(count(*) AS BIGINT) AS n FROM isk JOIN idx ON isk.feature = idx.feature GROUP BY ALL)"
_RANGES = """nw AS (SELECT item_id AS query_id, 2 + length(s) // 112 AS n_win FROM item0),
spans AS (SELECT a.query_id, a.tgt, a.win, CAST(sum(b.n) AS BIGINT) AS hits, min(b.win) AS beg FROM hits a JOIN nw USING (query_id) JOIN hits b ON b.query_id = a.query_id AND b.tgt = a.tgt AND b.win <= a.win AND b.win > a.win - n_win GROUP BY ALL),
ranges AS (SELECT query_id, tgt, hits, beg, win AS "end" FROM spans QUALIFY row_number() OVER (PARTITION BY query_id, tgt ORDER BY hits DESC, win) = 1)"""
_TOP = "top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt) AS pos FROM ranges QUALIFY pos <= 2)"
_TAX = """tx AS (SELECT *, 10 + dense_rank() OVER (ORDER BY lang) AS genus, 1000 + dense_rank() OVER (ORDER BY lang, source) AS species FROM (SELECT DISTINCT lang, source FROM documents) q),
tl AS (SELECT doc_id AS tgt, -doc_id - 1 AS id, genus, species FROM documents JOIN tx USING (lang, source))"""
_CLASSIFIED = f"""cl AS MATERIALIZED (SELECT query_id, CASE WHEN h1 < {CLASSIFY.hits_min} THEN NULL WHEN h2 IS NULL OR h2 <= greatest(h1 - {CLASSIFY.hits_min}, 0) THEN a.id WHEN a.id = b.id THEN a.id WHEN a.species = b.species THEN a.species WHEN a.genus = b.genus THEN a.genus END AS tax, h1 AS hits,
a.id AS aid, a.species AS asp, a.genus AS ag FROM (SELECT query_id, max(hits) FILTER (WHERE pos = 1) AS h1, max(tgt) FILTER (WHERE pos = 1) AS t1, max(hits) FILTER (WHERE pos = 2) AS h2, max(tgt) FILTER (WHERE pos = 2) AS t2 FROM top GROUP BY query_id) p JOIN tl a ON a.tgt = t1 LEFT JOIN tl b ON b.tgt = t2),
clr AS (SELECT query_id, tax, CAST(CASE WHEN tax IS NULL THEN 21 WHEN tax = aid THEN 0 WHEN tax = asp THEN 4 ELSE 6 END AS INTEGER) AS rank, hits FROM cl)"""
_PIPE = ", ".join([_DOCS, _ITEMS, _INDEX, _HITS, _RANGES, _TOP])


def _hits(spark, d):
    reads = _reads(spark, d)
    idx = index.build(sketch.sketch(_targets(spark, d), "tgt", "seq", OPTIONS))
    return reads, candidates.hits(sketch.sketch_pairs(reads, OPTIONS), idx)


def _ranges(spark, d):
    reads, hits = _hits(spark, d)
    spans = reads.select("query_id", candidates.max_windows(F.length("seq1"), F.length("seq2"), 0, OPTIONS.step).alias("n_win"))
    return candidates.window_ranges(hits, spans)


def _classified(spark, d):
    _, _, lines = _lineages(spark, d)
    top = candidates.top_candidates(_ranges(spark, d), CLASSIFY.max_candidates)
    return classify.classify(top, lines, CLASSIFY)


@registered(f"WITH {_DOCS} SELECT owner, win, feature FROM dsk")
def sketch_documents(spark, d):
    return sketch.sketch(_targets(spark, d), "tgt", "seq", OPTIONS)


@registered(f"WITH {_ITEMS} SELECT owner, win, feature FROM isk")
def sketch_read_pairs(spark, d):
    return sketch.sketch_pairs(_reads(spark, d), OPTIONS)


@registered(f"WITH {_DOCS}, {_INDEX} SELECT feature, tgt, win FROM idx")
def index_build(spark, d):
    return index.build(sketch.sketch(_targets(spark, d), "tgt", "seq", OPTIONS))


@registered(f"WITH {', '.join([_DOCS, _ITEMS, _INDEX, _HITS])} SELECT query_id, tgt, win, n FROM hits")
def read_hits(spark, d):
    return _hits(spark, d)[1]


@registered(f'WITH {_PIPE} SELECT query_id, tgt, hits, beg, "end" FROM ranges')
def window_ranges(spark, d):
    return _ranges(spark, d)


@registered(f'WITH {_PIPE} SELECT query_id, tgt, hits, beg, "end", CAST(pos AS INTEGER) AS pos FROM top')
def top_candidates(spark, d):
    return candidates.top_candidates(_ranges(spark, d), 2)


@registered(f"""WITH {_PIPE}, {_TAX}, best AS (SELECT r.*, species AS tax FROM ranges r JOIN tl USING (tgt) QUALIFY row_number() OVER (PARTITION BY query_id, species ORDER BY hits DESC, tgt) = 1)
SELECT query_id, tax, tgt, hits, beg, "end", CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt) AS INTEGER) AS pos FROM best QUALIFY pos <= 2""")
def top_candidates_at_species(spark, d):
    return candidates.top_candidates_at(_ranges(spark, d), _lineages(spark, d)[2], ranks.SPECIES, 2)


@registered(f"WITH {_PIPE}, {_TAX}, {_CLASSIFIED} SELECT query_id, tax, rank, hits FROM clr")
def classify_reads(spark, d):
    return _classified(spark, d)


@registered(f"WITH {_PIPE}, {_TAX}, {_CLASSIFIED} SELECT tax, CAST(count(*) AS DOUBLE) AS n FROM clr WHERE tax IS NOT NULL GROUP BY tax")
def taxon_counts(spark, d):
    return abundance.taxon_counts(_classified(spark, d))


@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, tot AS (SELECT count(*) AS t FROM benchmark), c AS (SELECT tax, rank, count(*)::DOUBLE AS n FROM clr WHERE tax IS NOT NULL GROUP BY tax, rank)
SELECT 21 AS rank, 'unclassified' AS name, CAST(0 AS BIGINT) AS taxid, CAST(t - (SELECT coalesce(sum(n), 0) FROM c) AS DOUBLE) AS n, 100 * (t - (SELECT coalesce(sum(n), 0) FROM c)) / t AS pct FROM tot UNION ALL SELECT rank, CASE WHEN rank = 0 THEN 'D_' || lpad(CAST(-tax - 1 AS VARCHAR), 6, '0') WHEN rank = 4 THEN (SELECT lang || '/' || source FROM tx WHERE species = tax) ELSE (SELECT any_value(lang) FROM tx WHERE genus = tax) END AS name,
CASE WHEN rank = 0 THEN (SELECT species FROM tl WHERE tl.id = tax) ELSE tax END AS taxid, n, 100 * n / t AS pct FROM c, tot""")
def abundance_table(spark, d):
    taxa, rows = _taxa(spark, d)
    t = _targets(spark, d).join(rows, ["lang", "source"]).select("id", F.col("species").alias("parent"), "name", F.lit(0).alias("rank"))
    found = _classified(spark, d)
    return abundance.abundance_table(abundance.taxon_counts(found), taxa.union(t), abundance.totals(_reads(spark, d), found))


@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, u AS (SELECT CASE WHEN rank = 0 THEN (SELECT species FROM tl WHERE tl.id = tax) ELSE tax END AS t, count(*)::DOUBLE AS n FROM clr WHERE tax IS NOT NULL GROUP BY 1), p AS (SELECT t, n, (SELECT any_value(genus) FROM tx WHERE species = t) AS g FROM u), w AS (SELECT g, sum(n) AS w FROM p WHERE g IS NOT NULL GROUP BY g)
SELECT t AS tax, round(n + coalesce((SELECT x.n FROM u x WHERE x.t = p.g), 0) * n / coalesce(w, 1), 9) AS n FROM p LEFT JOIN w USING (g) WHERE t NOT IN (SELECT g FROM w)""")
def abundance_estimate_at_species(spark, d):
    taxa, lines, _ = _lineages(spark, d)
    nodes = taxa.select("id", "rank").union(_targets(spark, d).select("id", F.lit(0).alias("rank")))
    return abundance.estimate(abundance.taxon_counts(_classified(spark, d)), lines, nodes, ranks.SPECIES).withColumn("n", F.round("n", 9))


@registered(f"""WITH {_PIPE}, {_TAX}, cov AS (SELECT tgt, count(DISTINCT w) AS c FROM (SELECT tgt, unnest(range(beg, "end" + 1)) AS w FROM top) u GROUP BY tgt),
win AS (SELECT doc_id AS tgt, CASE WHEN length(s) < 16 THEN 0 WHEN length(s) <= 127 THEN 1 ELSE (length(s) - 127) // 112 + 1 + CASE WHEN length(s) - ((length(s) - 127) // 112 + 1) * 112 >= 16 THEN 1 ELSE 0 END END AS windows FROM docs),
p AS (SELECT tgt, c / greatest(windows, 1) AS cov FROM cov JOIN win USING (tgt)), k AS (SELECT tgt FROM p QUALIFY round(sum(cov) OVER (ORDER BY cov, tgt ROWS UNBOUNDED PRECEDING), 9) > round(0.5 * sum(cov) OVER (), 9))
SELECT query_id, tgt, hits, beg, "end", CAST(pos AS INTEGER) AS pos FROM top WHERE tgt IN (SELECT tgt FROM k)""")
def coverage_filter(spark, d):
    n = F.length("seq")
    full = F.floor((n - 127) / 112) + 1
    windows = F.when(n < 16, 0).when(n <= 127, 1).otherwise(full + (n - full * 112 >= 16).cast("int"))
    targets = _targets(spark, d).select("tgt", windows.alias("windows"))
    return candidates.coverage_filter(candidates.top_candidates(_ranges(spark, d), 2), targets, 0.5)


@registered(f"""WITH {_PIPE} SELECT tgt, string_agg(query_id || '/' || beg || '+' || ("end" - beg) || ':' || hits, ',' ORDER BY beg, "end", query_id, hits) AS matches FROM top GROUP BY tgt""")
def hits_per_target(spark, d):
    return candidates.hits_per_target(candidates.top_candidates(_ranges(spark, d), 2))


@registered(f"WITH {', '.join([_DOCS, _ITEMS, _INDEX, _HITS])} SELECT query_id, string_agg('D_' || lpad(CAST(tgt AS VARCHAR), 6, '0') || '/' || win || ':' || n, ',' ORDER BY tgt, win) AS all_hits FROM hits GROUP BY query_id")
def all_hits_report(spark, d):
    return report.all_hits(_hits(spark, d)[1], _targets(spark, d))


@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, th AS (SELECT query_id, string_agg('D_' || lpad(CAST(tgt AS VARCHAR), 6, '0') || ':' || hits, ',' ORDER BY pos) AS t FROM top GROUP BY query_id)
SELECT b.item_id AS query_id, 'D_' || lpad(CAST(b.item_id AS VARCHAR), 6, '0') AS header, coalesce(t, '') AS top_hits, coalesce(CASE WHEN rank = 0 THEN 'sequence:D_' || lpad(CAST(-tax - 1 AS VARCHAR), 6, '0') WHEN rank = 4 THEN 'species:' || (SELECT lang || '/' || source FROM tx WHERE species = tax) WHEN rank = 6 THEN 'genus:' || (SELECT any_value(lang) FROM tx WHERE genus = tax) END, '--') AS taxon FROM benchmark b LEFT JOIN th ON th.query_id = b.item_id LEFT JOIN clr ON clr.query_id = b.item_id""")
def mapping_report(spark, d):
    taxa, _ = _taxa(spark, d)
    t = _targets(spark, d)
    nodes = taxa.select("id", "name", "rank").union(t.select("id", "name", F.lit(0).alias("rank")))
    tops = report.top_hits(candidates.top_candidates(_ranges(spark, d), 2), t)
    return report.mapping(_reads(spark, d), _classified(spark, d), nodes, FormatOptions(top_hits=True), tops=tops)


@registered()
def read_alignments(spark, d):
    return align.alignments(candidates.top_candidates(_ranges(spark, d), 1), _reads(spark, d), _targets(spark, d), OPTIONS.window, OPTIONS.step)


# Truth: an item's header names the document of its number.
@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, v AS (SELECT b.item_id, coalesce(rank, 21) AS a, CASE WHEN t.id IS NULL THEN 21 ELSE 0 END AS k, CASE WHEN c.tax IS NULL OR t.id IS NULL THEN 21 WHEN x.tgt IS NOT NULL AND x.id = t.id THEN 0 WHEN coalesce(x.species, CASE WHEN rank = 4 THEN tax END) = t.species THEN 4 WHEN coalesce(x.genus, y.genus, CASE WHEN rank = 6 THEN tax END) = t.genus THEN 6 ELSE 20 END AS c0
FROM benchmark b LEFT JOIN tl t ON t.tgt = b.item_id LEFT JOIN clr c ON c.query_id = b.item_id LEFT JOIN tl x ON x.id = c.tax LEFT JOIN (SELECT DISTINCT species, genus FROM tx) y ON y.species = c.tax),
w AS (SELECT a, k, greatest(c0, a, k) AS c FROM v), r AS (SELECT unnest(range(21)) AS rank)
SELECT CAST(r.rank AS INTEGER) AS rank, (SELECT count(*) FROM w) AS total, (SELECT count(*) FROM w WHERE a <= r.rank) AS assigned, (SELECT count(*) FROM w WHERE k <= r.rank) AS known, (SELECT count(*) FROM w WHERE c <= r.rank AND k < 21) AS correct, (SELECT count(*) FROM w WHERE k < 21 AND c > k AND c > a AND c - 1 >= r.rank) AS wrong FROM r""")
def rank_statistics(spark, d):
    _, lines, _ = _lineages(spark, d)
    t = _targets(spark, d).select("id", "name")
    truth = classify.ground_truth(_reads(spark, d), t, t.select("id"), lines)
    both = truth.join(_classified(spark, d).select("query_id", "tax"), "query_id", "left")
    out = evaluate.rank_statistics(evaluate.correct_ranks(both, lines))
    return out.select("rank", "total", "assigned", "known", "correct", "wrong")


@registered(f"""WITH {_TAX} SELECT b.item_id AS query_id, tl.id AS truth FROM benchmark b LEFT JOIN tl ON tl.tgt = b.item_id""")
def ground_truth(spark, d):
    t = _targets(spark, d).select("id", "name")
    return classify.ground_truth(_reads(spark, d), t, t.select("id"), _lineages(spark, d)[1])


@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, v AS (SELECT t.id, t.species, t.genus, coalesce(c.rank, 21) AS a FROM benchmark b JOIN tl t ON t.tgt = b.item_id LEFT JOIN clr c ON c.query_id = b.item_id),
r AS (SELECT 0 AS rank, CASE WHEN a = 0 THEN 1 ELSE 0 END AS hit FROM v UNION ALL SELECT 4, CASE WHEN a <= 4 THEN 1 ELSE 0 END FROM v UNION ALL SELECT 6, CASE WHEN a <= 6 THEN 1 ELSE 0 END FROM v UNION ALL SELECT 20, CASE WHEN a <= 20 THEN 1 ELSE 0 END FROM v)
SELECT CAST(rank AS INTEGER) AS rank, CAST(sum(hit) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS tn, CAST(sum(1 - hit) AS BIGINT) AS fn FROM r GROUP BY rank""")
def coverage_statistics(spark, d):
    _, lines, _ = _lineages(spark, d)
    t = _targets(spark, d).select("id", "name")
    truth = classify.ground_truth(_reads(spark, d), t, t.select("id"), lines)
    both = truth.join(_classified(spark, d).select("query_id", "tax"), "query_id", "left")
    return evaluate.coverage_statistics(both, lines, taxonomy.targets_below(lines.where("id < 0")).select("tax"))


# The same with an index of even documents only: truths outside of it are false positives or true negatives.
@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, cov AS (SELECT * FROM tl WHERE tgt % 2 = 0), v AS (SELECT t.*, coalesce(c.rank, 21) AS a FROM benchmark b JOIN tl t ON t.tgt = b.item_id LEFT JOIN clr c ON c.query_id = b.item_id),
r AS (SELECT 0 AS rank, a <= 0 AS hit, id IN (SELECT id FROM cov) AS inside FROM v UNION ALL SELECT 4, a <= 4, species IN (SELECT species FROM cov) FROM v UNION ALL SELECT 6, a <= 6, genus IN (SELECT genus FROM cov) FROM v UNION ALL SELECT 20, a <= 20, true FROM v),
s AS (SELECT rank, CAST(count(*) FILTER (WHERE hit AND inside) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE hit AND NOT inside) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT hit AND NOT inside) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE NOT hit AND inside) AS BIGINT) AS fn FROM r GROUP BY rank)
SELECT CAST(rank AS INTEGER) AS rank, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy FROM s""")
def coverage_rates(spark, d):
    _, lines, _ = _lineages(spark, d)
    t = _targets(spark, d).select("id", "name")
    truth = classify.ground_truth(_reads(spark, d), t, t.select("id"), lines)
    both = truth.join(_classified(spark, d).select("query_id", "tax"), "query_id", "left")
    covered = taxonomy.targets_below(lines.where("id < 0 and pmod(id, 2) = 1")).select("tax")
    out = evaluate.confusion_rates(evaluate.coverage_statistics(both, lines, covered))
    return out.select("rank", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "precision", "accuracy")])


_RANK_ROWS = ", ".join(f"('{n}', {i})" for i, n in enumerate(ranks.RANKS[:7]))


@registered(f"""WITH {_PIPE}, {_TAX}, {_CLASSIFIED}, rn(rname, r) AS (VALUES {_RANK_ROWS}), sp AS (SELECT DISTINCT species, genus, lang, source FROM tx),
k AS (SELECT query_id, tax, c.rank, CASE WHEN c.rank = 0 THEN t.species WHEN c.rank = 4 THEN tax END AS s, coalesce(t.genus, sp.genus, CASE WHEN c.rank = 6 THEN tax END) AS g FROM clr c LEFT JOIN tl t ON t.id = tax LEFT JOIN sp ON sp.species = tax WHERE tax IS NOT NULL),
x AS (SELECT query_id, r, rname || ':' || CASE WHEN r = 0 THEN 'D_' || lpad(CAST(-tax - 1 AS VARCHAR), 6, '0') || '(' || tax || ')' WHEN r = 4 THEN (SELECT lang || '/' || source FROM sp WHERE species = s) || '(' || s || ')' WHEN r = 6 THEN (SELECT any_value(lang) FROM sp WHERE genus = g) || '(' || g || ')' ELSE '--(0)' END AS t FROM k JOIN rn ON r >= k.rank),
y AS (SELECT query_id, string_agg(t, ',' ORDER BY r) AS taxon FROM x GROUP BY query_id), l AS (SELECT query_id, string_agg('[' || 112 * beg || ',' || (112 * "end" + 127) || ']', ' ' ORDER BY pos) AS l FROM top GROUP BY query_id)
SELECT b.item_id AS query_id, 'D_' || lpad(CAST(b.item_id AS VARCHAR), 6, '0') AS header, coalesce(l, '') AS candidate_locations, coalesce(taxon, '--') AS taxon FROM benchmark b LEFT JOIN y ON y.query_id = b.item_id LEFT JOIN l ON l.query_id = b.item_id""")
def mapping_with_lineages(spark, d):
    taxa, lines, _ = _lineages(spark, d)
    nodes = taxa.select("id", "name", "rank").union(_targets(spark, d).select("id", "name", F.lit(0).alias("rank")))
    spans = report.locations(candidates.top_candidates(_ranges(spark, d), 2), OPTIONS.window, OPTIONS.step)
    return report.mapping(_reads(spark, d), _classified(spark, d), nodes, FormatOptions(lineage=True, taxids=True, highest=ranks.GENUS), spans=spans, lineages=lines)


@registered(f"""WITH {_PIPE}, {_TAX}, win AS (SELECT doc_id AS tgt, length(s) AS windows FROM docs), m AS (SELECT tgt, string_agg(query_id || '/' || beg || '+' || ("end" - beg) || ':' || hits, ',' ORDER BY beg, "end", query_id, hits) AS matches FROM top GROUP BY tgt)
SELECT 'sequence:D_' || lpad(CAST(tgt AS VARCHAR), 6, '0') || ',form:--,variety:--,subspecies:--,species:' || lang || '/' || source AS sequence, windows AS windows_in_sequence, matches FROM m JOIN win USING (tgt) JOIN tl USING (tgt) JOIN tx USING (species, genus)""")
def hits_per_target_with_lineages(spark, d):
    taxa, lines, _ = _lineages(spark, d)
    targets = _targets(spark, d).select("tgt", "id", "name", F.length("seq").cast("bigint").alias("windows"))
    nodes = taxa.select("id", "name", "rank").union(targets.select("id", "name", F.lit(0).alias("rank")))
    text = report.taxon_lines(nodes, lines, FormatOptions(lineage=True, highest=ranks.SPECIES))
    return report.hits_per_target(candidates.hits_per_target(candidates.top_candidates(_ranges(spark, d), 2)), targets, text)


@registered(f"""WITH {', '.join([_DOCS, _ITEMS, _INDEX, _HITS])}, {_TAX}, n AS (SELECT query_id, tgt, win, n, lang || '/' || source AS a FROM hits JOIN tl USING (tgt) JOIN tx USING (species, genus)) SELECT query_id, string_agg(a || ':' || n, ',' ORDER BY tgt, win) AS all_hits FROM n GROUP BY query_id""")
def all_hits_by_species(spark, d):
    taxa, _, lines = _lineages(spark, d)
    return report.all_hits(_hits(spark, d)[1], _targets(spark, d), report.ancestor_names(lines, taxa, ranks.SPECIES))


@registered(f"""WITH {_TAX} SELECT tgt, id, 'D_' || lpad(CAST(tgt AS VARCHAR), 6, '0') AS name, species, genus, 1 AS root FROM tl""")
def target_lineages(spark, d):
    lines = _lineages(spark, d)[2]
    cols = [F.get("lineage", F.lit(r)).alias(ranks.RANKS[r]) for r in (ranks.SPECIES, ranks.GENUS, ranks.ROOT)]
    return _targets(spark, d).select("tgt", "id", "name").join(lines, "tgt").select("tgt", "id", "name", *cols)


@registered("SELECT r.r AS rank, CAST(CASE WHEN r < 4 THEN 4 WHEN r < 6 THEN 6 WHEN r < 10 THEN 10 WHEN r < 12 THEN 12 WHEN r < 14 THEN 14 WHEN r < 16 THEN 16 WHEN r < 18 THEN 18 WHEN r < 19 THEN 19 WHEN r < 20 THEN 20 ELSE 21 END AS INTEGER) AS next_main, CAST(CASE WHEN r = 0 THEN 21 WHEN r <= 4 THEN 0 WHEN r <= 6 THEN 4 WHEN r <= 10 THEN 6 WHEN r <= 12 THEN 10 WHEN r <= 14 THEN 12 WHEN r <= 16 THEN 14 WHEN r <= 18 THEN 16 WHEN r <= 19 THEN 18 WHEN r = 20 THEN 19 ELSE 21 END AS INTEGER) AS prev_main, CAST(CASE WHEN r < 21 THEN least(r + 2, 21) ELSE 20 END AS INTEGER) AS up2, CAST(greatest(r - 2, 0) AS INTEGER) AS down2 FROM (SELECT CAST(unnest(range(22)) AS INTEGER) AS r) r")
def rank_steps(spark, d):
    r = F.col("rank")
    return spark.range(22).select(F.col("id").cast("int").alias("rank")).select("rank", ranks.next_main_rank(r).alias("next_main"), ranks.prev_main_rank(r).alias("prev_main"), ranks.rank_plus(r, 2).alias("up2"), ranks.rank_minus(r, 2).alias("down2"))


# Scalar functions.
_HEAD = "concat('gi|', CAST(doc_id * 7 AS STRING), '| NC_', lpad(CAST(doc_id AS STRING), 6, '0'), CASE WHEN doc_id % 2 = 0 THEN '.1' ELSE '' END, ' taxid|', CAST(n_chars AS STRING), ' ', source, '/', lang, '.x.fa')"


@registered(f"""WITH h AS (SELECT doc_id, {_HEAD.replace('STRING', 'VARCHAR')} AS header FROM documents)
SELECT doc_id, 'NC_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || CASE WHEN doc_id % 2 = 0 THEN '.1' ELSE '' END AS acc, 'NC_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS bare, CASE WHEN doc_id % 2 = 0 THEN 'NC_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.1' ELSE '' END AS versioned, CAST(doc_id * 7 AS VARCHAR) AS gi, 'gi|' || (doc_id * 7) || '|' AS word, regexp_extract(header, '/([a-z]+)[.]x[.]fa$', 1) AS file, CAST(regexp_extract(header, 'taxid[|]([0-9]+)', 1) AS BIGINT) AS taxid FROM h""")
def header_identifiers(spark, d):
    h = _t(spark, d, "documents").selectExpr("doc_id", f"{_HEAD} AS header")
    c = F.col("header")
    return h.select("doc_id", ids.accession(c).alias("acc"), ids.accession_bare(c).alias("bare"), ids.accession_version(c).alias("versioned"), ids.gi(c).alias("gi"), ids.leading_word(c).alias("word"), ids.filename(c).alias("file"), ids.taxon_id(c).alias("taxid"))


@registered("WITH a AS (SELECT DISTINCT o_orderkey AS x FROM orders), b AS (SELECT x, xor(x >> 16, x) * 73244475 & 4294967295 AS y FROM a), c AS (SELECT x, xor(y >> 16, y) * 73244475 & 4294967295 AS y FROM b) SELECT x, xor(y >> 16, y) AS h FROM c")
def feature_hash(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("x")).distinct().select("x", dna.hash32(F.col("x")).alias("h"))


@registered(f"WITH i AS (SELECT item_id, {_DNA} AS s FROM benchmark) SELECT item_id, reverse(translate(s, 'ACGTUacgtu', 'TGCAAtgcaa')) AS rc, CAST(greatest(0, length(s) - 15) AS INTEGER) AS n FROM i")
def reverse_complements(spark, d):
    return _t(spark, d, "benchmark").select("item_id", _dna(F.col("text")).alias("s")).select("item_id", dna.reverse_complement(F.col("s")).alias("rc"), dna.num_kmers(F.col("s"), 16).alias("n"))


@registered(f"""WITH i AS (SELECT item_id, {_DNA} AS s FROM benchmark), k AS (SELECT item_id, i AS \"at\", substr(s, i + 1, 8) AS k FROM (SELECT item_id, s, unnest(range(length(s) - 7)) AS i FROM i) u), b AS (SELECT item_id, \"at\", translate(k, 'ACGT', '0123') AS f, reverse(translate(k, 'ACGT', '3210')) AS r FROM k WHERE NOT contains(k, 'N')),
v AS (SELECT item_id, \"at\", list_reduce([CAST(x AS BIGINT) FOR x IN string_split(f, '')], lambda a, b: a * 4 + b) AS f, list_reduce([CAST(x AS BIGINT) FOR x IN string_split(r, '')], lambda a, b: a * 4 + b) AS r FROM b) SELECT item_id AS owner, \"at\", least(f, r) AS kmer FROM v""")
def canonical_kmers(spark, d):
    rows = sketch.kmers(_t(spark, d, "benchmark").select("item_id", _dna(F.col("text")).alias("s")), "item_id", "s", 8)
    return rows.select("owner", "at", dna.canonical_value(F.col("kmer")).alias("kmer"))


@registered(f"""WITH docs AS (SELECT doc_id, {_DNA} AS s FROM documents), w AS (SELECT doc_id, s, unnest(range(0, CASE WHEN length(s) <= 127 THEN 1 ELSE (length(s) - 127) // 112 + 1 + CASE WHEN ((length(s) - 127) // 112 + 1) * 112 < length(s) THEN 1 ELSE 0 END END)) AS win FROM docs WHERE length(s) > 0)
SELECT doc_id AS owner, win, win * 112 AS begin, md5(substr(s, win * 112 + 1, 127)) AS digest FROM w WHERE length(substr(s, win * 112 + 1, 127)) >= 16""")
def sequence_windows(spark, d):
    return sketch.windows(_targets(spark, d), "tgt", "seq", OPTIONS).select("owner", "win", "begin", F.md5("window").alias("digest"))


@registered(f"""WITH n AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(ranks.RANKS[:21]))}, {', '.join(f"('{a}', {ranks.RANKS.index(r)})" for a, r in ranks.ALIASES.items())}) v(name, rank)), p AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT upper(name) FROM n UNION SELECT name FROM n)
SELECT p.name, CAST(coalesce(n.rank, 21) AS INTEGER) AS rank FROM p LEFT JOIN n ON n.name = lower(p.name)""")
def rank_names(spark, d):
    known = [*ranks.RANKS[:21], *ranks.ALIASES]
    names = spark.createDataFrame([(n,) for n in [*known, *map(str.upper, known)]], "name string").union(_t(spark, d, "part").select("p_brand")).distinct()
    return names.select("name", ranks.rank_from_name(F.col("name")).alias("rank"))


@registered("SELECT doc_id AS query_id, source AS file, length(text) AS n FROM documents WHERE length(text) BETWEEN 500 AND 5000 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def read_filter(spark, d):
    reads = _t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.lit("r").alias("header"), F.col("text").alias("seq1"), F.col("source").alias("file"))
    return filter_reads(reads, 500, 5000, 20).select("query_id", "file", F.length("seq1").cast("bigint").alias("n"))


# The index operators on order lines: parts as features, suppliers as targets.
def _lines(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("tgt"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("win"))


_LINES = "li AS (SELECT l_partkey AS feature, l_suppkey AS tgt, l_orderkey * 8 + l_linenumber AS win FROM lineitem)"


@registered(f"WITH {_LINES} SELECT feature, tgt, win FROM li QUALIFY row_number() OVER (PARTITION BY feature ORDER BY tgt, win) <= 20")
def index_location_limit(spark, d):
    return index.cap_locations(_lines(spark, d), 20)


@registered(f"WITH {_LINES} SELECT feature, tgt, win FROM li QUALIFY count(*) OVER (PARTITION BY feature) <= 25")
def index_without_overpopulated(spark, d):
    return index.remove_overpopulated(_lines(spark, d), 25)


@registered(f"WITH {_LINES}, g AS (SELECT feature FROM li JOIN supplier ON tgt = s_suppkey GROUP BY feature HAVING count(DISTINCT s_nationkey) > 12) SELECT feature, tgt, win FROM li WHERE feature NOT IN (SELECT feature FROM g)")
def index_without_ambiguous(spark, d):
    line = F.array(*[F.lit(None).cast("bigint")] * 4, F.col("s_nationkey").cast("bigint"), *[F.lit(None).cast("bigint")] * 16)
    return index.remove_ambiguous(_lines(spark, d), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("tgt"), line.alias("lineage")), ranks.SPECIES, 12)


@registered(f"WITH {_LINES}, a AS (SELECT * FROM li WHERE win % 3 <> 0), b AS (SELECT * FROM li WHERE win % 3 = 0) SELECT feature, tgt, win FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u QUALIFY row_number() OVER (PARTITION BY feature ORDER BY tgt, win) <= 30")
def index_add(spark, d):
    rows = _lines(spark, d)
    return index.add(rows.where("win % 3 <> 0"), rows.where("win % 3 = 0"), 30)


@registered(f"WITH {_LINES}, p AS (SELECT feature, count(*) AS n FROM li GROUP BY feature), m AS (SELECT count(*) AS k, avg(n) AS mean, stddev_samp(n) AS sd FROM p) SELECT count(*) AS features, CAST(sum(n) AS BIGINT) AS locations, max(n) AS max, round(avg(n), 6) AS mean, round(any_value(sd), 6) AS stddev, round(avg(power(n - mean, 3)) / power(any_value(sd), 3), 6) AS skewness FROM p, m")
def index_bucket_statistics(spark, d):
    return index.bucket_statistics(_lines(spark, d)).select("features", "locations", "max", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "skewness")])


@registered(f"WITH {_LINES} SELECT feature, count(*) AS n FROM li GROUP BY feature")
def index_feature_counts(spark, d):
    return index.feature_counts(_lines(spark, d))


@registered(f"WITH {_LINES} SELECT feature, string_agg(tgt || ':' || win, ',' ORDER BY tgt, win) AS locations FROM li GROUP BY feature")
def index_feature_map(spark, d):
    return index.feature_map(_lines(spark, d))


@registered(f"WITH {_LINES} SELECT (SELECT count(DISTINCT feature) FROM li) AS features, (SELECT count(*) FROM li) AS locations, (SELECT count(*) FROM supplier) AS targets, (SELECT count(*) FROM supplier WHERE s_nationkey <> 0) AS ranked_targets")
def index_content(spark, d):
    return index.content(_lines(spark, d), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("parent")))


@registered("SELECT s_suppkey AS tgt, 'N' || s_nationkey || CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) > 1 THEN '!' || array_to_string(range(1, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)), '!') ELSE '' END AS name FROM supplier")
def unique_target_names(spark, d):
    return index.unique_names(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("tgt"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("name")))


# Ranges on events: users as reads, types as targets, hours as windows.
_EV = "ev AS (SELECT user_id AS query_id, CAST(length(event_type) AS BIGINT) AS tgt, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS win, count(*) AS n FROM events GROUP BY ALL), sp AS (SELECT a.query_id, a.tgt, a.win, CAST(sum(b.n) AS BIGINT) AS hits, min(b.win) AS beg FROM ev a JOIN ev b ON a.query_id = b.query_id AND a.tgt = b.tgt AND b.win <= a.win AND b.win > a.win - (10 + 24 * (a.query_id % 5)) GROUP BY ALL)"


def _event_hits(spark, d):
    ev = _t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.length("event_type").cast("bigint").alias("tgt"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("win"))
    return ev.groupBy("query_id", "tgt", "win").agg(F.count("*").alias("n"))


def _event_reads(hits):
    return hits.select("query_id", (10 + 24 * (F.col("query_id") % 5)).alias("n_win")).distinct()


@registered(f'WITH {_EV} SELECT query_id, tgt, win AS "end", hits, beg FROM sp')
def all_window_ranges(spark, d):
    hits = _event_hits(spark, d)
    return candidates.all_ranges(hits, _event_reads(hits))


@registered(f'WITH {_EV} SELECT query_id, tgt, hits, beg, win AS "end" FROM sp QUALIFY row_number() OVER (PARTITION BY query_id, tgt ORDER BY hits DESC, win) = 1')
def best_event_ranges(spark, d):
    hits = _event_hits(spark, d)
    return candidates.window_ranges(hits, _event_reads(hits))


# The tree: customers (negative ids) under nations (1000 and on) under regions (100 and on) under 1.
def _tree(spark, d):
    c = _t(spark, d, "customer").select((-F.col("c_custkey") - 1).alias("id"), (1000 + F.col("c_nationkey")).cast("bigint").alias("parent"), F.col("c_name").alias("name"), F.lit(0).alias("rank"))
    n = _t(spark, d, "nation").select((1000 + F.col("n_nationkey")).cast("bigint").alias("id"), (100 + F.col("n_regionkey")).cast("bigint").alias("parent"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 7 == 0, ranks.NONE).otherwise(ranks.SPECIES).alias("rank"))
    r = _t(spark, d, "region").select((100 + F.col("r_regionkey")).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("parent"), F.col("r_name").alias("name"), F.lit(ranks.GENUS).alias("rank"))
    root = spark.range(1, 2).select("id", F.lit(1).cast("bigint").alias("parent"), F.lit("root").alias("name"), F.lit(ranks.ROOT).alias("rank"))
    return c.union(n).union(r).union(root)


_TREE = "tree AS (SELECT -c_custkey - 1 AS id, 1000 + c_nationkey AS parent, c_name AS name, 0 AS rank FROM customer UNION ALL SELECT 1000 + n_nationkey, 100 + n_regionkey, n_name, CASE WHEN n_nationkey % 7 = 0 THEN 21 ELSE 4 END FROM nation UNION ALL SELECT 100 + r_regionkey, 1, r_name, 6 FROM region UNION ALL SELECT 1, 1, 'root', 20)"
_PATHS = f"{_TREE}, paths AS (SELECT id, 0 AS depth, id AS ancestor FROM tree UNION ALL SELECT p.id, depth + 1, t.parent FROM paths p JOIN tree t ON p.ancestor = t.id WHERE t.parent <> t.id)"
_LINEAGE = "ln AS (SELECT p.id, max(ancestor) FILTER (WHERE t.rank = 0) AS sequence, max(ancestor) FILTER (WHERE t.rank = 4) AS species, max(ancestor) FILTER (WHERE t.rank = 6) AS genus, max(ancestor) FILTER (WHERE t.rank = 20) AS root FROM paths p JOIN tree t ON t.id = ancestor GROUP BY p.id)"


@registered(f"WITH RECURSIVE {_PATHS} SELECT p.id, CAST(depth AS INTEGER) AS depth, ancestor, CAST(t.rank AS INTEGER) AS rank FROM paths p JOIN tree t ON t.id = ancestor")
def full_lineages(spark, d):
    return taxonomy.full_lineages(_tree(spark, d), 8)


@registered(f"WITH RECURSIVE {_PATHS}, {_LINEAGE} SELECT * FROM ln")
def ranked_lineages(spark, d):
    line = taxonomy.ranked_lineages(_tree(spark, d), 8)
    return line.select("id", *[F.get("lineage", F.lit(r)).alias(ranks.RANKS[r]) for r in (0, 4, 6, 20)])


@registered(f"WITH RECURSIVE {_PATHS}, {_LINEAGE} SELECT x.a, x.b, CASE WHEN m.sequence = n.sequence THEN m.sequence WHEN m.species = n.species THEN m.species WHEN m.genus = n.genus THEN m.genus ELSE 1 END AS lca FROM (SELECT DISTINCT -o_custkey - 1 AS a, -(o_custkey * 7 % (SELECT max(c_custkey) FROM customer) + 1) - 1 AS b FROM orders) x JOIN ln m ON m.id = a JOIN ln n ON n.id = b")
def ranked_lca(spark, d):
    line = taxonomy.ranked_lineages(_tree(spark, d), 8)
    pairs = _customer_pairs(spark, d)
    rows = pairs.join(line.select(F.col("id").alias("a"), F.col("lineage").alias("la")), "a").join(line.select(F.col("id").alias("b"), F.col("lineage").alias("lb")), "b")
    return rows.select("a", "b", taxonomy.ranked_lca(F.col("la"), F.col("lb"), F.lit(0)).alias("lca"))


def _customer_pairs(spark, d):
    last = _t(spark, d, "customer").agg(F.max("c_custkey").alias("m"))
    o = _t(spark, d, "orders").crossJoin(F.broadcast(last))  # one row
    return o.select((-F.col("o_custkey") - 1).alias("a"), (-(F.col("o_custkey") * 7 % F.col("m") + 1) - 1).alias("b")).distinct()


@registered(f"WITH RECURSIVE {_PATHS}, x AS (SELECT DISTINCT -o_custkey - 1 AS a, -(o_custkey * 7 % (SELECT max(c_custkey) FROM customer) + 1) - 1 AS b FROM orders) SELECT a, b, arg_min(p.ancestor, p.depth) AS lca FROM x JOIN paths p ON p.id = a JOIN paths q ON q.id = b AND q.ancestor = p.ancestor GROUP BY a, b")
def full_lca(spark, d):
    return taxonomy.full_lca(_customer_pairs(spark, d), taxonomy.full_lineages(_tree(spark, d), 8))


@registered(f"WITH RECURSIVE {_PATHS} SELECT ancestor AS tax, count(*) AS n FROM paths p JOIN tree t ON t.id = ancestor WHERE p.id < 0 AND t.rank < 21 GROUP BY ancestor")
def targets_below_taxa(spark, d):
    line = taxonomy.ranked_lineages(_tree(spark, d), 8)
    return taxonomy.targets_below(line.where("id < 0"))


@registered(f"WITH RECURSIVE {_PATHS}, {_LINEAGE} SELECT coalesce(species, 0) AS tax, count(*) AS n FROM ln WHERE id < 0 GROUP BY 1")
def targets_at_species(spark, d):
    return taxonomy.targets_at(taxonomy.ranked_lineages(_tree(spark, d), 8).where("id < 0"), ranks.SPECIES)


@registered(f"WITH {_TREE} SELECT id, parent, name, CAST(rank AS INTEGER) AS rank FROM tree WHERE rank <= 4")
def taxa_up_to_species(spark, d):
    return taxonomy.erase_above(_tree(spark, d), ranks.SPECIES)


@registered(f"""WITH {_TREE}, m AS (SELECT 1000 + n_nationkey AS old_id, 1000 + (n_nationkey + 1) AS new_id FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey < 24), n AS (SELECT coalesce(a.new_id, id) AS id, coalesce(b.new_id, parent) AS parent, name, rank, 1 AS o FROM tree LEFT JOIN m a ON a.old_id = id LEFT JOIN m b ON b.old_id = parent),
u AS (SELECT * FROM n UNION ALL SELECT old_id, new_id, '', 21, 0 FROM m) SELECT id, parent, name, CAST(CASE WHEN id = 1 THEN 20 ELSE rank END AS INTEGER) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, parent, rank, name) = 1""")
def merged_taxa(spark, d):
    m = _t(spark, d, "nation").where("n_nationkey % 4 = 0 and n_nationkey < 24").select((1000 + F.col("n_nationkey")).cast("bigint").alias("old_id"), (1001 + F.col("n_nationkey")).cast("bigint").alias("new_id"))
    return taxonomy.resolve_merged(_tree(spark, d), m)


@registered("WITH n AS (SELECT DISTINCT substr(p_name, 1, 6) AS name FROM part) SELECT n.name, min(p_name) AS found FROM n LEFT JOIN part ON starts_with(p_name, n.name) AND length(p_name) > length(n.name) GROUP BY n.name")
def nearest_names(spark, d):
    p = _t(spark, d, "part")
    return taxonomy.nearest_name(p.select(F.expr("substring(p_name, 1, 6)").alias("name")), p.select(F.col("p_name").alias("name")))


@registered("WITH s AS (SELECT s_suppkey AS tgt, s_name || '.1' AS name, 'g' || s_suppkey AS gi, CASE WHEN s_suppkey % 5 = 0 THEN 7 ELSE 0 END AS parent FROM supplier) SELECT s.tgt, s.name, s.gi, CAST(CASE WHEN parent <> 0 THEN parent WHEN tgt % 2 = 0 THEN 1000 + s_nationkey WHEN tgt % 3 = 0 THEN 2000 + s_nationkey WHEN tgt % 7 = 0 THEN 3000 + s_nationkey ELSE 0 END AS BIGINT) AS parent FROM s JOIN supplier ON s_suppkey = tgt")
def assigned_parents(spark, d):
    s = _t(spark, d, "supplier")
    targets = s.select(F.col("s_suppkey").alias("tgt"), F.concat("s_name", F.lit(".1")).alias("name"), F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("gi"), F.when(F.col("s_suppkey") % 5 == 0, 7).otherwise(0).cast("bigint").alias("parent"))
    key = lambda n, c: F.when(F.col("s_suppkey") % n == 0, c)
    rows = lambda n, a, v, g, base: s.select(key(n, a).alias("acc"), key(n, v).alias("acc_ver"), key(n, g).alias("gi"), (base + F.col("s_nationkey")).cast("bigint").alias("taxid"), F.col("s_suppkey").alias("line"))
    none = F.lit(None).cast("string")
    table = rows(2, none, F.concat("s_name", F.lit(".1")), none, 1000).union(rows(3, F.col("s_name"), none, none, 2000)).union(rows(7, none, none, F.concat(F.lit("g"), F.col("s_suppkey").cast("string")), 3000))
    return assign_parents(targets, table)


@registered(f"""WITH RECURSIVE {_PATHS}, {_LINEAGE}, h AS (SELECT o_custkey AS query_id, -o_custkey - 1 AS tax, 5 + o_orderkey % 20 AS hits FROM orders UNION ALL SELECT o_custkey, -(o_custkey * 7 % (SELECT max(c_custkey) FROM customer) + 1) - 1, 5 + o_orderkey % 30 FROM orders),
g AS (SELECT query_id, coalesce(species, genus, root) AS tax, max(hits) AS hits FROM h JOIN ln ON ln.id = h.tax GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tax) AS pos FROM g), w AS (SELECT a.query_id, a.tax, a.hits, b.tax AS t2, b.hits AS h2 FROM r a LEFT JOIN r b ON b.query_id = a.query_id AND b.pos = 2 WHERE a.pos = 1),
v AS (SELECT query_id, hits, CASE WHEN hits < 5 THEN NULL WHEN t2 IS NULL OR h2 <= greatest(hits - 5, 0) THEN w.tax WHEN x.species = y.species THEN x.species WHEN x.genus = y.genus THEN x.genus END AS tax FROM w JOIN ln x ON x.id = w.tax LEFT JOIN ln y ON y.id = t2)
SELECT query_id, v.tax, CAST(coalesce(rank, 21) AS INTEGER) AS rank, hits FROM v LEFT JOIN tree t ON t.id = v.tax""")
def merged_results(spark, d):
    from .api import merge_results

    o = _t(spark, d, "orders")
    last = _t(spark, d, "customer").agg(F.max("c_custkey").alias("m"))
    second = o.crossJoin(F.broadcast(last)).select(F.col("o_custkey").alias("query_id"), (-(F.col("o_custkey") * 7 % F.col("m") + 1) - 1).alias("tax"), (5 + F.col("o_orderkey") % 30).alias("hits"))  # one row
    first = o.select(F.col("o_custkey").alias("query_id"), (-F.col("o_custkey") - 1).alias("tax"), (5 + F.col("o_orderkey") % 20).alias("hits"))
    return merge_results(first.union(second), _tree(spark, d))
