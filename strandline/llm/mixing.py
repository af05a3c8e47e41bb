"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Store, split_running_sum

WEIGHTS, SHARE_PERCENT, MAX_PASSES = (5, 2, 1), 150, 2
#: Golden-ratio step in units of 2**-32: the k-th point is k * STEP mod 2**32.
STEP, UNIT = 2654435769, 4294967296
#: Buckets of the shuffled order of a source: what one task of a window holds of a hot source is this part of it.
BUCKETS = 1024
CELLS = 4096


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, s_key, source_size, weight, target, low, high): one row a source, targets by water-filling.

    Sources by code point, null last, weigh 5, 2, 1, repeating. A target is its weight's share, at most twice its source's
    size. A source is at its limit if its limit over its weight is under the level at which the others share the rest;
    in the order of that ratio, the level is found by one running sum. low and high bound its part of the schedule.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order)
    # A window without keys sees one row a source, already summed.
    w = per.withColumn("s_key", n).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("s_key") - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumns({"_cap": MAX_PASSES * F.col("source_size"), "_ratio": (MAX_PASSES * F.col("source_size")).cast("double") / F.col("weight")})
    by_ratio = Window.orderBy("_ratio", "s_key")
    upto, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * SHARE_PERCENT / 100
    w = w.withColumn("_level", (total.cast("double") - F.coalesce(F.sum("_cap").over(upto), F.lit(0)).cast("double")) / F.sum("weight").over(rest))
    w = w.withColumn("_open", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    w = w.withColumn("_at", F.first("_open", ignorenulls=True).over(every))
    w = w.withColumn("target", F.when(F.col("_ratio") < F.coalesce("_at", F.lit(0.0)), F.col("_cap").cast("double")).otherwise(F.coalesce("_at", F.lit(0.0)) * F.col("weight")))
    w = w.withColumn("target", F.least("target", F.col("_cap").cast("double")))
    whole = F.floor(F.col("target") + 0.5)
    by_key = Window.orderBy("s_key")
    w = w.withColumns({"_t": whole})
    w = w.withColumns({"_to": F.sum("_t").over(by_key.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_t").over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    bound = lambda c: F.floor(F.when(F.col("_all") > 0, c.cast("double") / F.col("_all")).otherwise(0.0) * UNIT)
    return w.select("source", "s_key", "source_size", "weight", "target", "_all", bound(F.col("_to") - F.col("_t")).alias("low"), bound(F.col("_to")).alias("high"))


def block_size(total: int) -> int:
    """Tokens of a block: a millionth of the mix, from 16 to 4096; so slots grow with the data once blocks are large."""
    return max(16, min(4096, -(-total // (1 << 20))))


def schedule(spark, targets: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, s_key, turn): each slot's source by its golden-ratio point, and its rank, from 0, among that source's slots."""
    slots = spark.range(0, -(-total // block)).select(F.col("id").alias("slot"), ((F.col("id") % 2147483648) * STEP % UNIT).alias("point"))
    # Sources by cells of the unit interval that their part touches: an equi-join instead of a range join.
    cell = UNIT // CELLS
    parts = targets.where("high > low").select("s_key", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    at = slots.withColumn("cell", F.floor(F.col("point") / cell)).join(parts, "cell").where("point >= low and point < high")
    at = at.select("slot", "s_key", F.lit(1).alias("one"), F.shiftright("slot", 12).alias("run"))
    return split_running_sum(at, ["s_key"], "run", ["slot"], "one", "turn").select("slot", "s_key", "turn")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None, store: Store | None = None):
    """The mix of docs: a table of documents (doc_id, source, h, size, start, source_size, target) and one of pieces.

    A source's documents, shuffled by a hash of id and text, are laid end to end, and laid again for the second pass; that
    line is cut into blocks of equal tokens. The schedule's k-th slot of a source takes its k-th block. pieces (slot, source,
    h, start, pass, n): the words that a slot takes of a document; slot orders the mix.
    """
    spark = docs.sparkSession
    store = store or Store(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = store.put(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.expr(f"regexp_count({text_col}, '[^{SPACE[1:-2]}]+')".replace("\\", "\\\\")).alias("_n"), F.conv(F.substring(F.md5(F.concat_ws("/", F.col(id_col).cast("string"), text)), 1, 15), 16, 10).cast("long").alias("h"))
                      .select("doc_id", "source", F.coalesce("_n", F.lit(0)).cast("long").alias("size"), "h"), "sizes")
    targets = store.put(source_targets(sized), "targets", small=True)
    total = int(targets.agg(F.max("_all")).first()[0] or 0)
    block = block or block_size(total)
    rows = sized.withColumn("bucket", F.shiftright("h", 50) % BUCKETS)
    placed = split_running_sum(rows, ["source"], "bucket", ["h", "doc_id"], "size", "start").drop("bucket")
    info = targets.select(F.col("source").alias("_s"), "s_key", "source_size", "target")
    placed = placed.join(info, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    laid = placed.where("size > 0").select("s_key", "start", "size", "source_size", F.explode(F.array(*map(F.lit, range(MAX_PASSES)))).alias("pass")).withColumn("begin", begin)
    cut = laid.withColumn("turn", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    pieces = cut.join(schedule(spark, targets, total, block), ["s_key", "turn"])
    n = F.least(F.col("begin") + F.col("size"), (F.col("turn") + 1) * block) - F.greatest("begin", F.col("turn") * block)
    return placed, pieces.select("slot", "s_key", "start", "pass", n.alias("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None, store: Store | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs: `taken` words of it are in the mix.

    Null texts have size 0; documents of size 0 are never taken; null sources are one source, the last. Repeated rows are
    laid side by side, each with its own share, which depends on nothing but their values. Sources of size 0 have target 0.
    Extra columns are ignored. An empty table gives an empty result.
    """
    placed, pieces = mixed(docs, id_col, text_col, source_col, block, store)
    got = pieces.groupBy(F.col("s_key").alias("_k"), F.col("start").alias("_a")).agg(F.sum("n").alias("got"))
    out = placed.join(got, (F.col("s_key") == F.col("_k")) & (F.col("start") == F.col("_a")) & (F.col("size") > 0), "left")
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), F.col("source").alias(source_col), "h")


def mix_documents(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """docs with each row once, twice or not at all: as often as the mix takes it whole, halves rounded up. Columns stay as they are."""
    h = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("long")
    keyed = docs.select("doc_id", "source", h.alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    times = F.floor((2 * F.col("taken") + F.col("size")) / F.greatest(F.lit(1), 2 * F.col("size")))
    # Rows with the same id, text and source are alike: what each takes is evened out, so that the join keeps their number.
    per = mix(docs, store=store).groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_g"), F.col("source").alias("_s")).agg(F.avg("taken").alias("taken"), F.max("size").alias("size"))
    per = per.where("size > 0").select("_i", "_g", "_s", times.cast("int").alias("_n")).where("_n > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")) & F.col("source").eqNullSafe(F.col("_s"))
    return keyed.join(per, same).select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")


def oracle_sql() -> str:
    """DuckDB SQL for mix() on the table documents, with the block size worked out in the query."""
    return rf"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws('/', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS s_key FROM per),
w2 AS (SELECT *, [5, 2, 1][(s_key - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM w),
w3 AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w2),
w4 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100 - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, s_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / CAST(sum(weight) OVER (ORDER BY ratio, s_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w3),
lvl AS (SELECT coalesce(arg_min(level, (ratio, s_key)) FILTER (WHERE level <= ratio), 0) AS lev FROM w4),
w5 AS (SELECT source, s_key, source_size, least(CAST(cap AS DOUBLE), CASE WHEN ratio < lev THEN CAST(cap AS DOUBLE) ELSE lev * weight END) AS target FROM w4, lvl),
w6 AS (SELECT *, floor(target + 0.5) AS t FROM w5),
w7 AS (SELECT *, sum(t) OVER (ORDER BY s_key) AS upto, sum(t) OVER () AS total FROM w6),
targets AS MATERIALIZED (SELECT *, greatest(16, least(4096, CAST(ceil(total / 1048576) AS BIGINT))) AS block, floor(CASE WHEN total > 0 THEN (upto - t) / total ELSE 0 END * {UNIT}) AS low, floor(CASE WHEN total > 0 THEN upto / total ELSE 0 END * {UNIT}) AS high FROM w7),
slots AS (SELECT slot, (slot % 2147483648) * {STEP} % {UNIT} AS point FROM (SELECT unnest(range(0, (SELECT CAST(ceil(max(total) / max(block)) AS BIGINT) FROM targets))) AS slot) r),
sched AS (SELECT s_key, row_number() OVER (PARTITION BY s_key ORDER BY slot) - 1 AS turn FROM slots JOIN targets ON point >= low AND point < high),
used AS (SELECT s_key, count(*) * any_value(block) AS reach FROM sched JOIN targets USING (s_key) GROUP BY s_key),
placed AS (SELECT d.*, t.s_key, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, coalesce(reach, 0) - start)) + greatest(0, least(size, coalesce(reach, 0) - source_size - start)) AS BIGINT) AS taken FROM placed LEFT JOIN used USING (s_key)"""
