"""Quality rules: base rules, then multivariate outliers by minimum-covariance-determinant estimates. DataFrame and SQL only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, let, run_hashes, words

#: Transformed statistics, in thousandths, and the noise of each, which an estimate's spread has at least: a text of 50 words
#: has a mean word length as uncertain as that, a stray symbol or two, a repeated phrase, a repeated line among three.
STATS = {"x1": 40, "x2": 30, "x3": 120, "x4": 130}
P = len(STATS)
SHARE, MIN_ROWS = 0.75, 50
#: Starts besides that by medians, the rows each is taken from, and concentration steps at most.
SEEDS, SEED_ROWS, STEPS = 4, 10, 12
#: Tails of the chi-square distribution: outside of the first a row has no weight in the final estimate, outside of the second it's an outlier.
WEIGHT_TAIL, TAIL = 0.025, 0.001


def _chi2_tail(x: float, p: int) -> float:
    """P(chi-square with p degrees, an even number, exceeds x)."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def _chi2_above(tail: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_tail(mid, p) > tail else (low, mid)
    return high


def _consistent(share: float) -> float:
    """The nearest `share` of normal data has too small a covariance by this factor."""
    return share / (1 - _chi2_tail(_chi2_above(1 - share, P), P + 2))


WEIGHT, CUTOFF = _chi2_above(WEIGHT_TAIL, P), _chi2_above(TAIL, P)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found at least twice, of an array of word hashes."""

    def of(t: Column) -> Column:
        ordered = F.sort_array(t)
        twice = let(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))

        def places(d: Column) -> Column:
            few = F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
            # With many repeated windows, a search for each would be quadratic: sort windows with their places instead.
            pairs = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            many = let(
                pairs,
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(s, lambda y, i: ((i > 0) & (y["x"] == F.get(s, i - 1)["x"])) | (y["x"] == F.get(s, i + 1)["x"])), lambda y: y["i"]
                    )
                ),
            )
            return F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= 16, few).otherwise(many)

        fold = F.aggregate(
            let(twice, places), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
        )
        return fold["n"]

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(run_hashes(w, 3), of))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the transformed x1 to x4.

    x1: 1000 ln of the mean word length; x2: 1000 root of symbols a character; x3: 1000 root of repeated words a word; x4:
    1000 root of repeated lines a line that has words, and two more, so that one of few is not much; rounded to whole numbers.
    A null text is empty; with no words, all are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, " \t\x0b\f\r", "")) > 0)
    each = let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup")))
    of_words = let(F.transform(words(text), lambda x: F.xxhash64(x)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep")))
    out = docs.withColumns({"_w": of_words, "_l": each})
    out = out.withColumns({
        "n_words": F.col("_w.n").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.col("_l.dup").cast("long"),
        "n_repeat_words": F.col("_w.rep").cast("long"),
        "_lines": F.col("_l.n"),
    })
    ratio = lambda a, b: F.sqrt(F.col(a).cast("double") / F.greatest(F.lit(1), b))
    whole = lambda c: F.round(c * 1000).cast("double")
    return out.withColumns({
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        "x1": whole(F.log(F.greatest(F.lit(1), F.col("word_chars")).cast("double") / F.greatest(F.lit(1), "n_words"))),
        "x2": whole(ratio("n_symbols", F.col("word_chars"))),
        "x3": whole(ratio("n_repeat_words", F.col("n_words"))),
        "x4": whole(ratio("n_dup_lines", F.col("_lines") + 2)),
    }).drop("_w", "_l", "_lines")


def _chol(c) -> dict[str, str]:
    """Columns of the Cholesky factor of covariances c(i, j), each from those before it."""
    out = {}
    for j in range(1, P + 1):
        for i in range(j, P + 1):
            less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out[f"l{i}{j}"] = f"sqrt({c(j, j)}{less})" if i == j else f"({c(i, j)}{less}) / l{j}{j}"
    return out


def _nested(rel: str, columns: dict[str, str]) -> str:
    """A select in which each column can use those before it."""
    for name, text in columns.items():
        rel = f"(SELECT *, {text} AS {name} FROM {rel}) t_{name}"
    return rel


def _key(c: str) -> str:
    return f"concat(CAST(coalesce(length({c}), -1) AS STRING), ':', coalesce({c}, ''))"


X = list(STATS)
_I = range(1, P + 1)
_LOWER = [(i, j) for i in _I for j in range(1, i + 1)]
#: The SQL of each step, the same for Spark and other engines. f: statistics; s: each group's estimates.
GROUPS = f"""
SELECT lang, source, CASE WHEN n >= {MIN_ROWS} THEN concat('a', {_key('lang')}, {_key('source')}) WHEN sum(CASE WHEN n < {MIN_ROWS} THEN n ELSE 0 END) OVER (PARTITION BY lang) >= {MIN_ROWS} THEN concat('b', {_key('lang')}) ELSE 'c' END AS g
FROM (SELECT lang, source, count(*) AS n FROM {{f}} WHERE NOT base_failed GROUP BY lang, source) t"""
ROWS = f"SELECT gr.g, fe.o, {', '.join(f'fe.{x}' for x in X)} FROM {{f}} fe JOIN {{s}} gr ON fe.lang IS NOT DISTINCT FROM gr.lang AND fe.source IS NOT DISTINCT FROM gr.source WHERE NOT fe.base_failed"
MEDIANS = f"SELECT g, count(*) AS n, {', '.join(f'median({x}) AS m{i}' for i, x in enumerate(X, 1))} FROM {{f}} GROUP BY g HAVING count(*) >= {MIN_ROWS}"
_SUMS = ", ".join([*(f"sum({x}) AS s{i}" for i, x in enumerate(X, 1)), *(f"sum({X[i - 1]} * {X[j - 1]}) AS q{i}{j}" for i, j in _LOWER)])
_EST = ", ".join(["n", *(f"m{i}" for i in _I), *(f"l{i}{j}" for i, j in _LOWER)])
_WITH = ", ".join(f"s.{c}" for c in _EST.split(", "))
#: The first start: medians, and absolute deviations from them, as a diagonal estimate.
START = f"""
SELECT g, 0 AS st, n, {', '.join(f'm{i}' for i in _I)}, {', '.join(f'greatest(1.4826e0 * d{i}, {STATS[X[i - 1]]}e0) AS l{i}{j}' if i == j else f'0e0 AS l{i}{j}' for i, j in _LOWER)}, 0e0 AS k, 0e0 AS logdet
FROM (SELECT s.g, s.n, {', '.join(f's.m{i}' for i in _I)}, {', '.join(f'median(abs(f.{x} - s.m{i})) AS d{i}' for i, x in enumerate(X, 1))} FROM {{f}} f JOIN {{s}} s ON f.g = s.g GROUP BY s.g, s.n, {', '.join(f's.m{i}' for i in _I)}) t"""
#: The others: few rows of each group, by a hash, so that some have no outliers.
SEEDED = f"""
SELECT t.g, CAST(1 + floor((rn - 1) / {SEED_ROWS}) AS INT) AS st, max(s.n) AS n, count(*) AS k, {_SUMS} FROM (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY g ORDER BY o, {', '.join(X)}) AS rn FROM {{f}} f) r WHERE rn <= {SEEDS * SEED_ROWS}) t JOIN {{s}} s ON t.g = s.g
GROUP BY t.g, CAST(1 + floor((rn - 1) / {SEED_ROWS}) AS INT)"""
_Y = {f"y{i}": f"({x} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(1, i))}) / l{i}{i}" for i, x in enumerate(X, 1)}
_D2 = {"d2": " + ".join(f"y{i} * y{i}" for i in _I)}
DISTANCES = f"SELECT g, st, n, d2, {', '.join(X)} FROM {_nested(f'(SELECT f.*, s.st, {_WITH} FROM {{f}} f JOIN {{s}} s ON f.g = s.g) j', _Y | _D2)}"
#: Sums by distance, in steps of 3 %: a few hundred rows for each estimate.
BINNED = f"SELECT g, st, n, b, count(*) AS c, {_SUMS} FROM (SELECT *, floor(32e0 * ln(d2 + 0.01e0)) AS b FROM {{f}}) d GROUP BY g, st, n, b"
#: Of the rows nearest to each estimate, SHARE of its group: their sums. Equal distances are taken together.
NEAREST = f"""
SELECT g, st, max(n) AS n, sum(c) AS k, {', '.join(f'sum({c}) AS {c}' for c in [*(f's{i}' for i in _I), *(f'q{i}{j}' for i, j in _LOWER)])}
FROM (SELECT *, sum(c) OVER (PARTITION BY g, st ORDER BY b) - c AS before FROM {{f}}) d WHERE before < {SHARE}e0 * n GROUP BY g, st"""
_M = {f"m{i}": f"s{i} / k" for i in _I}


def _estimate(factor: float) -> str:
    """Means and the Cholesky factor of covariances from sums: covariances times factor, and the statistics' noise."""
    cov = {f"c{i}{j}": f"{factor!r}e0 * (q{i}{j} / k - m{i} * m{j})" + (f" + {STATS[X[i - 1]] ** 2}e0" if i == j else "") for i, j in _LOWER}
    det = {"logdet": " + ".join(f"ln(l{i}{i})" for i in _I)}
    return f"SELECT g, st, {_EST}, CAST(k AS DOUBLE) AS k, logdet FROM {_nested('{f} mo', _M | cov | _chol(lambda i, j: f'c{max(i, j)}{min(i, j)}') | det)}"


STEP = _estimate(1.0)
#: The estimate of least determinant of each group, made consistent; of equal ones, the first.
BEST = f"SELECT b.* FROM ({_estimate(_consistent(SHARE))}) b JOIN (SELECT g, st FROM (SELECT g, st, row_number() OVER (PARTITION BY g ORDER BY round(logdet, 9), st) AS o FROM {{s}}) r WHERE o = 1) w ON b.g = w.g AND b.st = w.st"
#: Sums of the rows that have weight, for the final estimate.
WEIGHTED = f"SELECT g, st, max(n) AS n, count(*) AS k, {_SUMS} FROM {{f}} WHERE d2 <= {WEIGHT!r}e0 GROUP BY g, st"
FINAL = _estimate(_consistent(1 - WEIGHT_TAIL))


def _scored(f: str) -> str:
    return _nested(f"(SELECT fe.*, {_WITH} FROM {f} fe LEFT JOIN {{g}} gr ON fe.lang IS NOT DISTINCT FROM gr.lang AND fe.source IS NOT DISTINCT FROM gr.source LEFT JOIN {{s}} s ON gr.g = s.g) j", _Y | _D2)


def kept_sql(columns: str, f: str = "{f}") -> str:
    return f"SELECT {columns}, NOT base_failed AND coalesce(d2 <= {CUTOFF!r}e0, true) AS kept FROM {_scored(f)}"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs.

    Base rules reject texts of under 50 words or with over half of the words in repeated 3-word windows. For the others,
    each language and source gets a minimum-covariance-determinant estimate of its statistics: from SEEDS + 1 starts, by
    medians and by few rows each, concentration steps take the SHARE of rows nearest to an estimate, and their mean and
    covariance as the next one, until nothing changes (STEPS at most); the estimate of least determinant wins. Rows in its
    WEIGHT_TAIL then give the final mean and covariance. A row is rejected if its squared Mahalanobis distance is beyond the
    chi-square value with tail TAIL. Covariances always have the statistics' noise added, as most texts have no symbols and
    no repeated lines at all. Groups of under MIN_ROWS rows are pooled by language, then together; without enough rows even so,
    base rules alone decide. Every estimate is a sum over all rows, pre-aggregated by distance, so a hot group stays split.

    Null texts are empty and fail; null languages and sources are groups of their own. Repeated rows count as often as
    they occur, each kept as its own row. Extra columns are ignored. Ties at a threshold are taken together.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    out = judged(own, Store(docs.sparkSession)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.withColumnRenamed("doc_id", id_col)


def quality_documents(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever these are called. They are stored once with their statistics, so that no text is shuffled."""
    own = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judged(own, store or Store(docs.sparkSession)).where("kept").select("_row.*")


def judged(own: DataFrame, store: Store) -> DataFrame:
    """The statistics of rows (doc_id, text, lang, source) and `kept`; the text isn't carried."""
    spark = own.sparkSession
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    stats = store.put(statistics(own).drop("text").withColumn("o", order), "statistics")
    groups = store.put(spark.sql(GROUPS, f=stats), "groups", small=True)
    rows = spark.sql(ROWS, f=stats, s=groups)
    medians = store.put(spark.sql(MEDIANS, f=rows), "medians", small=True)
    seeds = spark.sql(STEP, f=spark.sql(SEEDED, f=rows, s=medians))
    estimate = store.put(spark.sql(START, f=rows, s=medians).unionByName(seeds), "estimate", small=True)
    sums, before = None, None
    for _ in range(STEPS):
        binned = spark.sql(BINNED, f=spark.sql(DISTANCES, f=rows, s=estimate))
        sums = store.put(spark.sql(NEAREST, f=binned), "sums", small=True)
        estimate = spark.sql(STEP, f=sums)
        sign = sums.agg(*[F.sum(c) for c in sums.columns if c not in ("g", "st")]).first()
        if sign == before:
            break
        before = sign
    best = store.put(spark.sql(BEST, f=sums, s=estimate), "best", small=True)
    final = spark.sql(FINAL, f=spark.sql(WEIGHTED, f=spark.sql(DISTANCES, f=rows, s=best)))
    return spark.sql(kept_sql("*"), f=stats, g=groups, s=store.put(final, "final", small=True))


def oracle_sql() -> str:
    """DuckDB SQL for the result of quality() on the table documents."""
    duck = lambda s: s.replace("AS STRING", "AS VARCHAR")
    base = r"""
t0 AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t1 AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t0),
t2 AS (SELECT *, row_number() OVER () AS r, len(w) AS n FROM t1),
tri AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT r, w, unnest(range(1, n - 1)) AS i FROM t2 WHERE n >= 3) u),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) v WHERE c > 1) u GROUP BY r),
t3 AS (SELECT doc_id, lang, source, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM t2 LEFT JOIN rep USING (r)),
stats AS MATERIALIZED (SELECT * EXCLUDE (n_lines), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  round(1000 * ln(greatest(1, word_chars)::DOUBLE / greatest(1, n_words))) AS x1, round(1000 * sqrt(n_symbols::DOUBLE / greatest(1, word_chars))) AS x2,
  round(1000 * sqrt(n_repeat_words::DOUBLE / greatest(1, n_words))) AS x3, round(1000 * sqrt(n_dup_lines::DOUBLE / (n_lines + 2))) AS x4, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM t3)"""
    steps = [base, f"groups AS MATERIALIZED ({duck(GROUPS).format(f='stats')})", f"frows AS MATERIALIZED ({ROWS.format(f='stats', s='groups')})"]
    steps += [f"medians AS MATERIALIZED ({MEDIANS.format(f='frows')})", f"seeds AS ({SEEDED.format(f='frows', s='medians')})"]
    steps += [f"e0 AS MATERIALIZED ({START.format(f='frows', s='medians')} UNION ALL BY NAME {STEP.format(f='seeds')})"]
    for i in range(STEPS):
        steps += [f"d{i} AS ({DISTANCES.format(f='frows', s=f'e{i}')})", f"b{i} AS ({BINNED.format(f=f'd{i}')})", f"s{i} AS MATERIALIZED ({NEAREST.format(f=f'b{i}')})", f"e{i + 1} AS MATERIALIZED ({STEP.format(f=f's{i}')})"]
    steps += [f"best AS MATERIALIZED ({BEST.format(f=f's{STEPS - 1}', s=f'e{STEPS}')})", f"db AS ({DISTANCES.format(f='frows', s='best')})", f"w AS ({WEIGHTED.format(f='db')})", f"fin AS MATERIALIZED ({FINAL.format(f='w')})"]
    last = kept_sql("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed").format(f="stats", g="groups", s="fin")
    return f"WITH {', '.join(steps)} {last}"
