"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, Store, let, lower_ascii, run_hashes, words

#: Rows of a small side that are sent to every executor, of numbers only: some 50 MB as a hash table. More are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: What separates words before lower-casing.
NOT_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return words(lower_ascii(text), NOT_WORD)


def _tokens(rows: DataFrame, keep: list[str], words_col: Column, lengths: list[int]) -> DataFrame:
    """keep, with (pos, token) of all runs of each length in an array of words, pos from 0; token is a hash. Nothing else is carried."""
    none = F.array().cast("array<bigint>")
    hashes = lambda n: let(F.transform(words_col, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= n, run_hashes(h, n)).otherwise(none))
    if len(lengths) == 1:
        return rows.select(*keep, F.posexplode(hashes(lengths[0])).alias("pos", "token"))
    place = lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("token"))
    return rows.select(*keep, F.explode(F.concat(*[F.transform(hashes(n), place) for n in lengths])).alias("x")).select(*keep, "x.pos", "x.token")


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(wid, win, m, item_ids): each distinct window of m words and the items that have it."""
    w = items.select(F.col(id_col).cast("string").alias("item"), _words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("p"))
    wins = starts.select("item", F.slice("w", F.col("p"), window).alias("win")).groupBy("win").agg(F.collect_set("item").alias("item_ids"))
    return wins.select(F.xxhash64("win").alias("wid"), "win", F.size("win").alias("m"), "item_ids")


def _rarest(own: DataFrame, wins: DataFrame, store: Store, token_words: int, limit: int):
    """The windows' prefixes (wid, token, offset, m), their number, and the lengths of their tokens.

    Rarity is a token's number of occurrences in the documents, counted for tokens of the benchmark only. A window one of
    whose tokens occurs nowhere can't occur and gets no prefix.
    """
    lengths = sorted(r[0] for r in wins.select(F.least("m", F.lit(token_words))).distinct().collect())  # token_words numbers at most
    each = wins.select("wid", "m", F.least("m", F.lit(token_words)).alias("token_n"), "win")
    if not lengths:
        return None, 0, []
    rows = _tokens(each.where(F.col("token_n") == lengths[0]), ["wid", "m"], F.col("win"), lengths[:1])
    for n in lengths[1:]:
        rows = rows.union(_tokens(each.where(F.col("token_n") == n), ["wid", "m"], F.col("win"), [n]))
    tokens = store.put(rows.select("wid", "m", "token", F.col("pos").alias("offset")), "tokens")
    distinct = tokens.select(F.col("token").alias("_t")).distinct()
    seen = _tokens(own, [], _words(F.col("text")), lengths).select("token")
    if distinct.count() <= limit:
        counts = seen.join(F.broadcast(distinct), F.col("token") == F.col("_t")).groupBy("_t").agg(F.count("*").alias("rarity"))
    else:
        counts = seen.groupBy("token").agg(F.count("*").alias("rarity")).join(distinct, F.col("token") == F.col("_t")).select("_t", "rarity")
    ranked = tokens.join(counts, F.col("token") == F.col("_t"), "left")
    first = ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "token", "offset", "m")).alias("x"))
    prefix = store.put(first.where("x.rarity > 0").select("wid", "x.token", "x.offset", "x.m"), "prefixes")
    return prefix, prefix.count(), lengths


def _verdicts(own: DataFrame, items: DataFrame, window: int, token_words: int, item_col: str, item_text: str, limit: int) -> tuple[DataFrame | None, int]:
    """(_i, _h, hits) of each id and text hash of own (id, text, text_hash) in which windows occur; hits: (p, m, item_ids). And their number."""
    store = Store(own.sparkSession)
    wins = store.put(item_windows(items, window, item_col, item_text), "windows")
    prefix, n_prefixes, lengths = _rarest(own, wins, store, token_words, limit)
    if not n_prefixes:
        return None, 0
    small = lambda df, n: F.broadcast(df) if n <= limit else df
    at = _tokens(own, ["id", "text_hash"], _words(F.col("text")), lengths)
    probe = small(prefix.select(F.col("token").alias("_t"), "offset", "wid"), n_prefixes)
    # Positional bound: the token's place fixes where the window starts.
    start = F.col("pos") - F.col("offset")
    found = at.join(probe, F.col("token") == F.col("_t")).where(start >= 0)
    found = store.put(found.select("id", "text_hash", start.alias("p"), "wid").distinct(), "candidates")
    full = found.join(wins.withColumnRenamed("wid", "_w"), F.col("wid") == F.col("_w"))
    per = full.groupBy(F.col("id").alias("_i"), F.col("text_hash").alias("_h")).agg(F.collect_list(F.struct("p", "m", "win", "item_ids")).alias("maybe"))
    per = store.put(per, "candidate-documents")
    # Texts of candidates only: by their keys first, which are small enough to send; then with their windows.
    same = F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h"))
    some = own.join(small(per.select("_i", "_h"), per.count()), same, "left_semi").join(per, same)
    # Length bound: all of the window is in the document. Then its words.
    inside = lambda w: F.filter("maybe", lambda x: (x["p"] + x["m"] <= F.size(w)) & (F.slice(w, x["p"] + 1, x["m"]) == x["win"]))
    some = some.select("_i", "_h", let(_words(F.col("text")), inside).alias("hits")).where(F.size("hits") > 0)
    hits = F.transform("hits", lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), x["item_ids"].alias("item_ids")))
    some = store.put(some.select("_i", "_h", hits.alias("hits")).dropDuplicates(["_i", "_h"]), "verdicts")
    return some, some.count()


def _n_hit(hits: Column) -> Column:
    """Words hit: each span, less what an earlier one has covered."""
    spans = F.sort_array(F.transform(hits, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"))))
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["p"] + s["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["p"] + s["m"] - F.greatest(a["end"], s["p"]))).alias("n")),
    )["n"].cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, token_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, text_hash) for every row of docs.

    An item window is `window` consecutive words of an item (all of a shorter one). Method: the set of a window holds its
    shingles of `token_words` words, ordered by rarity. Containment must be whole, so the necessary prefix is the rarest
    shingle: a document holds the window only where it holds that shingle. A first scan counts the benchmark's shingles in
    the documents; a second joins the documents' shingles with the prefixes alone. A shingle's place in the window fixes where
    the window would start (positional bound), which must be inside the document, with room for all its words (length
    bound). In documents with candidates the words themselves are then compared, over a stretch of the window's size.

    Only numbers are carried from shingle to shingle, never a document's words. Sides of up to broadcast_rows rows are
    broadcast; larger ones are joined by a shuffle, with the same result.

    Null and blank texts have no words; items without words have no windows. Rows of one doc_id and text get the same
    result, each its own row; null doc_ids are kept. Extra columns are ignored. An empty benchmark leaves all clean.
    """
    hash_of = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), hash_of)
    verdicts, _ = _verdicts(own, items, window, token_words, item_col, item_text, broadcast_rows)
    out = own.select("id", "text_hash", F.size(words(F.col("text"), NOT_WORD_CASED)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if verdicts is None:
        out = out.withColumns({"n_hit": F.lit(0).cast("long"), "item_ids": none})
    else:
        ids = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["item_ids"]))))
        found = verdicts.select("_i", "_h", _n_hit(F.col("hits")).alias("_n"), ids.alias("_ids"))
        out = out.join(found, F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left")
        out = out.withColumns({"n_hit": F.coalesce("_n", F.lit(0)).cast("long"), "item_ids": F.coalesce("_ids", none)})
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "text_hash")


def decontaminate_documents(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, in which no item window occurs."""
    own = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    verdicts, n = _verdicts(own, items, window, 5, "item_id", "text", broadcast_rows)
    if verdicts is None:
        return docs
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    gone = verdicts.select("_i", "_h")
    return rows.join(F.broadcast(gone) if n <= broadcast_rows else gone, F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left_anti").select("_row.*")
