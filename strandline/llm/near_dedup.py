"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists of retained values, exact Jaccard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, lower_ascii, shingles, words
from .components import components

#: The chance that a bound on common values fails for a pair of just the similarity asked for.
LOSS = 1e-6
#: Pairs that meet one salted copy of a hub's row.
SALTED = 512
#: Comparisons of the exact search, for each document in lists, above which a further hub round comes first.
WORK = 2_000
#: Shingles of a block of the exact search, where a document counts as SHORT at least: so a block has 2,000 documents at most, but for chance.
BLOCK, SHORT = 1_000_000, 500


def least_common(k: int, percent: int, loss: float = LOSS) -> int:
    """The most values t for which this holds: of the k least of a union of which `percent` % is common, under t are common with a chance of `loss` at most.

    The binomial tail, summed exactly; values are drawn without replacement, which only makes the true tail lighter.
    """
    p, below, t = percent / 100, 0.0, 0
    while t <= k and (below := below + math.comb(k, t) * p**t * (1 - p) ** (k - t)) <= loss:
        t += 1
    return t


def _set(text, n_words: int):
    return shingles(words(lower_ascii(text)), n_words)


def _shared(n, lists_of: int, percent: int):
    """How many of their `lists_of` least values a document of n shingles and any partner have in common, at the least.

    Up to lists_of shingles the values are the whole set, and the bound is certain: partners have at most n / similarity
    shingles, of which those past lists_of are unseen. Above, it is the binomial one.
    """
    unseen = (100 - percent) * (100 * lists_of // percent) // 100
    short = F.least(F.lit(lists_of - unseen), F.ceil(n * percent / 100))
    return F.when(n <= lists_of, short).otherwise(F.lit(least_common(lists_of, percent))).cast("int")


def candidates(classes: DataFrame, lists_of: int, percent: int) -> DataFrame:
    """(h, rep, t, n, sketch, keep): classes that share values with others, and the values under which they are listed.

    Two documents that are alike have t of their least values in common. So each can leave out the t - 1 values that most
    documents have, in one order for all: the rarest common value stays in both. Values that nobody shares fall out first,
    and the values of a passage that many unlike documents have are left out by all that have enough others.
    """
    values = classes.select("h", F.explode(F.slice("sketch", 1, lists_of)).alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1").select(F.col("v").alias("_v"), "f")
    held = values.join(often, F.col("v") == F.col("_v")).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("x"))  # lists_of values at most
    rows = classes.join(held.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"))
    left = F.size("x") - _shared(F.col("n"), lists_of, percent) + 1
    return rows.where(left > 0).select("h", "rep", "t", "n", "sketch", F.transform(F.slice("x", 1, left), lambda e: e["v"]).alias("keep"))


def _like(a: str, b: str, percent: int):
    """Whether sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _salted(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, s), a a hub: s salts for its row, so that no task meets all pairs of a hub."""
    return pairs.groupBy("a", "b").agg(F.max("s").alias("s"))


def _hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member with the least document of its list: few a member, as lists of like documents have the same least."""
    hubs = lists.groupBy("v").agg(F.min(F.struct("rep", "h", "n")).alias("x"), F.count("*").alias("m")).where("m > 1")
    hubs = hubs.select(F.col("v").alias("_v"), F.col("x.h").alias("a"), F.col("x.n").alias("na"), F.ceil(F.col("m") / SALTED).alias("s"))
    rows = lists.join(hubs, F.col("v") == F.col("_v")).where((F.col("h") != F.col("a")) & _like("n", "na", percent))
    return _salted(rows.select("a", F.col("h").alias("b"), "s"))


def _rest_hub_pairs(labels: DataFrame, stats: DataFrame, turn: int, percent: int) -> DataFrame:
    """In each list of several components: pairs across components of each member with one outside the largest component."""
    rows = labels.join(stats, F.col("v") == F.col("_v")).drop("_v")
    hubs = rows.where("comp <> big").groupBy("v").agg(F.min(F.struct(F.xxhash64("h", "v", F.lit(turn)).alias("_o"), "h", "n", "comp")).alias("hub"))
    hubs = hubs.select(F.col("v").alias("_v"), F.col("hub.h").alias("a"), F.col("hub.n").alias("na"), F.col("hub.comp").alias("ca"))
    pairs = rows.join(hubs, F.col("v") == F.col("_v")).where((F.col("comp") != F.col("ca")) & _like("n", "na", percent))
    return _salted(pairs.select("a", F.col("h").alias("b"), F.ceil(F.col("m") / SALTED).alias("s")))


def _list_stats(labels: DataFrame) -> DataFrame:
    """(_v, m, rest, big) of lists with members of several components besides their hub: members, those outside the largest, and the largest."""
    per = labels.where("h <> hub").groupBy("v", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("v").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("big"))
    return per.where("m > big.c").select(F.col("v").alias("_v"), "m", (F.col("m") - F.col("big.c")).alias("rest"), F.col("big.comp").alias("big"))


def _met(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """pairs (a, b, s) with the row x of each end from side (h, x): b's moves to its hub's salted copies."""
    own = side.select(F.col("h").alias("_h"), F.col("x").alias("xb"))
    rows = pairs.join(own, F.col("b") == F.col("_h")).select("a", "b", "s", "xb", F.expr("pmod(xxhash64(b), s)").alias("salt"))
    hubs = pairs.select("a", "s").distinct().join(side, F.col("a") == F.col("h"))
    hubs = hubs.select(F.col("a").alias("_a"), F.col("s").alias("_s"), F.col("x").alias("xa"), F.explode(F.expr("sequence(0L, s - 1)")).alias("_t"))
    return rows.join(hubs, (F.col("a") == F.col("_a")) & (F.col("s") == F.col("_s")) & (F.col("salt") == F.col("_t"))).select("a", "b", "s", "xa", "xb")


def _estimated(pairs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that the sketch of their union doesn't rule out; `whole`: decided, as sketches are whole sets."""
    rows = _met(pairs, found.select("h", F.struct("n", "sketch").alias("x")))
    sa, sb, na, nb = F.col("xa.sketch"), F.col("xb.sketch"), F.col("xa.n"), F.col("xb.n")
    both = F.array_intersect(sa, sb)
    rows = rows.select("a", "b", "s", na.alias("na"), nb.alias("nb"), both.alias("both"), F.slice(F.sort_array(F.array_union(sa, sb)), 1, k).alias("union"))
    small, common = F.greatest("na", "nb") <= k, F.size("both")
    exact = 100 * common >= percent * (F.col("na") + F.col("nb") - common)
    likely = F.size(F.array_intersect("both", "union")) >= least_common(k, percent)
    return rows.where(F.when(small, exact).otherwise(likely)).select("a", "b", "s", small.alias("whole"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links whose full shingle sets are as similar as asked; in whole numbers, so that none at the bound is lost to rounding."""
    rows = _met(pairs.where("not whole"), sets.select("h", F.col("s").alias("x")))
    common, of = F.size(F.array_intersect("xa", "xb")), F.size("xa") + F.size("xb")
    return rows.where(100 * common >= percent * (of - common)).select("a", "b").union(pairs.where("whole").select("a", "b"))


def _common(left: list, right: list) -> np.ndarray:
    """The number of common values of each set of left with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)) for x in (left, right)]
    both = np.intersect1d(*(np.unique(v) for _, v in sides))
    if not len(both):
        return out
    where, count = [], []
    for rows, values in sides:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        where.append((rows[hit], at[hit]))
        count.append(np.bincount(at[hit], minlength=len(both)))
    # Values of many pairs: products of 0/1 tables. Others: pair by pair.
    many = count[0] * count[1] * 100 >= out.size
    dense = np.flatnonzero(many)
    place = np.cumsum(many) - 1
    for start in range(0, len(dense), 4096):
        tables = []
        for (rows, at), n in zip(where, out.shape, strict=True):
            use = many[at] & (place[at] >= start) & (place[at] < start + 4096)
            table = np.zeros((n, min(4096, len(dense) - start)), np.float32)
            table[rows[use], place[at[use]] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    (rows, at), (rows_r, at_r) = ((r[~many[x]], x[~many[x]]) for r, x in where)
    order = np.argsort(at_r, kind="stable")
    rows_r = rows_r[order]
    first, size = np.searchsorted(at_r[order], at), count[1][at]
    ends = np.cumsum(size)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 4_000_000, "right")))
        n = size[begin:end]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = np.repeat(rows[begin:end], n) * len(right) + rows_r[np.repeat(first[begin:end], n) + step]
        out += np.bincount(code, minlength=out.size).reshape(out.shape)
        begin = end
    return out


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links (left, right) as join the same rows."""
    sides, free = (links, np.ascontiguousarray(links.T)), (np.ones(links.shape[0], bool), np.ones(links.shape[1], bool))
    out = []
    for start in np.flatnonzero(links.any(axis=1)):
        if not free[0][start]:
            continue
        free[0][start] = False
        todo = [(0, start)]
        while todo:
            side, i = todo.pop()
            new = np.flatnonzero(sides[side][i] & free[1 - side])
            free[1 - side][new] = False
            out += [(int(i), int(j)) if side == 0 else (int(j), int(i)) for j in new]
            todo += [(1 - side, j) for j in new]
    return out


def _block_links(p: int):
    """For the rows of two blocks, or of one: links of documents of unlike components whose sets have p % in common, as far as they join anything."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if rows.lb.iloc[0] == rows.rb.iloc[0]:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        common = _common(list(left.s), list(right.s)).astype(np.int64)
        sizes = left.s.map(len).to_numpy()[:, None] + right.s.map(len).to_numpy()[None, :]
        links = (100 * common >= p * (sizes - common)) & (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :])
        ids, other = left.id.to_numpy(), right.id.to_numpy()
        pairs = [(min(ids[i], other[j]), max(ids[i], other[j])) for i, j in _forest(links)]
        return pd.DataFrame({"a": pd.Series([a for a, _ in pairs], dtype="int64"), "b": pd.Series([b for _, b in pairs], dtype="int64")})

    return found


def _exact_links(labels: DataFrame, stats: DataFrame, sets: DataFrame, store: Store, percent: int) -> DataFrame:
    """Links across components of all pairs of members of each list, besides its hub, by full shingle sets in blocks.

    Lists of the same hub are mostly the same documents and are searched as one group. A group's documents outside its
    largest component are dealt to blocks by hash, the others to blocks of their own; each block of the first sort meets
    itself, those after it and all of the second sort. Only the sets are copied, once for each block they meet; pairs are no
    rows. A hub has been held against all its list before.
    """
    wide = labels.where("h <> hub").join(stats.select("_v"), F.col("v") == F.col("_v"), "left_semi")
    groups = store.put(wide.select(F.col("hub").alias("g"), "h", "comp", F.greatest("n", F.lit(SHORT)).alias("w")).distinct(), "groups")
    per = groups.groupBy("g", "comp").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
    per = per.groupBy(F.col("g").alias("_g")).agg(F.sum("w").alias("w_all"), F.max(F.struct("c", "comp", "w")).alias("big"))
    blocks = lambda w: F.ceil(w / BLOCK).cast("long")
    per = per.select("_g", F.col("big.comp").alias("big"), blocks(F.col("w_all") - F.col("big.w")).alias("nl"), blocks(F.col("big.w")).alias("nb")).where("nl > 0")
    rows = groups.join(per, F.col("g") == F.col("_g")).withColumn("rest", F.col("comp") != F.col("big"))
    rows = rows.withColumn("k", F.when(F.col("rest"), F.expr("pmod(xxhash64(h), nl)")).otherwise(F.expr("nl + pmod(xxhash64(h), nb)")))
    left = rows.where("rest").select("g", "h", "comp", F.lit(0).alias("side"), F.col("k").alias("lb"), F.explode(F.expr("sequence(k, nl + nb - 1)")).alias("rb"))
    right = rows.where("k > 0").select("g", "h", "comp", F.lit(1).alias("side"), F.explode(F.expr("sequence(0L, least(k, nl) - 1)")).alias("lb"), F.col("k").alias("rb"))
    met = left.union(right).join(sets.select(F.col("h").alias("_h"), "s"), F.col("h") == F.col("_h")).select("g", F.col("h").alias("id"), "comp", "side", "lb", "rb", "s")
    found = met.groupBy("g", "lb", "rb").applyInPandas(_block_links(percent), "a bigint, b bigint")
    return store.put(found, "exact-links")


def near_duplicates(docs: DataFrame, n_words: int = 5, similarity: float = 0.8, k: int = 64, lists_of: int = 32, max_hub_rounds: int = 4, work: int = WORK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Method. A document's set holds the hashes of its n-word shingles; its sketch the k least. Documents of equal sets
    become one class. Each class is listed under some of its `lists_of` least values: all but the t - 1 that most classes
    have, where t of them are common to any two classes as similar as asked (see candidates()). Each list's members are held
    against one hub: first by size, then by the sketch of the union, then on full sets. The links that hold give components.
    Lists that still have members of several components are searched whole, on full sets, in salted blocks; where that would
    take over `work` comparisons for each listed class, hub rounds come first, `max_hub_rounds` at most, each with a hub from
    outside the largest component. These settings say in what order pairs are compared; none leaves a pair of a list out.

    What can be lost is a pair whose common values fall short of a bound: for a pair of just the similarity, a chance of
    LOSS in the lists, where either has over lists_of shingles, and of LOSS in the union's sketch, over k. Shorter ones lose nothing.

    Null or blank texts have no shingles and stand alone. Rows of one doc_id are one document listed more than once: those
    with words share a component; rows of a null doc_id each stand alone, with a null component, and are kept. Extra columns
    are ignored. Sets are equal if their 64-bit hashes are.
    """
    store, percent = Store(docs.sparkSession), round(similarity * 100)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = base.select("id", F.xxhash64("text").alias("t"), _set(F.col("text"), n_words).alias("s"))
    rows = store.put(whole.select("id", "t", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("h"), F.slice("s", 1, k).alias("sketch")), "sketches")
    real = rows.where("n > 0 and id is not null")
    classes = real.groupBy("h").agg(F.min(F.struct("id", "t")).alias("x"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = store.put(classes.select("h", F.col("x.id").alias("rep"), F.col("x.t").alias("t"), "n", "sketch"), "classes")
    found = store.put(candidates(classes, lists_of, percent), "candidates")
    lists = found.select("h", "rep", "n", F.explode("keep").alias("v"))
    # The one time that texts are moved: those of listed classes come out of it as sets.
    own = found.select(F.col("rep").alias("_r"), F.col("t").alias("_t"), "h")
    sets = base.join(own.hint("merge"), (F.col("id") == F.col("_r")) & (F.xxhash64("text") == F.col("_t")))
    sets = store.put(sets.select("h", _set(F.col("text"), n_words).alias("s")), "sets")
    hubs = lists.groupBy("v").agg(F.min(F.struct("rep", "h")).alias("x"), F.count("*").alias("_m")).where("_m > 1").select(F.col("v").alias("_v"), F.col("x.h").alias("hub"))
    lists = lists.join(hubs, F.col("v") == F.col("_v")).drop("_v")

    def confirm(pairs, name):
        pairs = store.put(pairs, f"{name}-pairs")
        near = store.put(_estimated(pairs, found, k, percent), name)
        links = store.put(_verified(near, sets, percent), f"{name}-links")
        store.drop(pairs, near)
        return links

    links = confirm(_hub_pairs(lists, percent), "hubs")
    for turn in range(max_hub_rounds + 1):
        comps = components(links, store)
        labels = store.put(lists.join(comps, F.col("h") == F.col("node"), "left").select("v", "h", "n", "hub", F.coalesce("component", "h").alias("comp")), "labels")
        stats = store.put(_list_stats(labels), "stats")
        load = stats.agg(F.sum(F.col("rest").cast("double") * F.col("m")) / lists_of).first()[0] or 0.0
        if turn == max_hub_rounds or load == 0 or load <= work * found.count():
            break
        links = links.union(confirm(_rest_hub_pairs(labels, stats, turn, percent), f"rest{turn}"))
        store.drop(labels, stats)
    if load:
        links = links.union(_exact_links(labels, stats, sets, store, percent))
    # Different texts of one id are joined, too.
    ids = rows.where("n > 0 and id is not null").groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("_b")).where("a <> _b").select(F.col("id").alias("_i"), "a")
    again = real.join(ids, F.col("id") == F.col("_i")).where("h <> a").select("a", F.col("h").alias("b"))
    final = components(links.union(again), store)
    names = final.join(classes.select("h", "rep"), F.col("node") == F.col("h"))
    least = names.groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("least"))
    names = names.join(least, F.col("component") == F.col("_c")).select(F.col("node").alias("_h"), "least")
    named = classes.select("h", "rep").join(names, F.col("h") == F.col("_h"), "left").select(F.col("h").alias("_h"), F.coalesce("least", "rep").alias("least"))
    out = rows.select("id", "n", "h").join(named, F.col("h") == F.col("_h"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def dedup_documents(docs: DataFrame, n_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component: that of the least id. Of rows that repeat an id one stays, the one of the greatest text."""
    packed = docs.select(F.col("doc_id").alias("_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = near_duplicates(docs, n_words, similarity).where("kept and doc_id is not null").select(F.col("doc_id").alias("_k")).distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    out = packed.join(kept, F.col("_id") == F.col("_k"), "left_semi")
    if not repeated.isEmpty():
        order = Window.partitionBy("_id").orderBy(F.desc_nulls_last("text"), F.xxhash64("_row"))
        out = out.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return out.select("_row.*").union(packed.where("_id is null").select("_row.*"))
