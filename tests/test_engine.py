"""The engine's operators against straight-line models, and its files, index and queries end to end."""

import gzip
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dna, ids, ranks
from strandline.operators import abundance, align, candidates, classify, evaluate, index, sketch, taxonomy
from strandline.options import BuildOptions, ClassifyOptions, FormatOptions, MergeOptions, QueryOptions, SketchOptions
from strandline.plans import api, report
from strandline.sources import results, sequences, taxonomy_files
from strandline.sources.database import Index

M32 = 0xFFFFFFFF


def hash32(x):
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B & M32
    return (x >> 16) ^ x


def fmix64(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & m
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & m
    return x ^ (x >> 33)


CODE = {c: i for i, cs in enumerate(("Aa", "Cc", "Gg", "TtUu")) for c in cs}


def model_sketch(seq, k, size, window, stride):
    out = set()
    starts = [0] if len(seq) <= window else [s for s in range(0, len(seq), stride)]
    if len(seq) > window:
        full = [s for s in starts if s + window <= len(seq)]
        starts = full + ([full[-1] + stride] if full[-1] + stride < len(seq) else [])
    win = 0
    for s in starts if seq else []:
        part = seq[s : s + window]
        if len(part) < k:
            continue
        found = set()
        for i in range(len(part) - k + 1):
            codes = [CODE.get(c) for c in part[i : i + k]]
            if None in codes:
                continue
            f = sum(c << 2 * (k - 1 - j) for j, c in enumerate(codes))
            r = sum((3 - c) << 2 * j for j, c in enumerate(codes))
            found.add((hash32 if k <= 16 else fmix64)(min(f, r)))
        found.discard(M32 if k <= 16 else (1 << 64) - 1)
        out |= {(win, f) for f in sorted(found)[:size]}
        win += 1
    return out


@pytest.mark.parametrize(("k", "size", "window", "stride"), [(16, 16, 127, 112), (4, 3, 10, 7), (5, 4, 12, 20), (7, 2, 9, 1), (21, 8, 60, 40), (31, 4, 50, 20), (1, 2, 3, 2)])
def test_sketches(k, size, window, stride):
    rng = random.Random(k)
    lengths = [0, 1, k - 1, k, window - 1, window, window + 1, window + stride, *[rng.randrange(400) for _ in range(25)]]
    for n in lengths:
        seq = "".join(rng.choices("ACGTUacgtuN", [9] * 10 + [1], k=max(0, n)))
        win, f = dna.sketches(seq.encode(), k, size, window, stride)
        assert set(zip(win.tolist(), f.tolist(), strict=True)) == model_sketch(seq, k, size, window, stride)
        assert len(win) == len(set(zip(win.tolist(), f.tolist(), strict=True)))


def test_sketches_of_many_texts_are_those_of_each():
    rng = random.Random(31)
    texts = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.choice([0, 3, 15, 16, 17, 126, 127, 128, 239, 240, 900]))).encode() for _ in range(200)]
    for k, size, window, stride in ((16, 16, 127, 112), (20, 5, 60, 80), (16, 4, 50, 7)):
        at, wins, features = dna.sketches_of(texts, k, size, window, stride)
        got = defaultdict(list)
        for i, w, f in zip(at.tolist(), wins.tolist(), features.tolist(), strict=True):
            got[i].append((w, f))
        for i, t in enumerate(texts):
            assert got[i] == list(zip(*(x.tolist() for x in dna.sketches(t, k, size, window, stride)), strict=True))
    assert [len(x) for x in dna.sketches_of([], 16, 16, 127, 112)] == [0, 0, 0]


def test_other_hashes():
    """Each against its definition in whole numbers."""
    x = np.array([0, 1, 12345, 2**31, 2**32 - 1], np.uint64)

    def jenkins(v):
        for plus, c, op, s, right in ((1, 0x7ED55D16, "+", 12, 0), (0, 0xC761C23C, "^", 19, 1), (1, 0x165667B1, "+", 5, 0), (1, 0xD3A2646C, "^", 9, 0), (1, 0xFD7046C5, "+", 3, 0), (0, 0xB55A4F09, "^", 16, 1)):
            a, b = (v + c if plus else v ^ c), (v >> s if right else v << s)
            v = (a + b if op == "+" else a ^ b) % 2**32
        return v

    def halved(v):
        v = (~v + (v << 18)) % 2**64
        v = (v ^ v >> 31) * 21 % 2**64
        v ^= v >> 11
        v = (v + (v << 6)) % 2**64
        return (v ^ v >> 22) % 2**32

    assert dna.HASHES["nvidia32"](x).tolist() == [jenkins(int(v)) for v in x]
    assert dna.HASHES["halved64"](x).tolist() == [halved(int(v)) for v in x]


def test_sketch_of_ambiguous_only():
    assert len(dna.sketches(b"N" * 300, 16, 16, 127, 112)[0]) == 0
    win, _ = dna.sketches(b"N" * 112 + b"ACGT" * 40, 16, 16, 127, 112)
    assert win.min() == 1  # an empty window keeps its number


def test_reverse_complement_has_same_sketch():
    seq = "ACGGTTACGATCGATTACGGGCATCATTACGACTA"
    a, b = (set(dna.sketches(s.encode(), 16, 16, 127, 112)[1].tolist()) for s in (seq, align.revcomp(seq)))
    assert a == b


def test_sketch_dataframe(spark):
    rng = random.Random(0)
    rows = [(i, "".join(rng.choices("ACGT", k=rng.randrange(500)))) for i in range(20)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "id bigint, seq string")
    got = {(r[0], r[1], r[2]) for r in sketch.sketch(df, "id", "seq", SketchOptions()).collect()}
    assert got == {(i, w, f) for i, s in rows for w, f in model_sketch(s or "", 16, 16, 127, 112)}
    wide = sketch.sketch(df, "id", "seq", SketchOptions(k=20)).collect()
    assert {(r[0], r[1], r[2] % (1 << 64)) for r in wide} == {(i, w, f) for i, s in rows for w, f in model_sketch(s or "", 20, 16, 127, 108)}


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1, "NZ_ABCD01000001.1 taxid|562| x", "ACGUNacgtx"), (2, "gi|123|ref|NC_000913| y", ""), (3, "path/to/file.a.fa", None), (4, "", "A"), (5, "xNC_123456 gi:77 taxid:", "T")], "i int, h string, s string")
    c = F.col("h")
    r = {x["i"]: x for x in df.select("i", dna.reverse_complement(F.col("s")).alias("rc"), ids.accession(c).alias("a"), ids.accession_bare(c).alias("b"), ids.accession_version(c).alias("v"), ids.gi(c).alias("g"), ids.taxon_id(c).alias("t"), ids.sequence_id(c).alias("smart"), ids.leading_word(c).alias("w")).collect()}
    assert (r[1]["rc"], r[1]["a"], r[1]["b"], r[1]["v"], r[1]["t"]) == ("xacgtNACGT", "NZ_ABCD01000001.1", "NZ_ABCD01000001", "NZ_ABCD01000001.1", 562)
    assert (r[2]["a"], r[2]["v"], r[2]["g"]) == ("NC_000913", "", "123")
    assert (r[3]["smart"], r[3]["rc"]) == ("file", None)
    assert (r[4]["smart"], r[4]["t"], r[4]["w"]) == ("", 0, "")
    assert (r[5]["a"], r[5]["g"], r[5]["t"]) == ("", "77", 0)


def test_ranks(spark):
    assert [ranks.next_main(0), ranks.next_main(4), ranks.next_main(19), ranks.next_main(20)] == [4, 6, 20, 21]
    assert [ranks.prev_main(0), ranks.prev_main(4), ranks.prev_main(7), ranks.prev_main(20), ranks.prev_main(21)] == [21, 0, 6, 19, 21]
    df = spark.createDataFrame([("Superkingdom",), ("strange",), (None,), ("species group",)], "n string")
    assert [r[0] for r in df.select(ranks.rank_from_name(F.col("n"))).collect()] == [19, 21, 21, 5]


def test_index_filters(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(30), rng.randrange(20), rng.randrange(10)) for _ in range(600)})
    df = spark.createDataFrame(rows, "feature bigint, tgt bigint, win bigint")
    per = defaultdict(list)
    for f, t, w in rows:
        per[f].append((t, w))
    same = lambda d, want: sorted(map(tuple, d.collect())) == sorted((f, *x) for f, xs in want.items() for x in xs)
    for n in (1, 5, 18, 254):
        assert same(index.cap_locations(df, n), {f: sorted(x)[:n] for f, x in per.items()})
        assert same(index.remove_overpopulated(df, n), {f: x for f, x in per.items() if len(x) <= n})
        assert same(index.remove_ambiguous(df, None, 0, n), {f: x for f, x in per.items() if len({t for t, _ in x}) <= n})
    assert index.query_limit(None, 254) == 253 and index.query_limit(10, 254) == 9
    stats = index.bucket_statistics(df).first()
    sizes = np.array([len(x) for x in per.values()])
    m = sizes.mean()
    assert stats["max"] == sizes.max() and abs(stats["skewness"] - ((sizes - m) ** 3).mean() / sizes.std(ddof=1) ** 3) < 1e-9


def model_range(hits, nw):
    """Two pointers over sorted windows: the first greatest range."""
    best, left, total = None, 0, 0
    for right, (w, n) in enumerate(hits):
        total += n
        while w - hits[left][0] >= nw:
            total -= hits[left][1]
            left += 1
        if best is None or total > best[0]:
            best = (total, hits[left][0], w)
    return best


def test_window_ranges_and_top(spark):
    rng = random.Random(2)
    rows, reads = [], []
    for q in range(40):
        reads.append((q, rng.randrange(1, 6)))
        for t in range(rng.randrange(0, 6)):
            rows += [(q, t, w, rng.randrange(1, 4)) for w in rng.sample(range(25), rng.randrange(1, 15))]
    hits = spark.createDataFrame(rows, "query_id bigint, tgt bigint, win bigint, n bigint")
    got = candidates.window_ranges(hits, spark.createDataFrame(reads, "query_id bigint, n_win bigint"))
    want = {}
    for q, nw in reads:
        for t in {r[1] for r in rows if r[0] == q}:
            want[q, t] = model_range(sorted((w, n) for a, b, w, n in rows if (a, b) == (q, t)), nw)
    assert {(r["query_id"], r["tgt"]): (r["hits"], r["beg"], r["end"]) for r in got.collect()} == want
    top = defaultdict(list)
    for r in candidates.top_candidates(got, 2).orderBy("query_id", "pos").collect():
        top[r["query_id"]].append((r["hits"], r["tgt"]))
    assert dict(top) == {q: [(h, t) for h, t in sorted(((want[k][0], k[1]) for k in want if k[0] == q), key=lambda x: (-x[0], x[1]))[:2]] for q in {k[0] for k in want}}


TAXA = [(1, 1, "root", 20), (2, 1, "dom", 19), (10, 2, "g1", 6), (11, 2, "g2", 6), (20, 10, "s1", 4), (21, 10, "s2", 4), (22, 11, "s3", 4), (30, 20, "norank", 21), (40, 99, "lost", 4)]


@pytest.fixture
def taxa(spark):
    return spark.createDataFrame(TAXA, "id bigint, parent bigint, name string, rank int")


def model_lineage(nodes, i):
    by, out = {n[0]: n for n in nodes}, [None] * 21
    while i in by:
        if by[i][3] < 21:
            out[by[i][3]] = i
        if by[i][1] == i:
            break
        i = by[i][1]
    return out


def test_lineages_and_lca(spark, taxa):
    lines = taxonomy.ranked_lineages(taxa, 16)
    got = {r["id"]: r["lineage"] for r in lines.collect()}
    assert got == {n[0]: model_lineage(TAXA, n[0]) for n in TAXA}
    pairs = lines.select(F.col("id").alias("a"), F.col("lineage").alias("x")).crossJoin(lines.select(F.col("id").alias("b"), F.col("lineage").alias("y")))
    for r in pairs.select("a", "b", taxonomy.ranked_lca(F.col("x"), F.col("y"), F.lit(4)).alias("l")).collect():
        assert r["l"] == next((p for p, q in zip(got[r["a"]][4:], got[r["b"]][4:], strict=True) if p and p == q), None)


def test_full_lineage_doubling(spark):
    chain = spark.createDataFrame([(i, max(1, i - 1), 21) for i in range(1, 40)], "id bigint, parent bigint, rank int")
    got = {(r["id"], r["depth"], r["ancestor"]) for r in taxonomy.full_lineages(chain).collect()}
    assert got == {(i, d, i - d) for i in range(1, 40) for d in range(i)}


def test_deep_lineages_and_cycles(spark):
    chain = spark.createDataFrame([(i, max(1, i - 1), {1: 20, 150: 4}.get(i, 21)) for i in range(1, 151)], "id bigint, parent bigint, rank int")
    line = next(r["lineage"] for r in taxonomy.ranked_lineages(chain).collect() if r["id"] == 150)
    assert line[20] == 1 and line[4] == 150
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.full_lineages(spark.createDataFrame([(i, i % 9 + 1, 21) for i in range(1, 10)], "id bigint, parent bigint, rank int"))


@pytest.mark.parametrize(("given", "want"), [(0, 0), (0.5, 0.5), (1, 1), (50, 0.5), (100, 1), (-1, 0)])
def test_fractions_over_one_are_percent(given, want):
    c = ClassifyOptions(cov_percentile=given, hits_diff=given).normalised(16)
    assert (c.cov_percentile, c.hits_diff) == (want, want)


def test_lineage_text(spark, taxa):
    """Ranks from the taxon's or the lowest on; missing ones are blank, and unclassified reads are one sign or blanks for all columns."""
    lines = taxonomy.ranked_lineages(taxa)
    text = lambda **o: {r["id"]: r["text"] for r in report.taxon_lines(taxa, lines, FormatOptions(**o)).collect()}
    assert text(lineage=True, lowest=4, highest=6)[20] == "species:s1,subgenus:--,genus:g1"
    assert text(lineage=True, taxids=True, omit_ranks=True, lowest=5, highest=6)[20] == "--(0),g1(10)"
    assert text(taxids_only=True, lowest=6)[20] == "genus:10" and text(highest=6).get(2) is None
    assert text(separate_cols=True, taxids=True, separator="|")[20] == "species|s1|20"
    assert report.no_taxon(FormatOptions()) == "--" and report.no_taxon(FormatOptions(taxids_only=True, omit_ranks=True)) == "0"
    assert report.no_taxon(FormatOptions(separate_cols=True, separator="|", lineage=True, taxids=True, lowest=5, highest=6)) == "--|--|0|--|--|0"


def test_abundance_table_has_unclassified(spark, taxa):
    reads = spark.range(1, 11).withColumnRenamed("id", "query_id")
    classified = spark.createDataFrame([(1, 20), (2, 20), (3, 10), (4, None)], "query_id bigint, tax bigint")
    table = abundance.abundance_table(abundance.taxon_counts(classified), taxa, abundance.totals(reads, classified))
    assert sorted((r["name"], r["taxid"], r["n"], r["pct"]) for r in table.collect()) == [("g1", 10, 1.0, 10.0), ("s1", 20, 2.0, 20.0), ("unclassified", 0, 7.0, 70.0)]


def test_names_stay_apart(spark):
    """A third equal name, added later, gets both numbers."""
    rows = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "x")], "tgt bigint, given string")
    assert [r["name"] for r in index.unique_names(rows, "given").orderBy("tgt").collect()] == ["x", "x!1", "y", "x!1!2"]


def test_alignment_of_sequences_only(spark):
    c = spark.createDataFrame([(1, 1, -1, 0, 0, 0), (2, 1, 7, 0, 0, 0), (3, 1, -1, 0, 0, 0)], "query_id bigint, pos int, tax bigint, tgt bigint, beg bigint, end bigint")
    reads = spark.createDataFrame([(i, "ACGTACGT", None) for i in (1, 2, 3)], "query_id bigint, seq1 string, seq2 string")
    found = spark.createDataFrame([(1, -1), (2, 7), (3, None)], "query_id bigint, tax bigint")
    out = align.alignments(c, reads, spark.createDataFrame([(0, "ACGTACGTTT")], "tgt bigint, seq string"), 10, 5, found).collect()
    assert [r["query_id"] for r in out] == [1]


def test_merged_ids(spark, taxa):
    merged = spark.createDataFrame([(20, 22), (77, 10)], "old_id bigint, new_id bigint")
    got = {r["id"]: (r["parent"], r["rank"]) for r in taxonomy.resolve_merged(taxa, merged).collect()}
    assert got[20] == (22, 21) and got[77] == (10, 21) and got[30][0] == 22 and got[1] == (1, 20)


def model_classify(cands, lineage, o):
    if not cands or cands[0][0] < o.hits_min:
        return None
    top = lineage[cands[0][1]]
    rank = next(r for r in range(21) if top[r] is not None)
    threshold = np.float32(np.float32(cands[0][0] - o.hits_min) * np.float32(o.hits_diff)) if cands[0][0] > o.hits_min else 0
    for hits, t in cands[1:]:
        if not np.float32(hits) > threshold:
            break
        rank = next((r for r in range(rank, 21) if top[r] is not None and top[r] == lineage[t][r]), None)
        if rank is None or rank > o.highest:
            return None
    return top[rank] if rank <= o.highest else None


@pytest.mark.parametrize(("diff", "highest", "least"), [(1.0, 19, 2), (0.5, 19, 1), (0.0, 20, 3), (0.8, 6, 1)])
def test_classify(spark, taxa, diff, highest, least):
    rng = random.Random(int(diff * 10))
    parents = [20, 21, 22, 20, 30, 40]
    nodes = TAXA + [(-t - 1, p, f"t{t}", 0) for t, p in enumerate(parents)]
    lineage = {t: model_lineage(nodes, -t - 1) for t in range(len(parents))}
    o = ClassifyOptions(hits_min=least, hits_diff=diff, highest=highest)
    rows, want = [], {}
    for q in range(150):
        c = sorted(((rng.randrange(1, 12), t) for t in rng.sample(range(len(parents)), rng.randrange(1, 5))), key=lambda x: (-x[0], x[1]))
        rows += [(q, n, t, h) for n, (h, t) in enumerate(c, 1)]
        want[q] = model_classify(c, lineage, o)
    lines = spark.createDataFrame([(t, x) for t, x in lineage.items()], "tgt bigint, lineage array<bigint>")
    got = classify.classify(spark.createDataFrame(rows, "query_id bigint, pos int, tgt bigint, hits bigint"), lines, o)
    assert {r["query_id"]: r["tax"] for r in got.collect()} == want


def model_estimate(counts, lineage, rank_of, rank):
    n = defaultdict(float)
    for t, c in counts.items():
        up = next((a for a in lineage[t][rank:] if a is not None), t) if rank and rank_of[t] < rank else t
        n[up] += c
    order = sorted(n, key=lambda t: (-rank_of[t], t))
    weight, children = dict.fromkeys(n, 0.0), defaultdict(list)
    for t in reversed(order):
        p = next((a for a in lineage[t][rank_of[t] + 1 :] if a in weight), None)
        if p is not None:
            weight[p] += weight[t] + n[t]
            children[p].append(t)
    for t in order:
        if children[t]:
            for c in children[t]:
                n[c] += n[t] * (n[c] + weight[c]) / weight[t]
            del n[t]
    return dict(n)


@pytest.mark.parametrize("rank", [0, 4, 6])
def test_abundance(spark, taxa, rank):
    rng = random.Random(rank)
    nodes = TAXA + [(-t - 1, p, f"t{t}", 0) for t, p in enumerate([20, 21, 22, 20])]
    lineage = {n[0]: model_lineage(nodes, n[0]) for n in nodes}
    counts = {n[0]: float(rng.randrange(1, 50)) for n in nodes if n[3] < 21 and rng.random() < 0.8}
    lines = spark.createDataFrame(list(lineage.items()), "id bigint, lineage array<bigint>")
    info = spark.createDataFrame([(n[0], n[3]) for n in nodes], "id bigint, rank int")
    got = {r["tax"]: r["n"] for r in abundance.estimate(spark.createDataFrame(list(counts.items()), "tax bigint, n double"), lines, info, rank).collect()}
    want = model_estimate(counts, lineage, {n[0]: n[3] for n in nodes}, rank)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_rank_statistics(spark, taxa):
    lines = taxonomy.ranked_lineages(taxa, 16)
    rows = [(1, 20, 20), (2, 20, 21), (3, 20, 22), (4, 10, 20), (5, None, 20), (6, 20, None), (7, None, None)]
    both = spark.createDataFrame(rows, "query_id bigint, tax bigint, truth bigint")
    got = {r["rank"]: r for r in evaluate.rank_statistics(evaluate.correct_ranks(both, lines)).collect()}
    assert [got[r]["assigned"] for r in (3, 4, 6)] == [0, 4, 5] and got[4]["total"] == 7
    assert [got[r]["known"] for r in (3, 4)] == [0, 5]
    assert [got[r]["correct"] for r in (4, 6, 19)] == [1, 3, 4]
    assert [got[r]["wrong"] for r in (0, 5, 6, 18, 19)] == [2, 2, 1, 1, 0]


def test_coverage_filter(spark):
    c = spark.createDataFrame([(1, 0, 5, 0, 9), (2, 1, 4, 0, 0), (3, 2, 4, 3, 3)], "query_id bigint, tgt bigint, hits bigint, beg bigint, end bigint")
    t = spark.createDataFrame([(0, 10), (1, 100), (2, 20)], "tgt bigint, windows bigint")
    assert sorted(r["tgt"] for r in candidates.coverage_filter(c, t, 0.05).collect()) == [0, 2]
    assert sorted(r["tgt"] for r in candidates.coverage_filter(c, t, 0.0).collect()) == [0, 1, 2]


def model_align(q, s):
    t = [[0] * (len(s) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(s) + 1):
            t[i][j] = max(t[i - 1][j - 1] + (2 if q[i - 1] == s[j - 1] else -1), t[i - 1][j] - 1, t[i][j - 1] - 1)
    return t


def test_alignment():
    rng = random.Random(3)
    for _ in range(60):
        q, s = ("".join(rng.choices("ACG", k=rng.randrange(1, 15))) for _ in range(2))
        t = model_align(q, s)
        assert align.scores(q, s).tolist() == t
        score, a, b = align.align(q, s)
        assert score == max(*t[-1], *(r[-1] for r in t))
        assert len(a) == len(b) and a.replace("_", "") in q and b.replace("_", "") in s
        assert score == sum(-1 if "_" in (x, y) else 2 if x == y else -1 for x, y in zip(a, b, strict=True))
    assert align.align("", "ACGT") == (0, "", "")
    assert align.align_read("AAACCC", None, "TTGGGTTTAA")[3] == "-"


FASTA = ">a one\nACGT\r\n\nAC\n>b\n>c three\nGGG\n"
FASTQ = "@a\nACGT\n+\n@III\n@b x\nAC\nGT\n+b\nIIII\n"


def test_sequence_files(spark, tmp_path):
    assert list(sequences.records(FASTA.encode())) == [("a one", "ACGTAC", None), ("b", "", None), ("c three", "GGG", None)]
    assert list(sequences.records(FASTQ.encode())) == [("a", "ACGT", "@III"), ("b x", "ACGT", "IIII")]
    with pytest.raises(sequences.FormatError):
        list(sequences.records(b"text"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "sub" / "b.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    df = sequences.read_sequences(spark, str(tmp_path))
    assert df.count() == 5
    single = sequences.unpaired(df).orderBy("query_id").collect()
    assert [r["query_id"] for r in single] == [1, 2, 3, 4, 5] and single[3]["seq1"] == "ACGT"
    pairs = sequences.paired_in_file(df).orderBy("query_id").collect()
    assert [(r["header"], r["seq2"]) for r in pairs] == [("a one", ""), ("c three", None), ("a", "ACGT")]
    both = sequences.paired_files(df).orderBy("query_id").collect()
    assert [(r["header"], r["seq1"], r["seq2"]) for r in both] == [("a one", "ACGTAC", "ACGT"), ("b", "", "ACGT")]
    assert [r["query_id"] for r in sequences.filter_reads(sequences.unpaired(df), 4, 5, 1).collect()] == [4]


def test_sequence_files_in_blocks(spark, tmp_path):
    """Files that are split anywhere, records over many blocks included, are read as if they were whole; a gzip file never is."""
    rng = random.Random(8)
    bases = lambda n: "".join(rng.choices("ACGTN", k=n))
    signs = "".join(map(chr, range(33, 75)))  # with @, > and +
    fasta = "".join(f">r{i} of many\n" + "".join(f"{bases(rng.randrange(1, 60))}\n" for _ in range(rng.choice([1, 2, 3, 40]))) for i in range(40))
    fastq = ""
    for i in range(60):
        n = rng.randrange(1, 80)
        fastq += f"@q{i}\n{bases(n)}\n+\n{''.join(rng.choices(signs, k=n))}\n"
    (tmp_path / "a.fa").write_text(fasta)
    (tmp_path / "b.fq").write_text(fastq.replace("\n", "\r\n"))
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(fastq.encode()))
    want = [(f, i, *r) for f, t in (("a.fa", fasta), ("b.fq", fastq), ("c.fq.gz", fastq)) for i, r in enumerate(sequences.records(t.encode()), 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("400b", "2500b"):
            for k in before:
                spark.conf.set(k, size)
            got = sequences.read_sequences(spark, str(tmp_path)).collect()
            assert sorted((r["file"].rpartition("/")[2], r["index"], r["header"], r["seq"], r["qual"]) for r in got) == sorted(want), size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n5\t|\t2\t|\tspecies\t|\n6\t|\t4\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\tother\t|\t\t|\tsynonym\t|\n5\t|\t\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "merged.dmp").write_text("4\t|\t2\t|\n")
    got = {r["id"]: tuple(r)[1:] for r in taxonomy_files.read_taxonomy(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "--", 20), 2: (1, "Bacteria", 19), 5: (2, "<5>", 4), 6: (2, "--", 6), 4: (2, "", 21)}
    (tmp_path / "assembly_summary.txt").write_text("# note\n# assembly_accession\tbioproject\ttaxid\nGCF_1\tx\t7\nGCF_1\ty\t8\nGCF_2\tz\tbad\n")
    assert [tuple(r)[:2] for r in taxonomy_files.read_assembly_map(spark, str(tmp_path / "assembly_summary.txt")).collect()] == [("GCF_1", 7)]
    (tmp_path / "x.accession2taxid").write_text("accession\taccession.version\ttaxid\tgi\nNC_1\tNC_1.1\t9\t11\nNC_2\tNC_2.1\t10\t12\n")
    acc = taxonomy_files.read_accession_map(spark, str(tmp_path / "x.accession2taxid"))
    targets = spark.createDataFrame([(0, "NC_1.1", "", 0), (1, "NC_2.9", "", 0), (2, "q", "12", 0), (3, "NC_1.1", "", 5), (4, "zz", "", 0)], "tgt bigint, name string, gi string, parent bigint")
    assert {r["tgt"]: r["parent"] for r in taxonomy_files.assign_parents(targets, acc).collect()} == {0: 9, 1: 10, 2: 10, 3: 5, 4: 0}


@pytest.fixture(scope="module")
def genomes(spark, tmp_path_factory):
    rng = random.Random(5)
    made = ["".join(rng.choices("ACGT", k=n)) for n in (3000, 2500, 1500, 90, 10)]
    path = tmp_path_factory.mktemp("genomes")
    for i, g in enumerate(made):
        (path / f"g{i}.fa").write_text(f">NC_{i:06d}.1 taxid|{(20, 21, 22, 20, 0)[i]}|\n{g}\n")
    return made, sequences.read_sequences(spark, str(path))


def test_build_query_modify(spark, taxa, genomes, tmp_path):
    made, seqs = genomes
    db = api.build_index(seqs, taxa, BuildOptions(sequence_id="ncbi"))
    db.save(str(tmp_path / "db"), parts=3)
    loaded = Index.load(spark, str(tmp_path / "db"))
    assert loaded.features.count() == db.features.count() == sum(len(model_sketch(g, 16, 16, 127, 112)) for g in made)
    assert sum(Index.load(spark, str(tmp_path / "db"), part=p).features.count() for p in range(3)) == db.features.count()
    assert {r["tgt"]: r["windows"] for r in loaded.targets.collect()} == {t: 1 + max((w for w, _ in model_sketch(g, 16, 16, 127, 112)), default=-1) for t, g in enumerate(made)}
    reads = spark.createDataFrame([(1, "NC_000000.1", made[0][500:650], align.revcomp(made[0][800:950]), "f"), (2, "NC_000001", made[1][10:200], None, "f"), (3, "x", "ACGT" * 40, None, "f"), (4, "y", "AC", None, "f")], "query_id bigint, header string, seq1 string, seq2 string, file string")
    answer = api.query(loaded, reads)
    assert {r["query_id"]: r["tax"] for r in answer.classified.where("tax is not null").collect()} == {1: -1, 2: -2}
    assert {r["query_id"]: r["beg"] for r in answer.candidates.where("pos = 1").collect()}[1] in (4, 5)
    stats = {r["rank"]: r for r in api.evaluation(loaded, answer).collect()}
    assert stats[0]["correct"] == 2 and stats[0]["precision"] == 1.0 and stats[20]["total"] == 4
    table = report.mapping(answer.reads, answer.classified, api.all_taxa(loaded), FormatOptions(map_view="mapped"), tops=report.top_hits(answer.candidates, loaded.targets)).orderBy("query_id").collect()
    assert [r["taxon"] for r in table] == ["sequence:NC_000000.1", "sequence:NC_000001.1"]
    assert report.as_text(report.mapping(answer.reads, answer.classified, api.all_taxa(loaded), FormatOptions(omit_ranks=True)), FormatOptions(query_ids=True)).count() == 4
    assert report.target_info(loaded).count() == 5 and report.properties(loaded).count() == 6
    aligned = align.alignments(answer.candidates, reads, seqs.select((F.regexp_extract("file", "g([0-9])", 1).cast("bigint")).alias("tgt"), "seq"), 127, 112).collect()
    assert {r["query_id"]: r["score"] for r in aligned}[2] == 380
    plan = loaded.features.join(spark.createDataFrame([(5,)], "feature bigint").repartition(4, "feature").hint("merge"), "feature")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the index stays where it is
    twice = spark.createDataFrame([("z.fa", i, "NC_000000.1 taxid|22|", made[3], None) for i in (1, 2)], sequences.SCHEMA)
    names = [r["name"] for r in api.modify_index(api.modify_index(loaded, twice.where("index = 1"), BuildOptions(sequence_id="ncbi")), twice.where("index = 2"), BuildOptions(sequence_id="ncbi")).targets.collect()]
    assert {"NC_000000.1", "NC_000000.1!1", "NC_000000.1!1!2"} <= set(names)
    more = api.modify_index(loaded, spark.createDataFrame([("z.fa", 1, "NC_000000.1 taxid|22|", made[0][:1000], None)], sequences.SCHEMA), BuildOptions(sequence_id="ncbi"))
    assert sorted(r["name"] for r in more.targets.collect())[:2] == ["NC_000000.1", "NC_000000.1!1"]
    assert {r["query_id"]: r["tax"] for r in api.query(more, reads).classified.collect()}[1] == 2  # two targets of unlike genera
    species = QueryOptions(classify=ClassifyOptions(lowest=4))
    assert {r["query_id"]: r["tax"] for r in api.query(loaded, reads, species).classified.where("tax is not null").collect()} == {1: 20, 2: 21}
    covered = api.query(loaded, reads, QueryOptions(classify=ClassifyOptions(cov_percentile=0.1)))
    assert covered.classified.where("tax is not null").count() == 2


def test_stream(spark, taxa, genomes, tmp_path):
    from strandline.streaming.reads import classify_stream

    made, seqs = genomes
    db = api.build_index(seqs, taxa)
    schema = "query_id bigint, header string, seq1 string, seq2 string, file string"
    spark.createDataFrame([(1, "a", made[2][100:300], None, "f"), (2, "b", made[0][100:300], None, "f")], schema).write.parquet(str(tmp_path / "in"))
    found = {}
    stream = classify_stream(db, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, _: found.update({r["query_id"]: r["tax"] for r in df.collect()}))
    q = stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert found == {1: -3, 2: -1}


def test_merge(spark, taxa, tmp_path):
    head = "# Classification: by taxa\n# TABLE_LAYOUT: query_id\t|\theader\t|\ttop_hits\t|\ttaxon\n"
    (tmp_path / "1.txt").write_text(head + "1\t|\ta\t|\t20:9,21:3\t|\tx\n2\t|\tb\t|\t\t|\tx\n3\t|\tc\t|\t22:7\t|\tx\n")
    (tmp_path / "2.txt").write_text(head + "1\t|\ta\t|\t20:8,22:2\t|\tx\n3\t|\tc\t|\t20:7,999:50\t|\tx\n")
    found = results.read_results(spark, str(tmp_path / "1.txt"), str(tmp_path / "2.txt"))
    got = {r["query_id"]: (r["tax"], r["hits"]) for r in api.merge_results(found, taxa, MergeOptions(ClassifyOptions(hits_diff=0.5))).collect()}
    assert got == {1: (10, 9), 3: (2, 7)}
    (tmp_path / "3.txt").write_text("# Classification: sequence\n")
    with pytest.raises(ValueError, match="taxa"):
        results.read_results(spark, str(tmp_path / "3.txt"))
    assert results.partition_by_size([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]


def test_queries_match_sql(spark, data):
    """A sample of the registered queries that have SQL gives the SQL's rows."""
    duckdb = pytest.importorskip("duckdb")
    import os

    from strandline.plans import queries

    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    for name in ("sketch_documents", "classify_reads", "window_ranges", "index_bucket_statistics", "ranked_lca", "merged_results", "header_identifiers", "canonical_kmers", "abundance_table", "coverage_rates", "mapping_with_lineages", "hits_per_target_with_lineages", "all_hits_by_species", "all_window_ranges"):
        got = queries.QUERIES[name](spark, data)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLES[name]}) t").fetchall()
        assert Counter(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == Counter(want), name


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
    assert __spark_entry__.entry(spark).columns == ["query_id", "tax", "rank", "hits"]
