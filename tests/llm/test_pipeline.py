"""The pipeline's stages, and run() as a whole, against plain Python on a small fixture; and on odd tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from test_documents import SPACE, brute_components, brute_hits, plain_mcd

import corpus_pipeline
from strandline.llm import packing

STEP, UNIT = 2654435769, 2**32


@pytest.fixture
def corpus(spark, tmp_path):
    """Documents of two sources with symbols, repeated lines, copies, near copies, benchmark passages and short texts."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([2, 3, 4, 5, 6, 9])))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(25))) for i in range(5)] + [(9, None)]
    rows = []
    for i in range(150):
        w = prose(rng.randrange(60, 160))
        kind = rng.choice(["clean", "clean", "clean", "symbols", "copy", "near", "leak", "short"])
        if kind == "symbols":
            w = [x + "##" for x in w]
        elif kind == "leak":
            w[10:10] = items[i % 5][1].split()[i % 8 : i % 8 + 12]
        elif kind == "short":
            w = w[:20]
        t = "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))
        if kind in ("copy", "near") and rows:
            t = rng.choice(rows)[1] or t
            if kind == "near":
                t = t.replace(" ", "  ", 1) + " one more word"
        rows.append((i, t, "en", ["a", "b"][i % 2]))
    rows += [(500, None, "en", "a"), (501, "", None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def plain_quality(rows):
    good, x = [], {}
    for r in rows:
        w = SPACE.findall(r[1] or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {p for k, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for p in (k, k + 1, k + 2)}
        if len(w) < 50 or 100 * len(rep) > 50 * len(w):
            continue
        lines = [y for y in r[1].split("\n") if SPACE.search(y)]
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1])
        x[r[0]] = [round(1000 * v) for v in (math.log(chars / len(w)), math.sqrt(symbols / chars), math.sqrt(len(rep) / len(w)), math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 2)))]
        good.append(r)
    out = []
    for source in ("a", "b"):
        own = [r for r in good if r[3] == source]
        assert len(own) >= 50
        keep = plain_mcd(np.array([x[r[0]] for r in own], float), [40, 30, 120, 130])
        out += [r for r, k in zip(own, keep, strict=True) if k]
    return out


def plain_dedup(rows):
    found = brute_components([r[:2] for r in rows], 5)
    return [r for r in rows if found[r[0]][1] == r[0]]


def plain_decontamination(rows, items):
    hit = {d for d, _, n, _ in brute_hits([r[:2] for r in rows], items) if n}
    return [r for r in rows if r[0] not in hit]


def plain_mix(rows):
    """Each row as often as the mix takes it: water-filled targets, golden-ratio slots of blocks, documents end to end by a hash."""
    size = {r[0]: len(SPACE.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, total = {}, 1.5 * sum(of.values())
    while len(target) < len(sources):
        free = [s for s in sources if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * of[s]]
        target |= {s: 2 * of[s] for s in full} if full else {s: level * weight[s] for s in free}
    whole = [math.floor(target[s] + 0.5) for s in sources]
    block, ends = max(16, min(4096, -(-sum(whole) // 2**20))), np.cumsum([0, *whole])
    bounds = [math.floor(e / ends[-1] * UNIT) for e in ends]
    slots = Counter(int(np.searchsorted(bounds, k * STEP % UNIT, "right")) - 1 for k in range(-(-sum(whole) // block)))
    out = []
    for i, s in enumerate(sources):
        reach, start = slots[i] * block, 0
        own = [r for r in rows if r[3] == s]
        for r in sorted(own, key=lambda r: (int(hashlib.md5(f"{r[0]}/{r[1] or ''}".encode()).hexdigest()[:15], 16), r[0])):
            n = size[r[0]]
            taken = sum(max(0, min(n, reach - k * of[s] - start)) for k in (0, 1))
            out += [r] * ((2 * taken + n) // (2 * n) if n else 0)
            start += n
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


def pieces(packed):
    """How often each part of each document is packed, and its ids."""
    count, ids = Counter(), {}
    for r in packed.collect():
        row = np.frombuffer(bytes(r["input_ids"]), "<u2")
        for d, p, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            count[d] += p == 0
            assert ids.setdefault((d, p), row[a:b].tolist()) == row[a:b].tolist()
    return count, ids


def test_stages_and_run_against_plain_versions(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    plain = [plain_quality, plain_dedup, lambda r: plain_decontamination(r, items), plain_mix]
    assert len(corpus_pipeline.STAGES) == 5
    for (_, stage), f in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before, rows = rows, f(rows)
        docs = stage(spark, docs, path).persist()
        assert docs.columns == columns
        assert rows_of(docs) == sorted(rows, key=str), stage.__name__
        assert len(rows) != len(before)
    encode, end = packing.encoder("byte_bpe_50k.tiktoken")
    want = Counter(r[0] for r in rows)
    for packed in (corpus_pipeline.STAGES[-1][1](spark, docs, path), corpus_pipeline.run(spark, path)):
        count, ids = pieces(packed)
        assert count == want
        for i, t, *_ in rows:
            assert [x for k in range(len([1 for d, _ in ids if d == i])) for x in ids[i, k]] == [*encode(t).tolist(), end]


def test_odd_tables(spark, corpus, clash):
    """Empty tables; nulls, repeated rows and clashing names, stage by stage: columns stay, nothing crashes."""
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
    odd = spark.createDataFrame([(None, rows[0][1], None, None, 1), (None, None, None, None, None), (600, rows[1][1], "en", None, 2)], docs.schema)
    made = clash(docs.union(odd).union(docs.where("doc_id < 40")))
    before = made
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, path).persist()
        assert after.columns == made.columns and 0 < after.count() <= 2 * before.count()
        before = after
    assert before.where("doc_id is null").count() <= 2
    assert corpus_pipeline.STAGES[-1][1](spark, before, path).count() > 0
