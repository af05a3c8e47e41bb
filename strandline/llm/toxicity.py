"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Store

#: Labelled rows that a fit takes at most, by a hash of their id, and entries that a lexicon has at most.
SAMPLE, ENTRIES = 40_000, 5_000
#: Entries of the documents of label 1 that are counted in the others, most frequent first.
CANDIDATES = 200_000
#: A stem is a word's first letters, so many.
STEMS = range(4, 9)
#: Least documents of an entry, and least log-odds of label 1 that it must give.
SUPPORT, LEAST = 5, 2.5
#: Letters that look alike, and signs that stand for letters. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}
_WORD = re.compile(r"\w+")


class _Fold(dict):
    """Table for str.translate, filled as characters come up: lower case, no accents, look-alikes as the letter they look like, l as i."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = HOMOGLYPHS.get(c, c)
        if ord(c[0]) > 127:
            c = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x) and x not in "​‌‍﻿­")
        self[code] = c = c.replace("l", "i")
        return c


_TABLE = _Fold()


def fold(text: str) -> str:
    """Folded text: what is written to look like a word becomes that word. `1`, `l` and `i` are one letter."""
    return text.translate(_TABLE)


def _features(text: str) -> set[str]:
    """A text's words, as `word `, and stems."""
    words = set(_WORD.findall(fold(text)))
    return {w + " " for w in words if len(w) < 40} | {w[:n] for w in words for n in STEMS if len(w) > n}


def training(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(text, y) of labelled rows with crc32(doc_id) mod 5 not 0; of more than `sample`, those least by a hash of the id."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)).groupBy(F.col(id_col).alias("_y")).agg(F.max(label_col).alias("y"))
    y = F.broadcast(y.orderBy(F.xxhash64("_y"), "_y").limit(sample))  # at most `sample` rows
    return docs.join(y, F.col(id_col) == F.col("_y")).select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("y").cast("int"))


def learn(rows: DataFrame, store: Store | None = None) -> dict:
    """A lexicon {entry: weight}, exception phrases, and a calibration, from rows (text, y).

    Documents with an entry are counted in Spark, pre-aggregated: in those of label 1 first, then, for the CANDIDATES most
    frequent of SUPPORT documents at least, in the others. The ENTRIES most frequent that give LEAST log-odds go on. Longer stems and words go if a stem of theirs is as good, and so do words of texts that are only copied. An exception is a phrase of an entry's word
    and the next that label 0 has at least SUPPORT times and label 1 never: it cancels the entry there. The calibration is a
    logistic regression on the weights' sum and its ratio to length. Without rows of both labels, every score is the share
    of label 1, or 0.
    """
    store = store or Store(rows.sparkSession)
    rows = store.put(rows, "training")
    by = {r["y"]: r["count"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect()}
    n0, n1 = by.get(0, 0), by.get(1, 0)
    prior = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.0
    empty = {"entries": {}, "exceptions": [], "beta": [math.log(prior / (1 - prior)) if prior else -20.0, 0.0, 0.0]}
    if not n0 or not n1:
        return empty

    def counted(texts: DataFrame, only: frozenset[str] | None, name: str) -> DataFrame:
        """Documents with each feature, or with each of some."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got: Counter[str] = Counter()
                for t in batch.column(0).to_pylist():
                    got.update(_features(t) if only is None else _features(t) & only)
                yield pa.record_batch([pa.array(got.keys(), pa.string()), pa.array(got.values(), pa.int64())], names=["f", name])

        return texts.select("text").mapInArrow(count, f"f string, {name} bigint").groupBy("f").agg(F.sum(name).alias(name))

    toxic = counted(rows.where("y > 0"), None, "c1").where(F.col("c1") >= SUPPORT).orderBy(F.desc("c1"), "f").limit(CANDIDATES).collect()
    c1 = {r["f"]: r["c1"] for r in toxic}
    c0 = {r["f"]: r["c0"] for r in counted(rows.where("y <= 0"), frozenset(c1), "c0").collect()}
    weight = {f: math.log((n + 0.5) / (n1 + 1)) - math.log((c0.get(f, 0) + 0.5) / (n0 + 1)) for f, n in c1.items()}
    top = sorted((f for f in c1 if weight[f] >= LEAST), key=lambda f: (-c1[f], f))[:ENTRIES]
    # Words of a toxic text that is often copied are as frequent as what makes it toxic. So texts are told apart by one of
    # their long words, the same in copies: an entry needs SUPPORT such texts, and no fewer than half of its documents.
    chosen = frozenset(top)

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_features(t) for t in batch.column(0).to_pylist()]
            mark = [min((zlib.crc32(f.encode()) for f in g if len(f) > 8 and f[-1] == " "), default=len(t)) for g, t in zip(got, batch.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([sorted(g & chosen) for g in got], pa.list_(pa.string())), pa.array(mark, pa.int64())], names=["f", "mark"])

    unlike: dict[str, set[int]] = {}
    for r in rows.where("y > 0").select("text").mapInArrow(which, "f array<string>, mark bigint").collect():  # at most SAMPLE
        for f in r["f"]:
            unlike.setdefault(f, set()).add(r["mark"])
    entries: dict[str, float] = {}
    for f in sorted(top, key=lambda f: (len(f), f)):
        shorter = [f[:n] for n in STEMS if f[:n] in entries]
        # A longer entry says more only if it is surer by far than the stems of it that are in.
        better = not shorter or (weight[f] > max(entries[s] for s in shorter) + 2 and c1[f] > 0.5 * max(c1[s] for s in shorter))
        if better and len(unlike.get(f, ())) >= max(SUPPORT, 0.5 * c1[f]):
            entries[f] = weight[f]
    model = {"entries": entries, "exceptions": [], "beta": empty["beta"]}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(model)
        for batch in batches:
            out = [(*match.measure(t), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            phrases = [match.phrases(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array(phrases, pa.list_(pa.string()))], names=["s", "n", "y", "p"])

    measured = rows.mapInArrow(scored, "s double, n bigint, y int, p array<string>")
    measured = store.put(measured, "measured")
    by_phrase = measured.select("y", F.explode("p").alias("p")).groupBy("p").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1")).where(f"c0 >= {SUPPORT} and c1 = 0")
    model["exceptions"] = sorted(r["p"] for r in by_phrase.orderBy(F.desc("c0"), "p").limit(ENTRIES).collect())
    data = np.array([(r["s"], r["n"], r["y"]) for r in measured.select("s", "n", "y").collect()], float)
    model["beta"] = _logistic(_inputs(data[:, 0], data[:, 1]), data[:, 2])
    return model


def _inputs(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A constant, the logarithm of the sum of weights, and the sum a root of length: what a long text says in passing counts less."""
    return np.stack([np.ones_like(s), np.log1p(s), s / np.sqrt(n + 20)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        beta += np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
    return beta.tolist()


class Matcher:
    """An Aho-Corasick automaton over a model's entries."""

    def __init__(self, model: dict):
        self.beta, self.exceptions = model["beta"], set(model["exceptions"])
        self.find = ahocorasick.Automaton()
        for e, w in model["entries"].items():
            word = e.rstrip(" ")
            old = self.find.get(word, (0, 0.0, 0.0))
            self.find.add_word(word, (len(word), w if e != word else old[1], w if e == word else old[2]))
        if len(self.find):
            self.find.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end of word, weight) of entries, each place once, by the surest."""
        if not len(self.find):
            return
        best: dict[int, float] = {}
        for last, (n, whole, stem) in self.find.iter(text):
            start = last - n + 1
            if start and text[start - 1].isalnum():
                continue
            more = last + 1 < len(text) and (text[last + 1].isalnum() or text[last + 1] == "_")
            w = stem if more else max(whole, stem if n < min(STEMS) else whole)
            if w > best.get(start, 0.0):
                best[start] = w
        for start, w in best.items():
            yield start, _WORD.match(text, start).end(), w

    def _phrase(self, text: str, start: int, end: int) -> str:
        following = _WORD.search(text, end, end + 60)
        return text[start:end] + " " + (following.group() if following else "")

    def phrases(self, raw: str) -> list[str]:
        text = fold(raw)
        return sorted({self._phrase(text, a, b) for a, b, _ in self.hits(text)})

    def measure(self, raw: str) -> tuple[float, int]:
        """The sum of weights, and the length in words, nearly: spaces and one."""
        text = fold(raw)
        s = sum(w for a, b, w in self.hits(text) if not self.exceptions or self._phrase(text, a, b) not in self.exceptions)
        return s, raw.count(" ") + 1

    def score(self, raws: list[str]) -> np.ndarray:
        m = np.array([self.measure(r) for r in raws], float).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(_inputs(m[:, 0], m[:, 1]) @ np.array(self.beta), -30, 30)))


@lru_cache(maxsize=4)
def _matcher(key: str) -> Matcher:
    import json

    return Matcher(json.loads(key))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs, by text alone, with no shuffle. Null is an empty text; extra columns are ignored."""
    import json

    ship(docs.sparkSession)
    key = json.dumps(model)
    schema = docs.select(F.col(id_col)).schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(key)
        for batch in batches:
            s = match.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, by a lexicon learned from labelled rows that aren't held out.

    held_out: crc32 of doc_id as text, mod 5, is 0. A null doc_id isn't held out. Repeated rows are scored alike; repeated
    labels of a document count as the greatest. Labels without a document, and null labels, are ignored.
    """
    out = score(docs, learn(training(docs, labels)))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
