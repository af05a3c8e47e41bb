"""Token counts with a whole-token shortcut: words proved to be one token are counted by lookup, the rest are merged once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SPACE_MARK = "▁"
#: Words whose counts a Python worker keeps; beyond it, it starts anew from the proved ones.
MEMO = 400_000
_loaded: dict[str, PieceCounts] = {}


class PieceCounts(dict):
    """Token counts of pre-tokens under a SentencePiece BPE model, each as the library would split it inside any text.

    A pre-token is a word with the spaces before it, less one; or, after a line feed, the line feed and the word. That is
    exact if no merge can cross its edges, which holds if no vocabulary piece has a space mark after another character or a
    line feed beside one, and the model leaves text as it is. `__init__` proves that, or raises; and which words alone are one
    token, unless it is given them.
    """

    def __init__(self, model_file: str, proved: dict[str, int] | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            raw = f.read()
        spec = pb.ModelProto()
        spec.ParseFromString(raw)
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        pieces = [p.piece for p in spec.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
        own = [p.piece for p in spec.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED]
        if (
            norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces
            or kind.model_type != pb.TrainerSpec.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix or own
            or any(SPACE_MARK in p.lstrip(SPACE_MARK) or ("\n" in p and p != "\n") for p in pieces) or SPACE_MARK not in pieces
        ):
            raise ValueError("pre-tokens of this model can't be counted one by one")
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=raw).encode
        if proved is None:  # the proof, by encoding each vocabulary string on its own
            words = [p[1:] for p in pieces if p.startswith(SPACE_MARK) and p[1:] and SPACE_MARK not in p[1:]]
            proved = {w: 1 for w, ids in zip(words, self.encode(words, num_threads=1), strict=True) if len(ids) == 1} | {"": 1}
        self.proved = proved
        super().__init__(self.proved)

    def __missing__(self, key: str) -> int:
        if len(self) > MEMO:
            self.clear()
            self.update(self.proved)
        n = len(self.encode(key, num_threads=1)) - (key[:1] == "\n")
        if len(key) < 200:
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE_MARK, " ")
        if "  " in text or text[0] == " ":  # a run of spaces is one pre-token with its word
            keys = [k[1:] if k[0] == " " else k for k in re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)]
        else:
            keys = text.replace("\n", " \n").split(" ")
        return sum(map(self.__getitem__, keys))


class RankCounts(dict):
    """The same for byte-level BPE ranks: pre-tokens come from the library's pattern; one in the vocabulary is one token if its encoding proves it."""

    def __init__(self, ranks_file: str, pattern: str, proved: dict[str, int] | None = None):
        import base64

        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text, num_threads=1: encoding.encode_ordinary(text)
        self.split = regex.compile(pattern).findall
        words = [w.decode() for w in ranks if w.decode(errors="ignore").encode() == w] if proved is None else []
        self.proved = {w: 1 for w in words if len(self.encode(w)) == 1} if proved is None else proved
        super().__init__(self.proved)

    def __missing__(self, key: str) -> int:
        if len(self) > MEMO:
            self.clear()
            self.update(self.proved)
        n = len(self.encode(key))
        if len(key) < 200:
            self[key] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split(text)))


def counts_of(name: str, proved: dict[str, int] | None = None) -> PieceCounts | RankCounts:
    """The counter of one of the installed public tokenizers, made once in each process; with the words proved elsewhere, if given."""
    if name not in _loaded:
        import public_tokenizers

        path = public_tokenizers.path(name)
        _loaded[name] = PieceCounts(path, proved) if name.endswith(".model") else RankCounts(path, public_tokenizers.PATTERN, proved)
    return _loaded[name]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, with no shuffle.

    Which vocabulary strings alone are one token is proved once, by the driver, and sent to the workers: a table of the
    vocabulary's size. Words in it are counted by lookup; the rest are merged by the library, once each in a worker's memory.
    Null and empty texts have 0 bytes and tokens. Null ids and repeated rows stay. Texts of any length are read whole; memory
    is one Arrow batch and the memo. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    schema = docs.select(F.col(id_col)).schema.simpleString()[7:-1]
    proved = docs.sparkSession.sparkContext.broadcast(counts_of(tokenizer).proved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts_of(tokenizer, proved.value).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{schema}, n_bytes bigint, n_tokens bigint, over_limit boolean")
