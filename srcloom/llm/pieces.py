"""SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores (unigram models) or merges (BPE models, whose order
is that of the scores), user-defined pieces and byte fallback are rebuilt from it, and whole batches of texts are encoded, and
decoded again, by the library's threads. Texts are cut before each run of markers unless a piece of the vocabulary crosses such
a place, which changes no result and lets the library's cache work by word. `verify` compares ids and texts with the
sentencepiece library itself; it runs on probes in every worker, and on the rows of each batch that a parameter asks for.
What can't be rebuilt with equal results is refused: word and character models, a marker as suffix, and user-defined pieces of
BPE models.

Edge cases: null and empty texts have no ids and decode to the empty text; characters outside the vocabulary fall back to
bytes (or the unknown piece, where the model has no byte pieces); every row is encoded whole, repeated rows alike; a null id
of a row stays null.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: Place of the default model; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Words whose pieces a worker remembers (more cost longer look-ups than they save), and threads of a worker.
CACHE = 10_000
THREADS = 2
#: Texts of a batch that are compared with the sentencepiece library besides the probes, by their first characters; results don't depend on it.
CHECK = 4
SAMPLE = 2000


def _fields(data: bytes):
    """(field, value) of a protobuf message: integers, 4- and 8-byte values, or bytes."""

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class SentencePieceModel:
    """What a model file says: pieces with scores and kinds, and how texts are normalised."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode("utf-8"), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.surface = trainer.get(44, " \u2047 ".encode()).decode()
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.byte_fallback = any(p[2] == BYTE for p in self.pieces)
        if trainer.get(24, 0):
            raise ValueError("the marker as a suffix of words is not supported")
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))

    def merges(self) -> list[tuple[str, str]]:
        """All pairs of pieces that make a piece, best piece first."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL and len(piece) > 1:
                pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
                found += [(-score, rank[piece], rank[a], rank[b], a, b) for a, b in pairs]
        return [x[4:] for x in sorted(found)]

    def tokenizer(self):
        """The same tokenizer in the tokenizers library."""
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, 0.0 if kind == USER else s) for p, s, kind in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=CACHE)
        else:
            raise ValueError(f"model type {self.kind} has neither scores nor merges to rebuild")
        t = Tokenizer(model)
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        cuts = []
        if user := sorted((p for p, _, kind in self.pieces if kind == USER), key=len, reverse=True):
            if self.kind == BPE:
                raise ValueError("user-defined pieces of a BPE model are not supported")
            cuts.append(pre_tokenizers.Split(Regex("|".join(re.escape(p) for p in user)), "isolated"))
        if not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER)):
            cuts.append(pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated"))
        if cuts:
            t.pre_tokenizer = pre_tokenizers.Sequence(cuts)
        return t

    def decoder(self, unknown: bool):
        """The library's decoder; `unknown` for ids among which the unknown piece is, which stands for its surface."""
        from tokenizers import decoders

        steps = [decoders.Replace(self.pieces[self.unknown][0], self.surface)] if unknown else []
        steps += [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        return decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> tuple[SentencePieceModel, object]:
    with open(path, "rb") as f:
        model = SentencePieceModel(f.read())
    return model, model.tokenizer()


def encode_texts(texts: list[str | None], path: str = MODEL) -> list[list[int]]:
    """Ids of each text, without control pieces; the batch is encoded by the library's threads."""
    _, t = load(path)
    full = [i for i, x in enumerate(texts) if x]
    out: list[list[int]] = [[] for _ in texts]
    for i, e in zip(full, t.encode_batch_fast([texts[i] for i in full], add_special_tokens=False)):
        out[i] = e.ids
    return out


def decode_ids(ids: list[list[int]], path: str = MODEL) -> list[str]:
    """The text of each list of ids; the batch is decoded by the library's threads."""
    model, t = load(path)
    out = [""] * len(ids)
    odd = [i for i, row in enumerate(ids) if row and model.unknown in row]
    plain = sorted(set(range(len(ids))) - set(odd)) if odd else range(len(ids))
    for unknown, part in ((False, plain), (True, odd)):
        if part:
            t.decoder = model.decoder(unknown)
            for i, text in zip(part, t.decode_batch([ids[i] for i in part], skip_special_tokens=False)):
                out[i] = text
    return out


def verify(texts: list[str], path: str = MODEL) -> list[int]:
    """Indices of the texts whose ids or decoded text differ from the sentencepiece library's."""
    sp = _original(path)
    ours, theirs = encode_texts(texts, path), sp.encode(texts, num_threads=1)
    back, first = decode_ids(ours, path), sp.decode(theirs)
    return [i for i in range(len(texts)) if ours[i] != theirs[i] or back[i] != first[i]]


@lru_cache(maxsize=4)
def _original(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


#: Parity is verified on these before a worker encodes anything.
PROBES = ["", " ", "a", "Hello, world!", "  two  spaces ", "tab\tnew\nline\r\n", "été straße 中文 \U0001f600", "<s> </s> <0x41> ▁x▁▁y", "1234567890" * 3, "\u0000\u0007"]
_verified: set[str] = set()


def _ready(path: str) -> None:
    if path not in _verified:
        if wrong := verify(PROBES, path):
            raise ValueError(f"{path}: the rebuilt tokenizer differs on {[PROBES[i] for i in wrong]}")
        _verified.add(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, check: int = CHECK) -> DataFrame:
    """One row per document: id_col, ids, n_tokens, and round_trip (whether the library decodes the ids to the text again).

    The first `check` texts of each batch are also compared with the sentencepiece library; a difference stops the job.
    """
    batched(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _ready(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encode_texts(texts, path)
            back = decode_ids(ids, path)
            if wrong := verify([t[:SAMPLE] for t in texts[:check] if t], path):
                raise ValueError(f"{path}: the rebuilt tokenizer differs on {len(wrong)} texts of a batch")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array([(t or "") == x for t, x in zip(texts, back)])],
                ["id", "ids", "n_tokens", "round_trip"],
            )

    return src.mapInArrow(run, "id long, ids array<int>, n_tokens long, round_trip boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """One row per row: id_col, text."""
    batched(encoded.sparkSession)
    src = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decode_ids([x or [] for x in b.column(1).to_pylist()], path), pa.string())], ["id", "text"])

    return src.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
