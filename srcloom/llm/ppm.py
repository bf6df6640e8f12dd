"""Language-model scores by prediction by partial matching over bytes, beside a smoothed unigram baseline.

Spark counts all byte grams of ORDER + 1 of the whole training texts, and none is pruned. Escapes follow method C; after an
escape the symbols of the longer context are excluded. The code length of a byte depends only on its gram, so it is computed
once for each distinct gram of the documents: grams that share their last three context bytes meet in one group (at most 2^24
of them, whatever the corpus), and orders up to 2 come from the table of 3-byte grams, which is broadcast (2^24 at most too).
Grams with at least 1/KEEP_GRAMS of all training bytes, which can't be more than KEEP_GRAMS, travel to the texts as a
broadcast of code lengths; all others, among them those that training doesn't have, are joined by the gram.

Base counts are exact: words with at least 1/KEEP_WORDS of all tokens, which can't be more than KEEP_WORDS, travel as a
broadcast, and all others are joined by the word itself (none of which holds a larger share, so no key is hot).

Edge cases: a null or empty text is its end token; without training rows every token is unknown (c = N = V = 0) and bytes
are equally likely; repeated rows are scored and counted once each; a null doc_id is in training.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, crc_bucket, materialise

ORDER = 5
#: Context bytes that the grams of a group of code lengths share, and the rows from which a group is closed.
SHARED = 3
GROUP_ROWS = 1_000_000
#: Grams with 1/KEEP_GRAMS of all training bytes bring their code lengths by broadcast, all others by join.
KEEP_GRAMS = 1 << 22
KEEP_WORDS = 1 << 20
FOLDS = 10
#: Texts whose grams are looked up together.
SLICE = 200
_START, _END = 10, 0
#: The end token; it has white space, so no word equals it.
END_TOKEN = b"\n"


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _codes(texts: list[bytes]) -> np.ndarray:
    """The packed gram of ORDER + 1 bytes at each byte of each text; each text follows ORDER start bytes and has an end byte."""
    joined = np.frombuffer(b"".join(bytes([_START]) * ORDER + t + bytes([_END]) for t in texts), np.uint8).astype(np.int64)
    code = joined[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code |= joined[ORDER - k : len(joined) - k] << (8 * k)
    lens = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lens + ORDER)
    scored = np.ones(len(joined) + 1, bool)
    for k in range(ORDER):
        scored[ends - lens - 1 - k] = False
    return code[scored[ORDER:-1]]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams with their counts."""
    return np.unique(_codes(texts), return_counts=True)


def _count_grams(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        g, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return g, np.bincount(inv, np.concatenate([x for _, x in held]), len(g)).astype(np.int64)

    for b in batches:
        texts = [lowered(t) for t in b.column(0).to_pylist()]
        out = b.column(1).to_pylist() if b.num_columns > 1 else [False] * len(texts)
        if train := [t for t, x in zip(texts, out) if not x]:
            held.append(_grams(train))
        if other := [t for t, x in zip(texts, out) if x]:  # known to be needed, but not counted
            grams, n = _grams(other)
            held.append((grams, np.zeros_like(n)))
        if len(held) >= 8:
            held = [merged()]
            if len(held[0][0]) > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["gram", "n"])
    if held:
        g, n = merged()
        for i in range(0, len(g), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 200_000]), pa.array(n[i : i + 200_000])], ["gram", "n"])


def _count_words(batches):
    held: Counter = Counter()

    def rows():
        words, n = list(held), list(held.values())
        held.clear()
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000], pa.binary()), pa.array(n[i : i + 100_000], pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            held.update(lowered(text).split())
        held[END_TOKEN] += b.num_rows
        if len(held) > 400_000:
            yield from rows()
    if held:
        yield from rows()


def _level(gram: np.ndarray, n: np.ndarray, k: int, lower: dict | None) -> dict:
    """Order k from sorted distinct grams of k + 1 bytes; by context: sum and number of its symbols, and their sum one order below."""
    context = gram >> 8
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.zeros(0, np.int64)
    out = {"gram": gram, "n": n, "context": context[first], "whole": _sums(n, first), "kinds": np.diff(np.append(first, len(gram)))}
    if lower is not None:
        at, _ = _find(lower["gram"], gram & ((1 << (8 * k)) - 1))
        out["below"] = _sums(lower["n"][at] if len(gram) else n, first)
    return out


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _shorter(gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the last `size` bytes with their counts."""
    key, inv = np.unique(gram & ((1 << (8 * size)) - 1), return_inverse=True)
    return key, np.bincount(inv, n, len(key)).astype(np.int64)


def low_levels(gram: np.ndarray, n: np.ndarray) -> list[dict]:
    """Orders 0 .. SHARED - 1 from all grams of SHARED bytes."""
    levels: list[dict] = []
    for k in range(SHARED):
        levels.append(_level(*_shorter(gram, n, k + 1), k, levels[-1] if k else None))
    return levels


def code_lengths(gram: np.ndarray, n: np.ndarray, low: list[dict]) -> np.ndarray:
    """Code length (log10) of the last byte of each distinct gram after the bytes before it; all grams that share SHARED context bytes are there, those with n = 0 aren't in training."""
    levels = list(low)
    for k in range(SHARED, ORDER + 1):
        levels.append(_level(*_shorter(gram[n > 0], n[n > 0], k + 1), k, levels[-1]))
    cost = np.zeros(len(gram))
    open_, less, fewer = np.arange(len(gram)), np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)  # sum and number of excluded symbols
    for k in range(ORDER, -1, -1):
        level, g = levels[k], gram[open_]
        at, there = _find(level["context"], (g >> 8) & ((1 << (8 * k)) - 1))
        place, hit = _find(level["gram"], g & ((1 << (8 * (k + 1))) - 1))
        if not len(level["gram"]):
            continue
        kinds = level["kinds"][at] - fewer
        whole = np.maximum(1, level["whole"][at] - less + kinds)
        part = np.where(hit, level["n"][place], np.where(there & (kinds > 0), kinds, whole))
        cost[open_] -= np.log10(part / whole)
        less = np.where(there, level["below"][at], 0)[~hit] if k else less[~hit]
        fewer = np.where(there, level["kinds"][at], 0)[~hit]
        open_ = open_[~hit]
    cost[open_] += np.log10(max(1, 256 - len(levels[0]["gram"])))
    return cost


def gram_costs(grams: DataFrame) -> DataFrame:
    """(gram, n, cost) for each row of grams(gram, n), which are distinct."""
    low = grams.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * SHARED)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    shared = grams.sparkSession.sparkContext.broadcast(low_levels(*(low.column(i).to_numpy() for i in range(2))))
    context = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * SHARED)) - 1)).alias("context")

    def run(batches):
        held: list[tuple] = []
        size = 0

        def rows(gram, n):
            cost = code_lengths(gram, n, shared.value)
            for i in range(0, len(gram), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (gram, n, cost)], ["gram", "n", "cost"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            size += b.num_rows
            if size >= GROUP_ROWS:
                context, gram, n = (np.concatenate([x[i] for x in held]) for i in range(3))
                whole = np.searchsorted(context, context[-1])  # the last context may go on
                if whole:
                    yield from rows(gram[:whole], n[:whole])
                held = [(context[whole:], gram[whole:], n[whole:])]
                size = len(context) - whole
        if held:
            yield from rows(*(np.concatenate([x[i] for x in held]) for i in (1, 2)))

    rows = grams.select(context, "gram", "n")
    return rows.repartition("context").sortWithinPartitions("context").mapInArrow(run, "gram long, n long, cost double")


def _scored(texts: list[bytes], grams: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """log10 probability of each text as far as grams (sorted) know it, and the grams that they don't, with their number."""
    own, inv = np.unique(_codes(texts), return_inverse=True) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, known = _find(grams, own)
    cost = np.zeros(len(own))
    cost[known] = costs[at[known]]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    score = -np.bincount(doc, cost[inv], len(texts))
    rest = ~known[inv]
    pair, times = np.unique(doc[rest] * max(1, len(own)) + inv[rest], return_counts=True)
    items = pa.StructArray.from_arrays([pa.array(own[pair % max(1, len(own))]), pa.array(times)], ["gram", "times"])
    ends = np.searchsorted(pair, np.arange(len(texts) + 1) * max(1, len(own)))
    return score, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


_unfolded: dict[str, tuple[dict[bytes, int], np.ndarray, np.ndarray]] = {}


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, keep: int = KEEP_GRAMS, keep_words: int = KEEP_WORDS) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    batched(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(crc_bucket(F.col(id_col), folds) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = src.filter(~F.col("held_out"))
    words = materialise(train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    big_n, big_v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = F.col("n") * keep_words >= F.lit(big_n)
    top = words.filter(often).toArrow()  # at most `keep_words` rows, for each has 1/keep_words of all tokens
    grams = materialise(src.select("text", "held_out").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    costs = materialise(gram_costs(grams), "costs")
    frequent = (F.col("n") > 0) & (F.col("n") * keep >= F.lit(total))
    hot = costs.filter(frequent).orderBy("gram").select("gram", "cost").toArrow()  # at most `keep` rows
    shared = spark.sparkContext.broadcast((top, *(hot.column(i).to_numpy() for i in range(2))))  # workers build what they look up
    name = uuid.uuid4().hex
    whole = np.log10(big_n + 0.1 * (big_v + 1))

    def run(batches):
        if name not in _unfolded:
            words, *model = shared.value
            _unfolded.clear()
            _unfolded[name] = (dict(zip(words.column(0).to_pylist(), words.column(1).to_pylist())), *model)
        known, grams, costs = _unfolded[name]
        for b in batches:
            texts = [lowered(t) for t in b.column(2).to_pylist()]
            n_tokens, n_known, base, rare = [], [], [], []
            for t in texts:
                tf = Counter(t.split())
                tf[END_TOKEN] += 1
                seen, c, rest = [], [], []
                for w, n in tf.items():
                    if (k := known.get(w)) is None:
                        rest.append((w, n))
                    else:
                        seen.append(n)
                        c.append(k)
                seen = np.array(seen, np.float64)
                n_tokens.append(sum(tf.values()))
                n_known.append(int(seen.sum()))
                base.append(float((seen * (np.log10(np.array(c, np.float64) + 0.1) - whole)).sum()))
                rare.append(rest)
            flat = [x for r in rare for x in r]
            items = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())], ["word", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), items)
            parts = [_scored(texts[i : i + SLICE], grams, costs) for i in range(0, max(1, len(texts)), SLICE)]
            score, seldom = np.concatenate([x for x, _ in parts]), pa.concat_arrays([x for _, x in parts])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), lists, seldom],
                ["id", "held_out", "n_tokens", "hot_known", "hot_base", "hot_score", "rare", "seldom"],
            )

    schema = "id long, held_out boolean, n_tokens long, hot_known long, hot_base double, hot_score double, rare array<struct<word:binary,tf:long>>, seldom array<struct<gram:long,times:long>>"
    rows = materialise(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    tail = words.filter(~often)
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.join(tail, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * (F.log10(c + 0.1) - F.lit(float(whole)))).alias("rare_base")
    )
    seldom = rows.select("row", F.explode("seldom").alias("s")).select("row", "s.gram", "s.times")
    lengths = seldom.join(costs.filter(~frequent).select("gram", "cost"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest"))
    out = rows.drop("rare", "seldom").join(sums, "row", "left").join(lengths, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(big_n)).cast("long").alias("train_tokens"), (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("hot_score") - F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
