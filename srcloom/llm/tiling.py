"""Benchmark decontamination by greedy string tiling.

Benchmark items are a query set: they are taken in blocks of at most BLOCK_BYTES of text, each of which is broadcast and met
by every document. The seeds (runs of SEED words) of a document are joined with the block's sorted seeds; a document and an item
that share one are tiled: the longest common word runs that don't overlap earlier ones are marked, longest first, found by
running Karp-Rabin hashes of shrinking lengths, down to MIN_MATCH words. A length costs one subtraction a word, as hashes are
differences of prefix sums. The share of the item's words under tiles is its coverage; tiles may lie in any order, so reordered
passages are caught.

Words are lower-cased (all of Unicode) and stripped of punctuation at their ends. Items shorter than SEED words need one
exact run of all their words. Edge cases: null and empty texts and items match nothing; equal coverage keeps every item (one
row per document and item); repeated documents are judged alike, repeated item ids give one row each; an item without words
is never found; a single item above BLOCK_BYTES makes a block of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise

SEED = 5
MIN_MATCH = 3
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Text of benchmark items (UTF-8) that travels to the workers at once.
BLOCK_BYTES = 32 << 20
STRIP = " .,;:!?\"'()[]{}<>|#*$%&-_/\\`~"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def words_of(text: str | None) -> list[str]:
    """The words compared: lower case, without punctuation at their ends; what is all punctuation is left out."""
    return [w for w in (x.strip(STRIP) for x in (text or "").lower().split()) if w]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 12), base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


class Rolling:
    """Karp-Rabin hashes of the runs of a sequence of word ids, of any length, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((ids + 2).astype(np.uint64) * _power(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def runs(self, k: int) -> np.ndarray:
        """The hashes of all runs of k words."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.back[:n] if n > 0 else self.sums[:0]


def _full(mask: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k true values."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return np.flatnonzero(sums[k:] - sums[:-k] == k) if len(mask) >= k else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles of two sequences of word ids, in the order they were marked."""
    known = np.isin(doc, item)
    free_d, free_i = known.copy(), np.ones(len(item), bool)  # words that the item doesn't have can't be tiled
    hash_d, hash_i = Rolling(doc), Rolling(item)
    out: list[tuple[int, int, int]] = []

    def open_runs(k):
        """Starts and hashes of unmarked runs of k words, those in doc whose hash the item has."""
        at_i = _full(free_i, k)
        at_d = _full(free_d, k)
        hi, hd = hash_i.runs(k)[at_i], hash_d.runs(k)[at_d]
        both = np.isin(hd, hi)
        return at_d[both], hd[both], at_i, hi

    length = min(len(doc), len(item))
    while length >= least:
        low, high, best = least, length, None
        while low <= high:  # the greatest length with a common run, by bisection
            k = (low + high) // 2
            got = open_runs(k)
            if len(got[0]):
                best, low = (k, got), k + 1
            else:
                high = k - 1
        if best is None:
            break
        length, (at_d, hd, at_i, hi) = best
        waiting: dict[int, list[int]] = {}
        for h, d in zip(hd[::-1].tolist(), at_d[::-1].tolist()):
            waiting.setdefault(h, []).append(d)
        for h, i in zip(hi.tolist(), at_i.tolist()):  # leftmost in the item first, each with the leftmost place that is still open
            places = waiting.get(h)
            if not places or not free_i[i] or not free_i[i + length - 1]:
                continue
            while places:
                d = places.pop()
                if free_d[d] and free_d[d + length - 1] and np.array_equal(doc[d : d + length], item[i : i + length]):
                    free_d[d : d + length] = free_i[i : i + length] = False
                    out.append((d, i, length))
                    break
        length -= 1
    return out


class Items:
    """A block of benchmark items: their words as ids, and the seeds that lead to them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.items = []
        seeds: dict[int, list] = {}
        for item_id, text in rows:
            w = np.array([self.ids.setdefault(x, len(self.ids)) for x in words_of(text)], np.int64)
            if len(w):
                k = min(SEED, len(w))
                h = np.unique(Rolling(w).runs(k))
                seeds.setdefault(k, []).append((h, np.full(len(h), len(self.items))))
                self.items.append((item_id, w, k))
        self.by_size = {}
        for k, parts in seeds.items():
            h, o = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.by_size[k] = (h[order], o[order])

    def hits(self, text: str | None, coverage: float) -> list[tuple[int, float, str, int]]:
        """(item id, coverage, tiles, words of the item) of the items that a text covers."""
        w = words_of(text)
        if not w or not self.items:
            return []
        get = self.ids.get
        doc = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        known, rolling = doc >= 0, None
        wanted: set[int] = set()
        for k, (h, owner) in self.by_size.items():
            whole = _full(known, k)
            if not len(whole):
                continue
            rolling = rolling or Rolling(doc)
            mine = np.unique(rolling.runs(k)[whole])
            a, b = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            for x, y in zip(a[a < b].tolist(), b[a < b].tolist()):
                wanted.update(owner[x:y].tolist())
        out = []
        for j in sorted(wanted):
            item_id, words, size = self.items[j]
            found = tiles(doc, words, min(MIN_MATCH, size))
            share = sum(n for _, _, n in found) / len(words)
            if share >= (coverage if len(words) >= SEED else 1.0):
                out.append((item_id, share, ",".join(f"{d}:{i}:{n}" for d, i, n in sorted(found)), len(words)))
        return out


#: The block a worker has built last; it serves all of its tasks.
_built: dict[str, Items] = {}


def _items(name: str, shared) -> Items:
    if name not in _built:
        _built.clear()
        _built[name] = Items(shared.value)
    return _built[name]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """The benchmark's rows in blocks whose texts have at most `size` bytes together (or one row)."""
    block, held = [], 0
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    for item_id, text in rows.toLocalIterator():
        n = len(text.encode("utf-8", "surrogatepass"))
        if block and held + n > size:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item that it covers: id_col, item_col, coverage, item_words, tiles ("doc:item:length" in words)."""
    spark = docs.sparkSession
    batched(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, coverage double, item_words long, tiles string"

    def search(shared):
        name = uuid.uuid4().hex

        def run(batches):
            items = _items(name, shared)
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in items.hits(t, coverage)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()), (4, pa.int64()), (3, pa.string()))],
                    ["id", "item", "coverage", "item_words", "tiles"],
                )

        return run

    found = None
    for n, block in enumerate(blocks(benchmark, item_col, item_text_col, block_bytes)):
        part = src.mapInArrow(search(spark.sparkContext.broadcast(block)), schema)
        if n % 8 == 7:  # keeps the plan short
            found = materialise(found, "tiled")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that cover no benchmark item, each judged by its own text where it stands: texts aren't shuffled and ids don't matter."""
    spark = docs.sparkSession
    batched(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def keep(shared):
        name = uuid.uuid4().hex

        def run(batches):
            items = _items(name, shared)
            for b in batches:
                yield b.filter(pa.array([not items.hits(t, coverage) for t in b.column(1).to_pylist()], pa.bool_()))

        return run

    for n, block in enumerate(blocks(benchmark, item_col, item_text_col, block_bytes)):
        if n % 8 == 7:
            rows = materialise(rows, "clean")
        rows = rows.mapInArrow(keep(spark.sparkContext.broadcast(block)), rows.schema)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
