"""SimHash near-duplicates over whole documents, with BK-trees over the distinct fingerprints.

Fingerprints are linked when they differ in at most `radius` = 2 bits. Two such fingerprints agree in at least one of three bit
bands, so fingerprints are dealt to shards by each band's leading bits, as many as leave about TREE of them in a shard. In each
shard a BK-tree is built and searched for all of the shard's fingerprints, following only edges within the radius. Trees are
built where their shard is rather than broadcast: every fingerprint would have to visit every broadcast tree, which grows with
the square of the corpus, while by bands it visits three.

Shards above SHARD fingerprints are split by a second banding of the bits outside the band (two fingerprints that agree in one
band and differ in two bits agree in one of three parts of the rest too), and what is still too large is dealt out as tiles of
two blocks, so no task ever gathers an unbounded group and no link is lost.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; one or two
words form one shingle; repeated rows get the same component; an empty table gives an empty result; a null doc_id keeps its
row and is ignored for the smallest doc_id unless a component has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, connected, join_by_share, materialise, union_find

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Distinct fingerprints of a shard's tree: about so many, and at most.
TREE = 512
SHARD = 4096
BANDS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and splits on \x20 \x09-\x0D
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n < SHINGLE:
        return digest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - SHINGLE + 1].tolist()
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id_col, fp): the fingerprint of every row as a signed long; with hashed also text_hash, which tells texts of one id apart."""
    batched(docs.sparkSession)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.xxhash64(text).alias("text_hash")] * hashed)

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["id", "fp", *["text_hash"] * hashed])

    return src.mapInArrow(run, "id long, fp long" + ", text_hash long" * hashed).withColumnRenamed("id", id_col)


class BKTree:
    """A BK-tree over distinct uint64 values: a node is one value, its children are keyed by their integer Hamming distance to it.

    A node is (index of its value, edges to childless nodes, their indices, [(edge, node with children)]).
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        #: Pairs of query and edge that searches followed, and those they left out.
        self.followed = self.skipped = 0
        self.root = self._build(np.arange(len(values))) if len(values) else None

    def _build(self, idx: np.ndarray):
        top: list = []
        work = [(idx, top, 0)]
        while work:
            idx, holder, edge = work.pop()
            pivot, rest = int(idx[0]), idx[1:]
            d = np.bitwise_count(self.values[rest] ^ self.values[pivot])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order].astype(np.int16)
            cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]])) if len(d) else np.zeros(1, np.int64)
            sizes = np.diff(cuts)
            alone = cuts[:-1][sizes == 1]
            node: tuple = (pivot, d[alone], rest[alone], [])
            holder.append((edge, node))
            work += [(rest[a : a + n], node[3], int(d[a])) for a, n in zip(cuts[:-1].tolist(), sizes.tolist()) if n > 1]
        return top[0][1]

    def pairs(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices (query, value) of all pairs within the radius; all queries descend together."""
        found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        work = [(self.root, np.arange(len(queries)))] if self.root else []
        while work:
            (pivot, edges, leaves, children), q = work.pop()
            d = np.bitwise_count(queries[q] ^ self.values[pivot]).astype(np.int16)
            hit = q[d <= radius]
            if len(hit):
                found_q.append(hit)
                found_p.append(np.full(len(hit), pivot))
            if len(leaves):
                row, leaf = np.nonzero(np.abs(d[:, None] - edges) <= radius)
                self._count(len(row), len(d) * len(leaves))
                row, leaf = q[row], leaves[leaf]
                same = np.bitwise_count(queries[row] ^ self.values[leaf]) <= radius
                if same.any():
                    found_q.append(row[same])
                    found_p.append(leaf[same])
            for edge, child in children:
                near = q[np.abs(d - edge) <= radius]
                self._count(len(near), len(d))
                if len(near):
                    work.append((child, near))
        return np.concatenate(found_q), np.concatenate(found_p)

    def _count(self, followed: int, of: int) -> None:
        self.followed += followed
        self.skipped += of - followed


def shard_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value of its group) that connect all of a shard's values within the radius."""
    values = np.unique(values)
    q, p = BKTree(values).pairs(values, radius)
    label = union_find(len(values), q, p)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _band(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _sub_bands(band: int) -> list[list[tuple[int, int]]]:
    """The bits outside a band, in three parts; each part is a list of (start, width)."""
    bits = [i for b, (at, w) in enumerate(BANDS) if b != band for i in range(at, at + w)]
    cuts = [0, len(bits) // 3, 2 * len(bits) // 3, len(bits)]
    parts = []
    for a, z in zip(cuts, cuts[1:]):
        runs: list[list[int]] = []
        for i in bits[a:z]:
            if runs and runs[-1][0] + runs[-1][1] == i:
                runs[-1][1] += 1
            else:
                runs.append([i, 1])
        parts.append([(at, w) for at, w in runs])
    return parts


def links(distinct: DataFrame, shard: int = SHARD, tree: int = TREE) -> DataFrame:
    """Links (u, v) among distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    count = distinct.count()
    bits = max(0, (count // tree).bit_length())
    fp = F.col("fp")
    bands = [(i, at, min(width, bits)) for i, (at, width) in enumerate(BANDS)][: None if bits else 1]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), _band(fp, at, width)).alias("key")) for i, at, width in bands])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    total = max(1, count * len(bands))
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    sized = join_by_share(keyed, sizes, "key", "n", total)
    near = sized.filter(F.col("n") <= shard).select("fp", "key", F.lit(0).alias("tile"))
    # dense shards, dealt once more by the bits outside their band
    parts = [F.array(*[F.concat_ws(",", F.lit(j), *[_band(fp, *r).cast("string") for r in p]) for j, p in enumerate(_sub_bands(b))]) for b in range(len(BANDS))]
    part = F.when(F.col("band") == 0, parts[0]).when(F.col("band") == 1, parts[1]).otherwise(parts[2])
    finer = sized.filter(F.col("n") > shard).select("fp", "key", F.explode(part).alias("s")).select("fp", F.xxhash64("key", "s").alias("key"))
    finer = materialise(finer, "dense")
    blocks = F.ceil(F.col("n") * 2 / F.lit(shard)).cast("int").alias("blocks")
    sizes = finer.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", "n", blocks)
    sized = join_by_share(finer, sizes, "key", "n", max(1, finer.count())).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.lit(1 << 15) + F.greatest(j, F.col("block"))))
    shards = near.unionByName(sized.select("fp", "key", tile.alias("tile")))
    return shards.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_search, "u long, v long").distinct()


def _search(batches):
    """One BK-tree after another: rows come sorted by shard, a shard has bounded size, and only the last one is carried over."""
    carry: list[np.ndarray] = []
    last = None

    def flush(parts):
        vals = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return shard_links(vals) if len(vals) > 1 else (vals[:0], vals[:0])

    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        key, tile = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        if not len(fp):
            continue
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0)) + 1
        edges = np.concatenate([[0], cuts, [len(fp)]])
        out_u, out_v = [], []
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if (now := (key[a], tile[a])) != last and carry:
                u, v = flush(carry)
                out_u.append(u)
                out_v.append(v)
                carry = []
            last = now
            carry.append(fp[a:z])
        if out_u:
            yield _pairs(out_u, out_v)
    if carry:
        u, v = flush(carry)
        yield _pairs([u], [v])


def _pairs(u, v):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(id_col).alias("first")), "classes")
    total = prints.count()
    roots = materialise(connected(links(classes.select("fp"), shard)), "roots")
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    sizes = join_by_share(named, least, "root", "members", max(1, total)).select("fp", "n", "component_id")
    out = join_by_share(prints, sizes, "fp", "n", total)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row of docs for each near-duplicate component: one with the smallest id, or with a null id if it has no other.

    Rows are told apart by id and text, so of two texts under one id either may stay; of rows equal in both one stays. Texts
    are shuffled once.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, hashed=True), "simhash")
    lead = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash")).alias("lead")
    classes = materialise(prints.groupBy("fp").agg(lead), "classes")
    roots = materialise(connected(links(classes.select("fp"), shard)), "roots")
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = named.groupBy("root").agg(F.min("lead").alias("lead")).select(F.coalesce("lead.id", F.lit(0)).alias("_id"), F.col("lead.id").isNull().alias("_none"), F.col("lead.text_hash").alias("_hash"))
    kept = materialise(kept, "kept")
    key = ["_id", "_none", "_hash"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_hash"))
    rows = rows.select("row", F.coalesce("i", F.lit(0)).alias("_id"), F.col("i").isNull().alias("_none"), "_hash").repartition(*key)
    one = rows.join(kept, key, "left_semi").dropDuplicates(key)
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
