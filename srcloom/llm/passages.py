"""Repeated passages by compact windows over min-hashed word shingles.

A document is a sequence of shingles of SHINGLE = 5 words. Under a hash function the passages of LEAST shingles (50 words) with
the same minimum form a compact window: a node (first, centre, last) of the Cartesian tree over the hashes, first and last being
the starts of its passages. Within a document the windows of two hash functions are joined where their intervals overlap; the
passages of such a joint interval agree in both minima, and documents meet by this pair. FUNCTIONS = 6 functions make three
pairs, so two passages with a Jaccard similarity of 0.8 miss all three with a probability of 0.36 ** 3 at most.

Links between documents under a key are stars, first inside each map task, so a key brings one row a task to the shuffle
however frequent it is, and copies are never expanded into pairs. Stars alone would lose links where the hub shares less than
the others do, so two further ways follow, both over slices (the shingles around a window that met another document):
* equal runs: RUN = 41 equal shingles (45 words) alone make two passages of LEAST shingles similar, whoever the hub is, so
  documents meet by the hash of a run, and a star over such a key holds without verification. Of each LEAST - RUN + 1 runs in a
  row that with the least hash is taken in every document alike, and a passage of LEAST equal shingles always holds one.
* other links are verified by the slices' Jaccard similarity. What fails its hub is compared with all else that met the hub's
  slice, by a prefix filter within that group: of LEAST shingles the LEAST - ENOUGH + 1 rarest of the group can't all be missing
  in a similar passage, and where too few occur in any other slice there is none. This leaves out no pair; only a pair whose
  passages are linked already, directly or through others of the group, isn't compared again.

Edge cases: null, empty and short texts have no windows; repetition inside one document (or under one repeated id) doesn't
count; rows with a null id are left out; equal hashes give one window each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, connected, drop, join_by_share, materialise

SHINGLE = 5
MIN_WORDS = 50
LEAST = MIN_WORDS - SHINGLE + 1
SIMILARITY = 0.8
FUNCTIONS = 6
#: Shared shingles of two passages of LEAST that make them similar, and the equal run that does so alone.
ENOUGH = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * LEAST))
RUN = ENOUGH
#: Slices that are compared with each other at once; larger groups are dealt into tiles, each pair of which is.
TILE = 4096
#: Documents are compared by slices of STRIDE shingles and REACH more on either side, so that a passage around any place of a slice lies within.
STRIDE = 4 * LEAST
REACH = LEAST - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_runs(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[first:end] for arrays of bounds; where a run lies makes no difference."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_P, len(values)), dtype=np.uint64)])
    return _mix((sums[end] - sums[first]) * _power(_PINV, len(values))[first])


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of all texts one after the other, number of shingles of each text)."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    n = np.maximum(0, counts - SHINGLE + 1)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    joined = np.frombuffer(b" ".join(flat), np.uint8)
    lens = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return _hash_runs(joined, starts[first], ends[first + SHINGLE - 1]), n


def _sliding(a: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each window of w values, in linear time."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    pad = -len(a) % w
    blocks = np.concatenate([a, np.full(pad, a[-1], a.dtype)]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


_PLACE = np.uint64(0xFFFF)


def hashed(h: np.ndarray, f: int) -> np.ndarray:
    """Hash function f over a row of shingles in which zeros part the documents: 48 bits of hash above 16 of the position, so that a minimum says where it is."""
    v = _mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) % (1 << 64))) | np.uint64(1 << 16)
    return np.where(h > 0, v & ~_PLACE | np.arange(len(h)).astype(np.uint64) & _PLACE, np.uint64(0))


def compact_windows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, centre): the nodes of the documents' Cartesian trees that span LEAST values or more; their passages of LEAST start at first .. last and have their minimum at centre."""
    low = _sliding(values, LEAST)
    if not len(low):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], len(low)) - 1
    inside = low[first] > 0
    first, last = first[inside], last[inside]
    return first, last, first + (((low[first] & _PLACE).astype(np.int64) - first) & 0xFFFF)


def interval_join(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows of two hash functions that have passages in common; the windows of either are in order and don't overlap."""
    low = np.searchsorted(b[1], a[0], "left")  # the first window of b that ends at or behind a's first passage
    n = np.searchsorted(b[0], a[1], "right") - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]


def windows(ids: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, centre) of all joint windows of a batch: three pairs of hash functions."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) + doc + 1  # a zero before each document, and at the end
    size = len(h) + len(n) + 1
    row, place, owner = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int64)
    row[at] = h | np.uint64(1)
    place[at] = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    owner[at] = ids[doc]
    keys, docs, cs = [], [], []
    for f in range(0, FUNCTIONS, 2):
        v, w = hashed(row, f), hashed(row, f + 1)
        a, b = compact_windows(v), compact_windows(w)
        i, j = interval_join(a, b)
        c = a[2][i]
        keys.append(_mix((v[c] >> np.uint64(16)) + _mix((w[b[2][j]] >> np.uint64(16)) + np.uint64(f + 1))))
        docs.append(owner[c])
        cs.append(place[c])
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(cs)


def runs(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, slice, position) of the equal-run keys of slices: of each LEAST - RUN + 1 runs of RUN shingles in a row that with the least hash."""
    lens = np.array([len(x) for x in own], np.int64)
    if not lens.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    flat = np.concatenate(own).astype(np.uint64)
    starts = np.cumsum(lens) - lens
    n = np.maximum(0, lens - RUN + 1)
    which = np.repeat(np.arange(len(n)), n)
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = starts[which] + rel
    key = np.zeros(n.sum() + len(n) + 1, np.uint64)
    at = np.arange(n.sum()) + which + 1
    key[at] = _hash_runs(flat, first, first + RUN) | np.uint64(1)
    w = LEAST - RUN + 1
    low = _sliding(key, w)
    fill = np.zeros(w - 1, np.uint64)
    chosen = (_sliding(np.concatenate([fill, low, fill]), w, np.maximum) == key) & (key > 0)
    return key[at][chosen[at]], which[chosen[at]], rel[chosen[at]].astype(np.int32)


def _star(key, doc, c):
    """(indices of the first row of each key, indices of the rows of other documents, and for these the first row's)."""
    order = np.lexsort((c, doc, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    hub = order[head][np.cumsum(new) - 1] if len(k) else order
    other = doc[order] != doc[hub]
    return order[head], order[other], hub[other]


def _thin(hub, hub_c, doc, c):
    """The first link for each pair of slices and diagonal."""
    hub_c, c = hub_c.astype(np.int64), c.astype(np.int64)
    order = np.lexsort((c, hub_c // STRIDE, c // STRIDE, hub_c - c, doc, hub))
    hub, hub_c, doc, c = hub[order], hub_c[order], doc[order], c[order]
    new = np.ones(len(hub), bool)
    for x in (hub, doc, hub_c - c, c // STRIDE, hub_c // STRIDE):
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    return hub[new], hub_c[new].astype(np.int32), doc[new], c[new].astype(np.int32)


_ROW = "key long, doc long, c int, hub long, hub_c int"
_LINK = ["hub", "hub_c", "doc", "c"]


def _rows(key, doc, c, hub=None, hub_c=None):
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc), pa.array(c.astype(np.int32)), pa.nulls(n, pa.int64()) if hub is None else pa.array(hub), pa.nulls(n, pa.int32()) if hub is None else pa.array(hub_c.astype(np.int32))],
        ["key", "doc", "c", "hub", "hub_c"],
    )


def _map(batches):
    """Stars within a map task: the first row of each key goes on, the others become links (rows with a hub)."""
    held: list = []
    size = 0

    def flush():
        key, doc, c = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        first, other, hub = _star(key, doc, c)
        for i in range(0, len(first), 100_000):
            p = first[i : i + 100_000]
            yield _rows(key[p], doc[p], c[p])
        h, hc, d, dc = _thin(doc[hub], c[hub], doc[other], c[other])
        if len(h):
            spread = _mix(h.astype(np.uint64) * np.uint64(31) + d.astype(np.uint64) + dc.astype(np.uint64) * np.uint64(1 << 40))
            yield _rows(spread, d, dc, h, hc)

    for got in batches:
        held.append(got)
        size += len(got[0])
        if size > 3_000_000:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def _map_windows(batches):
    def each():
        for b in batches:
            if b.num_rows:
                yield windows(b.column(0).to_numpy(zero_copy_only=False), *shingles(b.column(1).to_pylist()))

    return _map(each())


def _map_runs(batches):
    """Documents meet at the middle of an equal run; of a slice only runs whose middle lies in its own STRIDE count."""

    def each():
        for b in batches:
            if b.num_rows:
                doc, g, lead = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                key, which, rel = runs([np.frombuffer(x, np.uint32) for x in b.column(3).to_pylist()])
                at = rel + RUN // 2 - lead[which]
                own = (at >= 0) & (at < STRIDE)
                yield key[own], doc[which[own]], (g[which[own]] * STRIDE + at[own]).astype(np.int32)

    return _map(each())


def _reduce(batches):
    """Rows come sorted by key: the first document of a key is the hub of the others; ready links pass."""
    hub_key = hub_doc = hub_c = None
    for b in batches:
        if not b.num_rows:
            continue
        key, doc, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        ready = np.asarray(b.column(3).is_valid())
        if ready.any():
            r = b.filter(pa.array(ready))
            yield pa.RecordBatch.from_arrays([r.column(3), r.column(4), r.column(1), r.column(2)], _LINK)
        key, doc, c = key[~ready], doc[~ready], c[~ready]
        if not len(key):
            continue
        new = np.concatenate([[hub_key is None or key[0] != hub_key], key[1:] != key[:-1]])
        heads = np.concatenate([[-1], np.flatnonzero(new)])
        which = heads[np.cumsum(new)]
        h = np.where(which >= 0, doc[which], hub_doc if hub_key is not None else 0)
        hc = np.where(which >= 0, c[which], hub_c if hub_key is not None else 0)
        other = h != doc
        if other.any():
            x = _thin(h[other].astype(np.int64), hc[other].astype(np.int32), doc[other], c[other])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], _LINK)
        hub_key, hub_doc, hub_c = key[-1], h[-1], hc[-1]


def _one_a_pair(found: DataFrame) -> DataFrame:
    """One link (hub, hub_c, doc, c) for each pair of slices and diagonal."""
    cell = lambda x: F.floor(F.col(x) / STRIDE)
    thin = found.groupBy("hub", "doc", (F.col("hub_c") - F.col("c")).alias("diagonal"), cell("c").alias("g"), cell("hub_c").alias("hub_g"))
    return thin.agg(F.min(F.struct("c", "hub_c")).alias("x")).select("hub", "x.hub_c", "doc", "x.c")


def _stars(rows: DataFrame) -> DataFrame:
    """Links (hub, hub_c, doc, c) of rows of _map."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "doc", "c")
    return _one_a_pair(rows.mapInArrow(_reduce, "hub long, hub_c int, doc long, c int"))


def _slices(batches):
    """Rows come sorted by document: of rows with one id the first counts."""
    names = ["doc", "g", "lead", "own"]
    last = None
    for b in batches:
        ids, cells, out = b.column(0).to_pylist(), b.column(2).to_pylist(), []
        h, n = shingles(b.column(1).to_pylist())
        h = (h >> np.uint64(32)).astype(np.uint32)
        start = np.cumsum(n) - n
        for i, wanted in enumerate(cells):
            if ids[i] == last:
                continue
            last = ids[i]
            own = h[start[i] : start[i] + n[i]]
            for g in wanted:
                if g * STRIDE < len(own):
                    lo = max(0, g * STRIDE - REACH)
                    out.append((ids[i], g, g * STRIDE - lo, own[lo : (g + 1) * STRIDE + REACH].tobytes()))
        for i in range(0, len(out), 5000):
            part = out[i : i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names)


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of true values in the rows of a matrix."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    first, second = np.unique(a), np.unique(b)
    both = len(np.intersect1d(first, second, assume_unique=True))
    return both >= SIMILARITY * (len(first) + len(second) - both)


def agreements(a: list[np.ndarray], ca, b: list[np.ndarray], cb) -> list[tuple[int, int, int, int, int]]:
    """Passages on which pairs of slices agree: (pair, start and end in a, start and end in b), ends exclusive; ca and cb are aligned.

    Stretches of a in which each LEAST shingles have ENOUGH in b; a stretch counts if it and its place in b, both of LEAST
    shingles or more, have a Jaccard similarity of SIMILARITY (as a whole, or else at its best LEAST shingles).
    """
    k = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    if not k or la.max() < LEAST:
        return []
    width = max(LEAST, int(la.max()))
    inside = np.arange(width) < la[:, None]
    pair_a, pair_b = np.repeat(np.arange(k, dtype=np.uint64), la) << np.uint64(32), np.repeat(np.arange(k, dtype=np.uint64), lb) << np.uint64(32)
    fa, fb = np.concatenate(a).astype(np.uint64), np.concatenate(b).astype(np.uint64)
    hit = np.zeros((k, width), bool)
    known = np.sort(pair_b | fb)
    mine = pair_a | fa
    hit[inside] = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine if len(known) else False
    sums = np.zeros((k, width + 1), np.int32)
    np.cumsum(hit, axis=1, out=sums[:, 1:])
    good = sums[:, LEAST:] - sums[:, :-LEAST] >= ENOUGH
    good &= np.arange(good.shape[1]) + LEAST <= la[:, None]
    rows, starts, lasts = _spans(good)
    out = []
    for p, x, y in zip(rows.tolist(), starts.tolist(), (lasts + LEAST - 1).tolist()):
        own, other, shift = a[p], b[p], int(cb[p]) - int(ca[p])
        if y - x > LEAST:  # what isn't shared at the ends goes as long as LEAST shingles stay
            shared = hit[p, x:y]
            head, tail = int(shared.argmax()), int(shared[::-1].argmax())
            if y - x - head - tail >= LEAST:
                x, y = x + head, y - tail
        u, v = x + shift, y + shift
        if 0 <= u and v <= len(other) and np.array_equal(own[x:y], other[u:v]):
            out.append((p, x, y, u, v))
            continue
        spot = _place(own, x, y, other, shift)
        if spot is None:  # the best LEAST shingles of the stretch
            inner = sums[p, x + LEAST : y + 1] - sums[p, x : y + 1 - LEAST]
            x += int(np.argmax(inner))
            y = x + LEAST
            spot = _place(own, x, y, other, shift)
        if spot is not None:
            out.append((p, x, y, *spot))
    return out


def _place(own, x, y, other, shift) -> tuple[int, int] | None:
    """Where in other the passage own[x:y] lies, if similar: the part on the diagonal, or that between its first and last shared shingle."""
    u, v = max(0, x + shift), min(len(other), y + shift)
    if v - u >= LEAST and _similar(own[x:y], other[u:v]):
        return u, v
    inside = np.flatnonzero(np.isin(other, own[x:y]))
    if not len(inside):
        return None
    near = inside[np.abs(inside - (shift + (x + y) // 2)) <= y - x]
    near = near if len(near) else inside
    u, v = int(near[0]), int(near[-1]) + 1
    if v - u < LEAST:  # the passage may begin or end with shingles of its own
        u = max(0, min(u, len(other) - LEAST))
        v = min(len(other), u + LEAST)
        u = max(0, v - LEAST)
    return (u, v) if v - u >= LEAST and _similar(own[x:y], other[u:v]) else None


_FOUND = ["hub", "hub_c", "hub_start", "hub_end", "doc", "c", "start", "end"]


def _verify(batches):
    """Rows of the passages on which links agree; a link that doesn't agree gives one row without passages."""
    for b in batches:
        hub, hub_c, hub_lead, hub_own, doc, c, lead, own = (x.to_pylist() for x in b.columns)
        hub_at = [x // STRIDE * STRIDE - y for x, y in zip(hub_c, hub_lead)]  # where the slices begin
        at = [x // STRIDE * STRIDE - y for x, y in zip(c, lead)]
        out, agreed = [], np.zeros(b.num_rows, bool)
        for i in range(0, b.num_rows, 500):
            k = range(i, min(i + 500, b.num_rows))
            found = agreements([np.frombuffer(own[j], np.uint32) for j in k], [c[j] - at[j] for j in k], [np.frombuffer(hub_own[j], np.uint32) for j in k], [hub_c[j] - hub_at[j] for j in k])
            for p, x, y, u, v in found:
                p += i
                agreed[p] = True
                out.append((hub[p], hub_c[p], hub_at[p] + u, hub_at[p] + v + SHINGLE - 1, doc[p], c[p], at[p] + x, at[p] + y + SHINGLE - 1))
        out += [(hub[p], hub_c[p], None, None, doc[p], c[p], None, None) for p in np.flatnonzero(~agreed).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(_FOUND))], _FOUND)


class Group:
    """Slices that met one hub: what failed it is compared with all others.

    docs, blocks and failed have a value a slice; covered has the passages (start, end) on which it agreed with the hub. Of slices
    of different blocks all pairs are compared, of those of one block only if `within`.
    """

    def __init__(self, docs, own: list[np.ndarray], failed, covered: list[list[tuple[int, int]]], blocks, within: bool = True):
        self.docs, self.own, self.failed, self.blocks, self.within = np.asarray(docs), own, np.asarray(failed, bool), np.asarray(blocks), within
        k, lens = len(own), np.array([len(x) for x in own], np.int64)
        self.end = np.cumsum(lens)
        self.start = self.end - lens
        self.owner = np.repeat(np.arange(k), lens)
        _, self.token = np.unique(np.concatenate(own), return_inverse=True)
        self.open = [np.ones(max(0, n - LEAST + 1), bool) for n in lens.tolist()]
        for i in range(k):
            for x, y in covered[i]:
                self._close(i, x, y)
        #: Slices of one root are linked within the group.
        self.root = np.where(self.failed & np.array([not c for c in covered]), np.arange(k) + 1, 0)
        self.alive = np.ones(k, bool)
        good = self._prune()
        kept = np.flatnonzero(self.alive[self.owner])
        self.post = kept[np.argsort(self.token[kept], kind="stable")]
        self.size = np.bincount(self.token[kept], minlength=int(self.token.max(initial=0)) + 1)
        self.first = np.cumsum(self.size) - self.size
        self.good = good

    def _close(self, i, x, y):
        """The passages of LEAST shingles of slice i that have ENOUGH of them within x .. y are linked."""
        self.open[i][max(0, x - LEAST + ENOUGH) : max(0, y - ENOUGH + 1)] = False

    def _prune(self) -> np.ndarray:
        """By place, whether LEAST shingles from there on have ENOUGH in other slices; slices that failed and have no such place go."""
        label = np.where(self.failed, np.arange(len(self.own)) + 1, 0)
        whole = np.arange(len(self.token)) + LEAST <= self.end[self.owner]
        while True:
            live = self.alive[self.owner]
            low = np.full(int(self.token.max(initial=0)) + 1, len(self.own) + 1)
            high = np.full(len(low), -1)
            np.minimum.at(low, self.token[live], label[self.owner[live]])
            np.maximum.at(high, self.token[live], label[self.owner[live]])
            sums = np.concatenate([[0], np.cumsum((high > low)[self.token])])
            good = np.zeros(len(self.token), bool)
            at = np.flatnonzero(whole & live)
            good[at] = sums[at + LEAST] - sums[at] >= ENOUGH
            have = np.zeros(len(self.own), bool)
            have[self.owner[good]] = True
            gone = self.alive & self.failed & ~have
            if not gone.any():
                return good
            self.alive &= ~gone

    def links(self):
        """(i, j, start and end in i, start and end in j), ends exclusive."""
        for i in np.flatnonzero(self.alive & self.failed).tolist():
            yield from self._links(i)

    def _links(self, i):
        others = self.alive & (self.docs != self.docs[i])
        if not self.within:
            others &= self.blocks != self.blocks[i]
        w = np.flatnonzero(self.good[self.start[i] : self.end[i]])
        if not self.open[i][w].any() and (self.root[others] == self.root[i]).all():
            return
        token = self.token[self.start[i] : self.end[i]]
        rank = np.lib.stride_tricks.sliding_window_view(self.size[token], LEAST)[w]
        rare = w[:, None] + np.argpartition(rank, LEAST - ENOUGH, axis=1)[:, : LEAST - ENOUGH + 1]
        places = np.unique(rare)
        n = self.size[token[places]]
        at = np.repeat(places, n)
        post = self.post[np.repeat(self.first[token[places]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        fit = others[self.owner[post]]
        at, post = at[fit], post[fit]
        j = self.owner[post]
        if not len(j):
            return
        shift = post - self.start[j] - at
        pair, times = np.unique(j << 32 | shift + (1 << 31), return_counts=True)
        best = np.lexsort((-times, pair >> 32))  # the most frequent diagonal of each pair
        best = best[np.concatenate([[True], np.diff(pair[best] >> 32) > 0])]
        js, shifts = pair[best] >> 32, (pair[best] & 0xFFFFFFFF) - (1 << 31)
        tried, most = np.zeros(len(js), bool), 1
        later = ~self.failed[js] | (js > i)  # earlier ones have been compared with this slice, but for their passages that were linked by then
        while True:
            still = np.isin(js, j[np.isin(at, rare[self.open[i][w]])])
            todo = np.flatnonzero(~tried & (still | later & (self.root[js] != self.root[i])))
            if not len(todo):
                return
            todo = todo[np.argsort(self.root[js[todo]], kind="stable")]  # some of each root at first, then more
            r = self.root[js[todo]]
            begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            todo = todo[np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r)))) < most]
            tried[todo] = True
            most *= 2
            for k in range(0, len(todo), 500):
                part = todo[k : k + 500]
                for p, x, y, u, v in agreements([self.own[i]] * len(part), np.zeros(len(part), np.int64), [self.own[m] for m in js[part]], shifts[part]):
                    m = int(js[part[p]])
                    self._close(i, x, y)
                    self._close(m, u, v)
                    self.root[self.root == self.root[m]] = self.root[i]
                    yield i, m, x, y, u, v


def _compare(batches):
    """Rows come sorted by group and tile: the links of Group, with the smaller id as the hub."""
    held: list[tuple] = []

    def flush():
        _, a, b = held[0][:3]
        rows = [x[3:] for x in held]
        held.clear()
        docs, at = [r[1] for r in rows], [r[2] for r in rows]
        covered = [[(x["start"] - r[2], x["end"] - SHINGLE + 1 - r[2]) for x in r[4]] for r in rows]
        out = []
        if len(rows) > 1:
            for i, j, x, y, u, v in Group(docs, [np.frombuffer(r[5], np.uint32) for r in rows], [r[3] for r in rows], covered, [r[0] for r in rows], a == b).links():
                one, two = (docs[i], at[i] + x, at[i] + y + SHINGLE - 1), (docs[j], at[j] + u, at[j] + v + SHINGLE - 1)
                out.append(min(one, two) + max(one, two))
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[k : k + 10_000])], ["hub", "hub_start", "hub_end", "doc", "start", "end"])

    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns)):
            if held and held[0][:3] != row[:3]:
                yield from flush()
            held.append(row)
    if held:
        yield from flush()


def _others(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (as those of `links`) between what failed its hub and all else that met the hub's slice."""
    cell = lambda x: F.floor(F.col(x) / STRIDE).cast("int")
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    members = found.groupBy(F.xxhash64("hub", cell("hub_c")).alias("top"), "doc", cell("c").alias("g")).agg(F.max(F.col("start").isNull()).alias("failed"), F.collect_set(span).alias("covered"))
    members = materialise(members, "members")
    sizes = members.groupBy("top").agg(F.count("*").alias("n"), F.max("failed").alias("any")).filter("any AND n > 1").select("top", "n")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = join_by_share(members, sizes, "top", "n", max(1, members.count())).withColumn("block", F.pmod(F.xxhash64("doc"), tiles).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).join(parts, ["doc", "g"])
    rows = rows.select("top", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "doc", (F.col("g") * STRIDE - F.col("lead")).alias("at"), "failed", "covered", "own")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "top", "a", "b").sortWithinPartitions("top", "a", "b", "doc", "at")
    return rows.mapInArrow(_compare, "hub long, hub_start long, hub_end long, doc long, start long, end long")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified links: hub, hub_start, hub_end, doc, start, end; positions in words, ends exclusive."""
    batched(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    near = materialise(_stars(src.mapInArrow(_map_windows, _ROW)), "windows")
    cell = lambda x: F.floor(F.col(x) / STRIDE).cast("int").alias("g")
    wanted = near.select("doc", cell("c")).union(near.select("hub", cell("hub_c"))).groupBy("doc").agg(F.collect_set("g").alias("cells"))
    parts = materialise(src.join(wanted, "doc").sortWithinPartitions("doc").mapInArrow(_slices, "doc long, g int, lead int, own binary"), "slices")
    equal = _stars(parts.mapInArrow(_map_runs, _ROW))
    edges = materialise(_one_a_pair(near.unionByName(equal)), "edges")
    drop(near)
    total = max(1, edges.count())
    at = F.struct("hub", cell("hub_c")).alias("at")
    mine = edges.withColumn("g", cell("c")).join(parts, ["doc", "g"]).select(at, "hub_c", "doc", "c", "lead", "own")
    hubs = edges.groupBy(F.col("hub").alias("doc"), cell("hub_c")).agg(F.count("*").alias("n")).join(parts, ["doc", "g"])
    hubs = materialise(hubs.select(F.struct(F.col("doc").alias("hub"), "g").alias("at"), "n", F.col("doc").alias("hub"), F.col("lead").alias("hub_lead"), F.col("own").alias("hub_own")), "hubs")
    pairs = join_by_share(mine, hubs, "at", "n", total).select("hub", "hub_c", "hub_lead", "hub_own", "doc", "c", "lead", "own")  # a hub slice that many links share goes to them, not they to it
    found = materialise(pairs.mapInArrow(_verify, ", ".join(f"{x} long" for x in _FOUND)), "verified")
    drop(hubs, edges)
    more = materialise(_others(found, parts), "others")
    drop(parts)
    return found.filter("start IS NOT NULL").select("hub", "hub_start", "hub_end", "doc", "start", "end").unionByName(more)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a repeated passage: id_col, class_id (smallest id linked, directly or not), n_links, dup_words, passages ("start:end" in words)."""
    found = links(docs, id_col, text_col)
    pairs = materialise(found.select(F.col("hub").alias("u"), F.col("doc").alias("v")).distinct(), "pairs")
    degree = pairs.groupBy(F.col("u").alias("doc")).agg(F.count("*").alias("n")).union(pairs.groupBy(F.col("v").alias("doc")).agg(F.count("*").alias("n"))).groupBy("doc").agg(F.sum("n").alias("n_links"))
    classes = connected(pairs).select(F.col("node").alias("doc"), F.col("root").alias("class_id"))
    spans = found.select("doc", "start", "end").union(found.select("hub", "hub_start", "hub_end")).distinct()
    # spans that overlap or touch become one: the ends seen so far are folded in order
    fold = "aggregate(array_sort(collect_list(struct(start, end))), CAST(array() AS ARRAY<STRUCT<start:BIGINT,end:BIGINT>>), (o, x) -> CASE WHEN size(o) > 0 AND element_at(o, -1).end >= x.start THEN concat(slice(o, 1, size(o) - 1), array(named_struct('start', element_at(o, -1).start, 'end', greatest(element_at(o, -1).end, x.end)))) ELSE concat(o, array(x)) END)"
    merged = spans.groupBy("doc").agg(F.expr(fold).alias("p"))
    out = merged.join(classes, "doc").join(degree, "doc")
    words = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select(F.col("doc").alias(id_col), "class_id", "n_links", words.alias("dup_words"), text.alias("passages"))
