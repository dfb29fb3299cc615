"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of a threshold or more, by
T-occurrence search.

*Sets.* A-Z are lower-cased, a document's set is its distinct 4-word shingles (the whole sequence for fewer words), each a
64-bit hash. Documents with equal sets are one class, found by a 128-bit digest of the set, and only the class's
smallest document goes on: copies are never paired with each other.

*Candidates.* (1) Shingles are counted over all documents, in 2^32 hash buckets: a task adds up what it has read, and sends
packed (bucket, count) runs that executors merge range by range, so a shingle that all documents have is one number a
task; the ``HOT`` most frequent buckets (a table of fixed size) are broadcast. (2) Sets are ordered by
that frequency and hash. Two sets with the required overlap share one of the first n - T + 1 shingles of each, T being
the overlap that n requires at least; these are posted, rare ones first, so that what is common to many documents is posted only by
those that consist of little else. (3) Postings are packed, merged range by range, and end there if no other of their
list is in reach by size (in a list of two, also by the shingle's places in the two orders). A shingle that more than
``HUB`` documents have is no list: it is a node of its own, which the documents that post it are connected with. So is a list
of more than ``HUB`` postings that the table of frequent buckets missed; it has at most a ``HOT``-th of all shingles.
(4) Within a list, a pair is dropped if sizes alone exclude the overlap, or a parity bitmap does: the bitmaps of two sets
differ in no more bits than the sets in shingles. The bitmap grows with the set. What is left is close to the links; it
is not emitted in pairs, but as the components that a list's pairs make (a document and the smallest one connected).

*T-occurrence search.* The components of these candidates are groups: documents of different groups cannot link. Texts of
documents in groups meet (told apart from the others by a broadcast sieve of at most 2^``SIEVE_BITS`` bits, before the join), and within a group (many small ones at a time) the exact join is DivideSkip (Li, Lu, Lu 2008),
at every size: of a document's inverted lists, cut to the documents in reach by size, the L longest are set aside; the others are
heap-merged, and documents on at least T - L of them are probed for in the long lists by binary search, keeping those that
reach the overlap that both sizes require. Since a task's links leave it as the components they make, a document is not
searched for again where it is connected with the searching one already: at first the nearest in size on each of the merged lists
is probed for, and what these connect is left out of the merge. ``divide_skip`` on its own finds every link.

*Large groups* (more than ``BLOCK`` documents) are dealt out to blocks, each with the same few ``PIVOTS`` of the group, and
joined block by block; copies of one text come together through the pivots. What is still apart is joined once more, in blocks of ``AGAIN``:
the documents of small components, in pooled blocks, with every block of the group, and large components with each
other. Two documents already connected are never compared again, so a group of near copies costs in
proportion to its size, and only what does not connect is compared block by block.

Shared folder tables cut the lineage between steps, and are deleted once the result is written. The driver sees only the
table of frequent buckets.

Defined results. A null or empty text, or one without words, has no shingles, links with nothing and is its own component.
Rows with a null id take no part and have a null component. Rows that repeat an id count as one node where they are their
class's smallest. Ties and repeated rows fall into one class. Only the id and text columns are read. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, input_partitions, keyed, map_arrow, materialise, mix, ragged, release_memory, segments, shielded, ship, slices, table, text_bytes, word_hashes, word_spans
from .components import connected, local_roots

SHINGLE, PERCENT = 4, 85
STAGE_SHINGLE, STAGE_PERCENT = 5, 80  # of the pipeline's stage
HOT, HOT_LEAST, HUB, BLOCK, AGAIN, PIVOTS, SLICE, CHUNK, SALTS = 1 << 18, 16, 4096, 256, 1024, 8, 1 << 19, 1 << 20, 16
BITMAPS = ((600, 512), (2400, 2048), (9600, 8192), (1 << 62, 32768))  # up to so many shingles, so many bits
PAIRS, COUNTED, PROBED, SIEVE_BITS, SKIP_MU = 1 << 18, 1 << 20, 16, 28, 0.0085
_TERMS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def overlap_least(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The overlap that a set of n needs with any other to link."""
    return -(-percent * n // 100)


def overlap_required(a, b, percent: int = PERCENT):
    """Least overlap o with 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


# ---------------------------------------------------------------- sets


def shingle_sets(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(each text's distinct shingles in order of hash, on end, n + 1 offsets)."""
    data, offsets = text_bytes(col)
    starts, ends, words = word_spans(data, offsets)
    h = word_hashes(data, starts, ends, fold_case=True)
    n = np.diff(words)
    short = (n > 0) & (n < k)
    count = np.where(n >= k, n - k + 1, short.astype(np.int64))
    at = segments(count)
    first = ragged(words[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    total = size.astype(np.uint64) * _TERMS[-1]
    for i in range(k):
        has = size > i
        total[has] += h[first[has] + i] * _TERMS[i % len(_TERMS)] ^ np.uint64(i)
    total = mix(total)
    for a, b in itertools.pairwise(at.tolist()):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[at[:-1][count > 0]] = True
    kept = np.zeros(len(total) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return total[new], kept[at]


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the set's hashes in each of so many bits as its size asks for."""
    bits = next(b for most, b in BITMAPS if len(hashes) <= most)
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def fold(rows: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (as words) of fewer bits from bitmaps of more."""
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, bits // 64), axis=1)


# ---------------------------------------------------------------- packed columns


def pack(values: np.ndarray, *, gaps: bool = False) -> bytes:
    """Integers as bytes of equal weight on end, compressed; gaps: of a sorted column."""
    import zstandard

    if gaps and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack(data: bytes, kind: str, *, gaps: bool = False) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if gaps else values


# ---------------------------------------------------------------- candidates


def frequent_buckets(docs: DataFrame, k: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the HOT buckets with the most documents, by bucket."""

    def runs_from(held: list[np.ndarray]) -> pa.RecordBatch:
        b, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(b, (np.arange(1, ranges) << 32) // ranges)
        runs = [(i, *x) for i, x in enumerate(zip(np.split(b, cuts), np.split(n.astype(np.uint32), cuts), strict=True)) if len(x[0])]
        return pa.record_batch([pa.array([x[0] for x in runs], pa.int32()), *(pa.array(c, pa.binary()) for c in ([pack(x[1], gaps=True) for x in runs], [pack(x[2]) for x in runs]))], names=["range", "run", "counts"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                held.append((shingle_sets(part.column("text"), k)[0] >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
                if size >= COUNTED:
                    yield runs_from(held)
                    held, size = [], 0
        if size:
            yield runs_from(held)

    def merge(runs: pd.DataFrame) -> pd.DataFrame:
        b, n = (np.concatenate(x) for x in ([unpack(x, "u4", gaps=True) for x in runs["run"]], [unpack(x, "u4") for x in runs["counts"]]))
        order = np.argsort(b, kind="stable")
        b, n = b[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        n = np.add.reduceat(n, at)
        often = n >= HOT_LEAST
        release_memory()
        return pd.DataFrame({"bucket": b[at][often].astype(np.int64), "n": n[often]})

    runs = map_arrow(docs.select("text"), count, "range int, run binary, counts binary")
    hot = runs.groupBy("range").applyInPandas(merge, "bucket long, n long").orderBy(F.desc("n"), "bucket").limit(HOT).toPandas().sort_values("bucket")
    return hot["bucket"].to_numpy(np.uint32), hot["n"].to_numpy(np.int64)


def describe(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], k: int, percent: int, hub: int) -> DataFrame:
    """(doc_id, n, sig, prefix, posted, hubs, bits): of every document its set's size and digest, the posted shingles and
    their number, the nodes of those that more than ``hub`` documents have, and the bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        buckets, counts = held.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                own, at = shingle_sets(part.column("text"), k)
                b = (own >> np.uint64(32)).astype(np.uint32)
                seat = np.minimum(np.searchsorted(buckets, b), max(0, len(buckets) - 1))
                freq = np.where(buckets[seat] == b, counts[seat], 0) if len(buckets) else np.zeros(len(own), np.int64)
                often = np.concatenate([[0], np.cumsum(freq > 0)])
                n = np.diff(at)
                ends = n - overlap_least(n, percent) + 1
                sig, prefix, posted, hubs, bits = [], [], [], [], []
                for (a, z), p in zip(itertools.pairwise(at.tolist()), ends.tolist(), strict=True):
                    s, nodes = own[a:z], None
                    if often[z] > often[a]:  # the rare ones first, each kind by hash
                        order = np.argsort(freq[a:z], kind="stable")[:p]
                        shared = freq[a:z][order] > hub
                        s, nodes = s[order[~shared]], node_of(s[order[shared]]).tolist()
                    else:
                        s = s[:p]
                    full = z > a
                    sig.append(hashlib.blake2b(own[a:z].tobytes(), digest_size=16).digest() if full else None)
                    prefix.append(s.tobytes() if full else None)
                    posted.append(len(s) if full else 0)
                    hubs.append(nodes or None)
                    bits.append(bitmap(own[a:z]) if full else None)
                columns = [part.column("doc_id"), pa.array(n), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary()), pa.array(posted, pa.int32()), pa.array(hubs, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "n", "sig", "prefix", "posted", "hubs", "bits"])

    return map_arrow(docs, run, "doc_id long, n long, sig binary, prefix binary, posted int, hubs array<long>, bits binary")


def node_of(shingles: np.ndarray) -> np.ndarray:
    """Nodes of frequent shingles among those of documents, which are not negative."""
    return (shingles | np.uint64(1 << 63)).view(np.int64)


def worth_keeping(key: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of postings by (list, size): those with another of their list in reach. Sizes alone exclude a posting when its
    neighbours by size are too small or too large. In a list of two, so may the places of the shingle in the two sets'
    order: what precedes both, the shingle, and what follows both bound the overlap."""
    same = key[1:] == key[:-1]
    near = same & (100 * size[:-1] >= percent * size[1:])
    alone = np.concatenate([[True], ~same])  # starts of lists
    starts = np.flatnonzero(alone)
    two = starts[np.diff(np.append(starts, len(key))) == 2]
    a, b = two, two + 1
    bound = np.minimum(place[a], place[b]) + 1 + np.minimum(size[a] - place[a], size[b] - place[b]) - 1
    near[two[bound < overlap_required(size[a], size[b], percent)]] = False
    return np.concatenate([[False], near]) | np.concatenate([near, [False]])


def shared_lists(reps: DataFrame, ranges: int, percent: int, hub: int) -> DataFrame:
    """(list, doc_id, node) of postings with another of their list in reach; of a list of more than ``hub``, the node that
    stands for it."""

    def post(batches):
        for batch in batches:
            doc_ids, n, posted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "posted"))
            if not len(posted):
                continue
            # Sets without frequent shingles post their least hashes, so lists are dealt out by another hash.
            keys = mix(np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64))
            doc = np.repeat(np.arange(len(posted)), posted)
            place = np.arange(len(doc)) - segments(posted)[:-1][doc]
            order = np.argsort(keys, kind="stable")
            keys, doc, place = keys[order], doc[order], place[order]
            cuts = np.searchsorted(keys, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64))
            runs = [(i, *x) for i, x in enumerate(zip(np.split(keys, cuts), np.split(doc, cuts), np.split(place, cuts), strict=True)) if len(x[0])]
            packed = [pa.array([f(x) for x in runs], pa.binary()) for f in (lambda x: pack(x[1], gaps=True), lambda x: pack(doc_ids[x[2]]), lambda x: pack(n[x[2]].astype(np.uint32)), lambda x: pack(x[3].astype(np.uint32)))]
            yield pa.record_batch([pa.array([x[0] for x in runs], pa.int32()), *packed], names=["range", "keys", "docs", "sizes", "places"])

    def merge(runs: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x, "u8", gaps=True) for x in runs["keys"]])
        docs = np.concatenate([unpack(x, "i8") for x in runs["docs"]])
        size, place = (np.concatenate([unpack(x, "u4") for x in runs[c]]).astype(np.int64) for c in ("sizes", "places"))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        some = some[np.lexsort((size[some], keys[some]))]
        some = some[worth_keeping(keys[some], size[some], place[some], percent)] if len(some) else some
        keys, docs = keys[some], docs[some]
        _, which, length = np.unique(keys, return_inverse=True, return_counts=True)
        long = length[which] > hub
        release_memory()
        return pd.DataFrame({"list": keys.view(np.int64), "doc_id": docs, "node": pd.arrays.IntegerArray(node_of(keys), ~long)})

    runs = map_arrow(reps.select("doc_id", "n", "prefix", "posted"), post, "range int, keys binary, docs binary, sizes binary, places binary")
    return runs.groupBy("range").applyInPandas(merge, "list long, doc_id long, node long")


def possible_pairs(size: np.ndarray, maps: list[bytes], at: np.ndarray, percent: int = PERCENT):
    """Pairs (i, j) of rows of one list that sizes and bitmaps do not exclude; at: offsets of the lists. In parts."""
    level = np.searchsorted([most for most, _ in BITMAPS], size)
    folded, rows_of = [], []
    for depth, (_, bits) in enumerate(BITMAPS):  # every row in its own bitmap's size and all smaller ones
        rows = np.flatnonzero(level >= depth)
        words = np.zeros((len(rows), bits // 64), np.uint64)
        for lv in np.unique(level[rows]):
            own = np.flatnonzero(level[rows] == lv)
            words[own] = fold(np.frombuffer(b"".join(maps[i] for i in rows[own].tolist()), np.uint64).reshape(len(own), -1), bits)
        seat = np.zeros(len(size), np.int64)
        seat[rows] = np.arange(len(rows))
        folded.append(words)
        rows_of.append(seat)
    place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))  # each row pairs with those before it in its list
    upto = segments(place)
    a = 0
    while a < len(place):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1)
        j = np.repeat(np.arange(a, z), place[a:z])
        i = ragged(np.arange(a, z) - place[a:z], place[a:z])
        both = size[i] + size[j]
        keep = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j, both = i[keep], j[keep], both[keep]
        most = both - 2 * overlap_required(size[i], size[j], percent)
        depth_of = np.minimum(level[i], level[j])
        for depth, (words, seat) in enumerate(zip(folded, rows_of, strict=True)):
            some = np.flatnonzero(depth_of >= depth)
            if not len(some):
                break
            apart = np.bitwise_count(words[seat[i[some]]] ^ words[seat[j[some]]]).sum(axis=1, dtype=np.int64)
            keep = np.ones(len(i), bool)
            keep[some[apart > most[some]]] = False
            i, j, most, depth_of = i[keep], j[keep], most[keep], depth_of[keep]
        yield i, j
        a = z


def runs_of(batches, key: str, most: int, weight=None):
    """Record batches sorted by key, as tables that end where a key ends and weigh about ``most`` (a heavier key is a table of
    its own). weight: of every row of a table; one by default."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        parts = [x for x in (held, pa.Table.from_batches([batch]) if batch is not None else None) if x is not None]
        if not parts:
            return
        whole = pa.concat_tables(parts)
        keys = whole.column(key).to_numpy()
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # of keys that are complete
        if batch is None:
            ends = np.append(ends, len(keys))
        upto = np.concatenate([[0], np.cumsum(weight(whole) if weight else np.ones(len(keys), np.int64))])
        at = 0
        while len(left := ends[ends > at]) and (batch is None or upto[left[-1]] - upto[at] >= most):
            fit = left[upto[left] - upto[at] <= most]
            to = int(fit[-1] if len(fit) else left[0])
            yield whole.slice(at, to - at)
            at = to
        held = whole.slice(at) if at < len(keys) else None


def _stars(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Edges (a, b) between rows of documents, as edges from each document to the smallest connected."""
    ids, own = np.unique(doc, return_inverse=True)
    root = local_roots(own[a], own[b], len(ids))
    led = np.flatnonzero(root != np.arange(len(ids)))
    return pa.record_batch([pa.array(ids[led]), pa.array(ids[root[led]])], names=["a", "b"]) if len(led) else None


def candidate_edges(lists: DataFrame, percent: int) -> DataFrame:
    """(list, doc_id, n, bits) -> (a, b): edges with the components that possible pairs make."""

    def run(batches):
        for t in runs_of(batches, "list", 20_000):
            key, doc, size = (t.column(c).to_numpy() for c in ("list", "doc_id", "n"))
            at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            for i, j in possible_pairs(size, t.column("bits").to_pylist(), at, percent):
                if len(i) and (edges := _stars(doc, i, j)) is not None:
                    yield edges

    return map_arrow(lists.repartition("list").sortWithinPartitions("list", "doc_id"), run, "a long, b long").distinct()


# ---------------------------------------------------------------- T-occurrence search


class Forest:
    """Which of n positions are connected: the smallest position connected with each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[a]))
        self.root[np.isin(self.root, roots)] = roots[0]

    def apart(self, a: int, others: np.ndarray) -> np.ndarray:
        return self.root[others] != self.root[a]


class InvertedLists:
    """Inverted lists of sets (hashes on end, n + 1 offsets), each in order of its documents' places by size."""

    def __init__(self, own: np.ndarray, at: np.ndarray):
        n = np.diff(at)
        self.n = len(n)
        self.rank = np.lexsort((np.arange(len(n)), n))  # documents by size
        self.size = n[self.rank]
        self.place = np.empty(len(n), np.int64)
        self.place[self.rank] = np.arange(len(n))
        docs = np.repeat(self.place, n)
        order = np.lexsort((docs, own))
        key = own[order]
        number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.postings = number * self.n + docs[order]  # in order: by list, then by place
        self.list_of = np.empty(len(own), np.int64)  # of every element of the sets
        self.list_of[order] = number

    def within(self, lists: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each list's postings of places from low to below high."""
        return np.searchsorted(self.postings, lists * self.n + low), np.searchsorted(self.postings, lists * self.n + high)

    def on_lists(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        """On how many of the lists each place is: binary probes."""
        wanted = lists[:, None] * self.n + places
        seat = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
        return (self.postings[seat] == wanted).sum(axis=0)


def probe(lists: InvertedLists, aside: np.ndarray, cand: np.ndarray, count: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Of the candidates, found ``count`` times so far, those that the lists set aside bring to what each asks for."""
    for k in range(0, len(aside), PROBED):
        alive = count + (len(aside) - k) >= asks
        if not alive.all():
            cand, count, asks = cand[alive], count[alive], asks[alive]
            if not len(cand):
                break
        count = count + lists.on_lists(aside[k : k + PROBED], cand)
    return cand[count >= asks]


def divide_skip(own: np.ndarray, at: np.ndarray, percent: int = PERCENT, forest: Forest | None = None):
    """Links (i, j) among sets (hashes on end, n + 1 offsets): for every set, the others that occur often enough
    on its shingles' inverted lists. Sets by size and place: a set is searched among those before it. With a forest (of the
    sets by place), sets connected with the searching one already are not searched for, and links connect."""
    lists = InvertedLists(own, at)
    n = np.diff(at)
    needs, lows = overlap_least(n, percent), np.searchsorted(lists.size, overlap_least(n, percent))
    for q in lists.rank[n[lists.rank] > 0].tolist():
        me, need = int(lists.place[q]), int(needs[q])
        mine = lists.list_of[at[q] : at[q + 1]]
        start, end = lists.within(mine, int(lows[q]), me)
        length = end - start
        some = np.flatnonzero(length)
        if len(some) < need:
            continue
        some = some[np.argsort(length[some], kind="stable")]
        mine, start, end, length = mine[some], start[some], end[some], length[some]
        long = min(need - 1, int(need / (SKIP_MU * np.log2(length[-1] + 1) + 1)))
        few, aside = len(mine) - long, mine[len(mine) - long :]
        short = [lists.postings[a:z] % lists.n for a, z in zip(start[:few].tolist(), end[:few].tolist(), strict=True)]
        if forest is not None:
            near = np.unique([x[-1] for x in short])
            near = near[forest.apart(me, near)]
            hit = probe(lists, mine, near, np.zeros(len(near), np.int64), overlap_required(n[q], lists.size[near], percent))
            if len(hit):
                forest.join(me, hit)
                yield np.full(len(hit), q), lists.rank[hit]
            short = [x[forest.apart(me, x)] for x in short]
        merged = heapq.merge(*(x.tolist() for x in short if len(x)))
        found = [(d, c) for d, g in itertools.groupby(merged) if (c := sum(1 for _ in g)) >= need - long]
        if not found:
            continue
        cand, count = np.array(found, np.int64).T
        hit = probe(lists, aside, cand, count, overlap_required(n[q], lists.size[cand], percent))
        if len(hit):
            if forest is not None:
                forest.join(me, hit)
            yield np.full(len(hit), q), lists.rank[hit]


def true_edges(grouped: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """(grp, doc_id, packed text) -> (a, b): edges with the components that links make."""
    import zstandard

    def run(batches):
        for t in runs_of(batches, "grp", CHUNK, lambda t: pc.binary_length(t.column("text")).to_numpy().astype(np.int64) + 200):
            doc = t.column("doc_id").to_numpy()
            open_ = zstandard.ZstdDecompressor().decompress
            texts = pa.array([open_(x).decode() for x in t.column("text").to_pylist()], pa.large_string())
            sets, sizes = [], []
            for part in slices(pa.record_batch([texts], names=["text"]), "text", SLICE):
                own, at = shingle_sets(part.column("text"), k)
                sets.append(own)
                sizes.append(np.diff(at))
            links = list(divide_skip(np.concatenate(sets), segments(np.concatenate(sizes)), percent, Forest(len(doc))))
            if links and (edges := _stars(doc, np.concatenate([i for i, _ in links]), np.concatenate([j for _, j in links]))) is not None:
                yield edges

    return map_arrow(grouped.repartition(parts, "grp").sortWithinPartitions("grp", "doc_id"), run, "a long, b long").distinct()


class Sieve:
    """A set of ids in so many bits, by two hashes: it holds all that were put in, and few others."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def seats(self, ids: np.ndarray) -> np.ndarray:
        own = ids.astype(np.int64).view(np.uint64)
        return np.concatenate([mix(own * np.uint64(2) + np.uint64(i)) & np.uint64(self.bits - 1) for i in (0, 1)])

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.seats(ids)
        found = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found[: len(ids)] & found[len(ids) :]


def sieve_of(nodes: DataFrame) -> Sieve:
    """A sieve of the nodes (node), of SIEVE_BITS bits at most however many there are: with very many it lets more pass."""
    n = nodes.count()
    sieve = Sieve(1 << max(16, min(SIEVE_BITS, (12 * n).bit_length())))
    part = min(sieve.bits, 1 << 19)  # bits that one row has

    def put(batches):
        for batch in batches:
            at = np.unique(sieve.seats(batch.column("node").to_numpy(zero_copy_only=False)))
            which = (at // np.uint64(part)).astype(np.int64)
            for x in np.unique(which).tolist():
                own = np.zeros(part, np.uint8)
                own[(at[which == x] % np.uint64(part)).astype(np.int64)] = 1
                yield pa.record_batch([pa.array([x]), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"][:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]]).tobytes()]})

    for row in map_arrow(nodes.select("node"), put, "part long, bits binary").groupBy("part").applyInPandas(both, "part long, bits binary").toLocalIterator():
        sieve.words[row["part"] * part // 64 : (row["part"] + 1) * part // 64] = np.frombuffer(row["bits"], np.uint64)
    return sieve


def packed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, packed text) of the documents among the nodes, and of few others: only these are shuffled."""
    import zstandard

    held = docs.sparkSession.sparkContext.broadcast(sieve_of(nodes))

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            batch = batch.filter(pa.array(held.value.has(batch.column("doc_id").to_numpy(zero_copy_only=False))))
            yield pa.record_batch([batch.column("doc_id"), pa.array([press((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "text"])

    return map_arrow(docs, run, "doc_id long, text binary")


# ---------------------------------------------------------------- the join


def group_links(texts: DataFrame, groups: DataFrame, parts: int, k: int, percent: int, block: int, again: int) -> DataFrame:
    """texts (doc_id, packed text) and groups (node, component) -> (node, component) of the links within groups."""
    large = groups.groupBy("component").count().where(F.col("count") > block).select("component", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    large = materialise(large, "ngram-large")
    dealt = groups.join(large, "component", "left")
    small = dealt.where("nb IS NULL").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))
    if large.isEmpty():
        return connected(true_edges(texts.join(small, "doc_id"), parts, k, percent))

    big = materialise(dealt.where("nb IS NOT NULL"), "ngram-dealt")
    own = big.select("node", F.xxhash64("component", F.pmod(F.xxhash64("node"), "nb")).alias("grp"))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    pivots = big.withColumn("n", first).where(F.col("n") <= PIVOTS).select("node", "component", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("b"))
    once = own.union(pivots.select("node", F.xxhash64("component", "b"))).distinct().withColumnRenamed("node", "doc_id")
    inside = materialise(true_edges(texts.join(small.union(once), "doc_id"), parts, k, percent), "ngram-links")
    so_far = connected(inside).withColumnRenamed("component", "label")

    # Blocks again, now by what is connected: large components have blocks of their own, small ones share blocks.
    labelled = materialise(big.join(so_far, "node", "left").select("node", "component", F.coalesce("label", "node").alias("label")), "ngram-labels")
    counts = labelled.groupBy("component", "label").count()
    pool = counts.where(F.col("count") <= again // 2).groupBy("component").agg(F.ceil(F.sum("count") / again).cast("int").alias("pb"))
    seated = labelled.join(counts, ["component", "label"]).join(pool, "component", "left")
    pooled = F.col("count") <= again // 2
    seat = F.when(pooled, F.xxhash64("component", F.pmod(F.xxhash64("label"), "pb"))).otherwise(F.xxhash64("component", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / again))))
    seated = materialise(seated.select("node", "component", F.when(~pooled, F.col("label")).alias("label"), seat.alias("seat")), "ngram-seats")
    seats = materialise(seated.select("component", "label", "seat").distinct(), "ngram-blocks")
    shared, whole = seats.where("label IS NULL").select("component", F.col("seat").alias("x")), seats.where("label IS NOT NULL")
    pairs = shared.join(seats.select("component", F.col("seat").alias("y")), "component").select("component", "x", "y")
    names = whole.select("component", "label").distinct()
    two = names.join(names.select("component", F.col("label").alias("other")), "component").where("label < other")
    pairs = pairs.union(two.join(whole, ["component", "label"]).withColumnRenamed("seat", "x").join(whole.select("component", F.col("label").alias("other"), F.col("seat").alias("y")), ["component", "other"]).select("component", "x", "y"))
    pairs = pairs.select(F.explode(F.array("x", "y")).alias("seat"), F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("grp")).distinct()
    met = seated.select(F.col("node").alias("doc_id"), "seat").join(pairs, "seat").select("doc_id", "grp")
    return connected(inside.union(true_edges(texts.join(met, "doc_id"), parts, k, percent)))


def join_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(8, input_partitions(docs))
    with Scratch(spark):
        hot = frequent_buckets(docs, k, ranges)
        described = materialise(describe(docs, hot, k, percent, HUB), "ngram-docs")
        small = described.select("doc_id", "n", "sig")
        classes = materialise(small.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
        chosen = classes.select(F.col("sig"), F.col("rep").alias("doc_id"))

        reps = described.join(chosen, ["sig", "doc_id"], "left_semi")
        lists = materialise(shared_lists(reps, ranges, percent, HUB), "ngram-lists")
        sizes = described.select("doc_id", "n", "bits", "sig").join(chosen, ["sig", "doc_id"], "left_semi").drop("sig")
        hubs = described.where("hubs IS NOT NULL").join(chosen, ["sig", "doc_id"], "left_semi").select(F.col("doc_id").alias("a"), F.explode("hubs").alias("b"))
        hubs = hubs.union(lists.where("node IS NOT NULL").select("doc_id", "node"))
        pairs = lists.where("node IS NULL").select("list", "doc_id").join(sizes, "doc_id")
        groups = connected(candidate_edges(pairs, percent).union(hubs))

        texts = materialise(packed_texts(docs, groups), "ngram-texts")
        links = group_links(texts, groups, ranges, k, percent, BLOCK, AGAIN)

        # Back to all documents, by digest; copies are dealt out over salts.
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
        label = classes.join(links.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"), "rep", "copies")
        salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt("rep")))
        label = label.select("sig", "component_id", F.explode(salts).alias("salt"))
        out = small.withColumn("salt", salt("doc_id")).join(label, ["sig", "salt"], "left")
        return materialise(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "ngram-components", keep=True)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def dedupe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near copies (5-word shingles, 80 % or more), the one with the smallest id (rows without an id
    come after the others). Rows are told apart by a key of the stage's own, so rows without an id, or that share one, are each joined by their own text."""
    docs, named = shielded(docs, "doc_id", "text")
    docs = keyed(docs, "dedupe-rows", keep=True)
    component = join_components(docs, id_col="_row", k=STAGE_SHINGLE, percent=STAGE_PERCENT).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    ids = docs.select("_row", order.alias("order"))
    kept = component.join(ids, "_row").groupBy("component_id").agg(F.min("order")["_row"].alias("_row"))
    # A sort-merge join at every size: what is kept grows with the rows.
    return named(docs.join(kept.select("_row").hint("merge"), "_row", "left_semi"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
words AS (SELECT row, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
grams AS (
  SELECT row, n, i, concat_ws(' ', x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p) AS g FROM words WINDOW p AS (PARTITION BY row ORDER BY i)),
held AS (SELECT row, list_sort(list(DISTINCT hash(g))) AS s FROM grams WHERE i <= n - 3 OR (n < 4 AND i = 1) GROUP BY row),
sets AS (SELECT doc_id, coalesce(s, []) AS s FROM w LEFT JOIN held USING (row)),
class AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
shingle AS (SELECT rep, len(s) AS n, unnest(s) AS h FROM class),
pair AS (SELECT a.rep AS a, b.rep AS b, count(*) AS o, any_value(a.n + b.n) AS n FROM shingle a JOIN shingle b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM pair WHERE 100 * o >= 85 * (n - o)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, found) AS (SELECT rep, rep FROM class UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.found),
root AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(root.component_id, d.doc_id) END AS component_id
FROM sets d LEFT JOIN class ON class.s = d.s LEFT JOIN root ON root.node = class.rep
"""
