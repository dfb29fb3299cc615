"""MinHash near-duplicates: documents whose sets of 2-word shingles have a Jaccard similarity of 0.8 or more, by bands of MinHash
values, odd sketches of candidates, and links confirmed on full sets.

*Sets* are those of the n-gram join with 2 words. Documents with equal sets are one class, found by a 128-bit digest; only its
smallest document goes on.

*Samples.* ``SAMPLES`` MinHash values a set. The first ``BANDS`` x ``ROWS`` are banded: two sets with a similarity of 0.8
share no band with a probability of (1 - 0.8^4)^40, below 10^-9. All of them, each with its place, are folded into an odd sketch: a
bitmap of ``BITS`` parities (Mitzenmacher, Pagh, Pham 2014). The xor of two sketches is the odd sketch of the samples in which the
sets differ, so its ones estimate a high similarity. ``most_ones`` is the exact bound that a pair of similarity 0.8 exceeds
with a probability of at most ``RISK``: a chain over the number of ones, over the binomial number of differing samples.

*Candidates.* Band keys are counted, with partial sums before the shuffle, so a key that a third of all documents share is one row
a task. Keys of one document end there. Documents of a key are a list; equal lists, which near copies make in many bands, are one. A
list is searched breadth first by sketches: a document meets those not yet connected, so what is alike costs one pass, and the
components, not pairs, go on. A key of more than ``HUB`` documents is a node that they are connected with, unverified.

*Links.* Components of candidates are the groups in which the exact join of ``ngram_join`` finds links on full sets (in blocks,
where groups are large), so each link within a group counts, also of pairs that no band brought together.

Defined results. A null or empty text, or one without words, has no shingles, links with nothing and is its own component. Rows with a
null id take no part and have a null component and a null ``kept``; ``deduplicate`` tells rows apart by a key of its own. Ties and
repeated rows fall into one class. Only the id and text columns are read. Texts are processed whole. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, input_partitions, keyed, map_arrow, materialise, mix, shielded, ship, slices, table
from .components import connected
from .ngram_join import AGAIN, BLOCK, group_links, packed_texts, runs_of, shingle_sets

SHINGLE, PERCENT = 2, 80
BANDS, ROWS, SAMPLES, BITS, RISK = 40, 4, 320, 512, 1e-9
HUB, SLICE, SALTS, TOGETHER = 4096, 1 << 19, 64, 20_000
_MULTIPLIERS = np.random.default_rng(20260411).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(20260412).integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def minima(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(SAMPLES, sets): the MinHash values of sets (mixed hashes on end, n + 1 offsets), none of them empty."""
    out, held = np.empty((SAMPLES, len(at) - 1), np.uint64), np.empty_like(own)
    for row, m in zip(out, _MULTIPLIERS, strict=True):
        np.multiply(own, m, out=held)
        np.minimum.reduceat(held, at[:-1], out=row)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of each band's values."""
    own = mix(samples[: BANDS * ROWS] + _PLACES[: BANDS * ROWS, None])
    return mix(own.reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64)).T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) words: the parity of the samples that fall on each bit, each sample taken with its place."""
    bit = (mix(samples ^ _PLACES[:, None]) & np.uint64(BITS - 1)).astype(np.int64)
    n = bit.shape[1]
    flips = np.bincount((bit + np.arange(n) * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view(np.uint64).reshape(n, BITS // 64)


def similarity(ones: np.ndarray, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """The estimate of the Jaccard similarity from the ones of two sketches' xor."""
    share = np.minimum(2 * np.asarray(ones, float) / bits, 1 - 1e-12)
    return 1 + bits / (4 * samples) * np.log1p(-share)


@functools.cache
def most_ones(percent: int = PERCENT, samples: int = SAMPLES, bits: int = BITS, risk: float = RISK) -> int:
    """The least number of ones that the xor of two sketches exceeds with a probability of at most ``risk``, at the similarity."""
    differ = 1 - percent / 100
    ones, total = np.zeros(bits + 1), np.zeros(bits + 1)
    ones[0], j = 1.0, np.arange(bits + 1)
    for d in range(samples + 1):  # ones: after 2 d flips, of a bit at random each
        total += ones * math.exp(math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1) + d * math.log(differ) + (samples - d) * math.log1p(-differ))
        for _ in range(2):
            up, down = ones * (bits - j) / bits, ones * j / bits
            ones = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    beyond = np.append(np.cumsum(total[::-1])[::-1][1:], 0.0)  # of more than j ones
    return int(np.flatnonzero(beyond <= risk)[0])


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sig, bands, sketch) of every document: its set's size, digest, band keys and odd sketch; null for an empty set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                own, at = shingle_sets(part.column("text"), k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig, bands, sketch = ([None] * len(n) for _ in range(3))
                if len(full):
                    samples = minima(own, np.append(at[full], at[-1]))
                    for i, keys, words in zip(full.tolist(), band_keys(samples).view(np.int64).tolist(), odd_sketches(samples), strict=True):
                        sig[i], bands[i], sketch[i] = hashlib.blake2b(own[at[i] : at[i + 1]].tobytes(), digest_size=16).digest(), keys, words.tobytes()
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n", "sig", "bands", "sketch"])

    return map_arrow(docs, run, "doc_id long, n long, sig binary, bands array<long>, sketch binary")


def alike(words: np.ndarray, size: np.ndarray, most: int, percent: int) -> np.ndarray:
    """The smallest position that each of n sketches is connected with, by pairs that sketches and sizes do not exclude: breadth
    first, each meeting only those not yet connected."""
    root, left = np.full(len(size), -1), np.arange(len(size))
    while len(left):
        first, left = int(left[0]), left[1:]
        root[first], front = first, [first]
        while front and len(left):
            own = front.pop()
            near = np.bitwise_count(words[left] ^ words[own]).sum(axis=1, dtype=np.int64) <= most
            near &= 100 * np.minimum(size[left], size[own]) >= percent * np.maximum(size[left], size[own])
            root[left[near]] = first
            front += left[near].tolist()
            left = left[~near]
    return root


def candidate_edges(lists: DataFrame, percent: int) -> DataFrame:
    """(list, doc_id, n, sketch) -> (a, b): edges with the components that the lists' sketches make."""
    most = most_ones(percent)

    def run(batches):
        for t in runs_of(batches, "list", TOGETHER):
            key, doc, size = (t.column(c).to_numpy() for c in ("list", "doc_id", "n"))
            words = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            a, b = [], []
            two = at[:-1][np.diff(at) == 2]  # most lists: all at once
            near = np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1, dtype=np.int64) <= most
            near &= 100 * np.minimum(size[two], size[two + 1]) >= percent * np.maximum(size[two], size[two + 1])
            a.append(doc[two[near] + 1])
            b.append(doc[two[near]])
            for lo, hi in itertools.pairwise(at.tolist()):
                if hi - lo > 2:
                    root = alike(words[lo:hi], size[lo:hi], most, percent)
                    led = np.flatnonzero(root != np.arange(hi - lo))
                    a.append(doc[lo + led])
                    b.append(doc[lo + root[led]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_arrow(lists.repartition("list").sortWithinPartitions("list", "doc_id"), run, "a long, b long").distinct()


def candidates(reps: DataFrame, percent: int, hub: int) -> DataFrame:
    """(doc_id, n, bands, sketch) of one document a class -> (a, b): edges that connect all that may link."""
    posted = reps.select("doc_id", F.explode("bands").alias("key"))
    counts = posted.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    met = materialise(posted.join(counts, "key"), "sketch-postings")
    members = met.where(F.col("docs") <= hub).groupBy("key").agg(F.sort_array(F.collect_set("doc_id")).alias("members")).where(F.size("members") > 1)
    lists = members.select("members").distinct().select(F.xxhash64("members").alias("list"), F.explode("members").alias("doc_id")).distinct()
    hubs = met.where(F.col("docs") > hub).select(F.col("doc_id").alias("a"), F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("b"))
    return candidate_edges(lists.join(reps.select("doc_id", "n", "sketch"), "doc_id"), percent).union(hubs)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, hub: int = HUB, block: int = BLOCK, again: int = AGAIN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; the smallest document of a component is kept."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(8, input_partitions(docs))
    with Scratch(docs.sparkSession):
        described = materialise(describe(docs, k), "sketch-docs")
        small = described.select("doc_id", "n", "sig")
        classes = materialise(small.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sketch-classes")
        chosen = classes.select("sig", F.col("rep").alias("doc_id"))
        reps = materialise(described.join(chosen, ["sig", "doc_id"], "left_semi").drop("sig").dropDuplicates(["doc_id", "sketch"]), "sketch-reps")
        groups = connected(candidates(reps, percent, hub))
        texts = materialise(packed_texts(docs, groups), "sketch-texts")
        links = group_links(texts, groups, ranges, k, percent, block, again)

        # Back to all documents, by digest; copies are dealt out over salts.
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
        label = classes.join(links.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"), "rep", "copies")
        salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt("rep")))
        out = small.withColumn("salt", salt("doc_id")).join(label.select("sig", "component_id", F.explode(salts).alias("salt")), ["sig", "salt"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
        return materialise(out, "sketch-components", keep=True)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of near copies, the one with the smallest id (rows without an id come last). Rows are
    told apart by a key of our own, so rows without an id, or that share one, are each joined by their own text."""
    docs, named = shielded(docs, id_col, text_col)
    docs = keyed(docs, "sketch-rows", keep=True)
    component = near_duplicates(docs, id_col="_row", text_col=text_col, k=k, percent=percent).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col("_row"))
    kept = component.join(docs.select("_row", order.alias("order")), "_row").groupBy("component_id").agg(F.min("order")["_row"].alias("_row"))
    return named(docs.join(kept.select("_row").hint("merge"), "_row", "left_semi"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
words AS (SELECT row, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
grams AS (SELECT row, n, i, concat_ws(' ', x, lead(x) OVER (PARTITION BY row ORDER BY i)) AS g FROM words),
held AS (SELECT row, list_sort(list(DISTINCT hash(g))) AS s FROM grams WHERE i < n OR n = 1 GROUP BY row),
sets AS (SELECT doc_id, coalesce(s, []) AS s FROM w LEFT JOIN held USING (row)),
class AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
shingle AS (SELECT rep, len(s) AS n, unnest(s) AS h FROM class),
often AS (SELECT h, count(*) AS f FROM shingle GROUP BY h),
-- Of two sets that link, each has more than four fifths of its shingles in common, so one of its rarest fifth and one.
ranked AS (SELECT rep, n, h, row_number() OVER (PARTITION BY rep ORDER BY f, h) AS i FROM shingle JOIN often USING (h)),
near AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM ranked a JOIN ranked b ON a.h = b.h AND a.rep < b.rep
  WHERE 5 * (a.i - 1) <= a.n AND 5 * (b.i - 1) <= b.n AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
link AS (
  SELECT near.a, near.b FROM near JOIN class x ON x.rep = near.a JOIN class y ON y.rep = near.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, found) AS (SELECT rep, rep FROM class UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.found),
root AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node),
out AS (
  SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(root.component_id, d.doc_id) END AS component_id
  FROM sets d LEFT JOIN class ON class.s = d.s LEFT JOIN root ON root.node = class.rep)
SELECT *, doc_id = component_id AS kept FROM out
"""
