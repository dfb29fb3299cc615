"""Target-distribution importance resampling: documents are drawn without replacement, with odds that follow how much likelier their
words are under a target corpus than under all documents.

*Weights.* Features are a text's words and pairs of neighbouring words, hashed into ``BUCKETS`` buckets by crc32. The checksum of a pair
follows from those of its words: the first one's, shifted by the second one's length (a linear map, as four small tables a
length), xor the second one's. So each distinct word of a slice is hashed once and everything else is array work. Tasks add up
their buckets before the shuffle; the driver sees one number a bucket. A document's weight is the floored mean gain of its features.

*Draw.* A score is the weight plus Gumbel noise of the id, so the highest scores are the draw. Scores are whole numbers in a range
that doubles bound, so documents are counted by score exactly; that gives the draw's size, the score it ends in, and ranges of
about ``RANGE`` documents (a score that has more of them is parted by id). Each task sorts what reaches the cut into runs
of at most ``RUN`` rows, stored range by range; rows alike in score, id and length are one entry with their number. A tournament tree
(a loser tree) of a range's runs emits its entries in order, and stops at the exact draw count.

Defined results. A null or empty text, or one without words, has no features, weight 0 and too few words to be drawn. A row without an id
has no noise, so a null score, and takes no part in the draw. Rows that share an id are drawn each; those alike in score and
id are ranked by n_features, then in any order. A null text of the target counts as empty; with an empty target, its
buckets count 0. Columns other than the id and the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, materialise, segments, slices, sum_by, table
from .ngram_join import pack, unpack
from .terms import ALNUM, coded

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
SLICE, RUN, RANGE, CHUNK = 1 << 21, 1 << 20, 1 << 20, 1 << 16
POLYNOMIAL = 0xEDB88320  # of crc32, reflected


# ---------------------------------------------------------------- features


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each bit, of every value."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """What 2^power zero bytes make of each bit of a checksum."""
    if power:
        half = _zeros(power - 1)
        return _apply(half, half)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return bits


@functools.lru_cache(maxsize=4096)
def shift_tables(length: int) -> np.ndarray:
    """(4, 256): what so many further bytes make of each byte of a checksum; the four are combined by xor."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])).ravel()
    for power in range(length.bit_length()):
        if length >> power & 1:
            values = _apply(_zeros(power), values)
    return values.reshape(4, 256)


def features(col: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, n + 1 offsets, bucket of every pair of neighbours, n + 1 offsets) of the texts."""
    codes, at, terms = coded(col, ALNUM)
    words = [w.encode() for w in terms.to_pylist()]
    alone = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in alone.tolist()], np.uint32)
    lengths, length_of = np.unique(np.array([len(w) for w in words], np.int64), return_inverse=True)
    n = np.diff(at)
    first = np.delete(np.arange(len(codes)), at[1:][n > 0] - 1)  # words that another of their text follows
    a, b = spaced[codes[first]], codes[first + 1]
    if len(first):
        tables, which = np.stack([shift_tables(x) for x in lengths.tolist()]).reshape(-1), length_of[b] * 1024
        pair = alone[b]
        for byte in range(4):
            pair = pair ^ tables[which + byte * 256 + ((a >> np.uint32(8 * byte)) & np.uint32(255))]
    else:
        pair = np.empty(0, np.uint32)
    return (alone[codes] % np.uint32(buckets)).astype(np.int64), at, (pair % np.uint32(buckets)).astype(np.int64), segments(np.maximum(n - 1, 0))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (text) in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                word, _, pair, _ = features(part.column("text"), buckets)
                total += np.bincount(word, minlength=buckets) + np.bincount(pair, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    got = map_arrow(docs, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket, the log ratio of its smoothed shares in the target and in all documents, in thousandths, floored."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(b"%d:%d" % (seed, doc_id)).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_features, weight, score)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = held.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                word, at, pair, pair_at = features(part.column("text"), len(gain))
                n_words = np.diff(at)
                n = n_words + np.diff(pair_at)
                weight = (sum_by(gain[word], at) + sum_by(gain[pair], pair_at)) // np.maximum(n, 1)
                ids = part.column("doc_id").to_pylist()
                scores = [None if i is None else w + noise(i, seed) for i, w in zip(ids, weight.tolist(), strict=True)]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(x) for x in (n_words, n, weight)), pa.array(scores, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(docs, run, "doc_id long, n_words long, n_features long, weight long, score long")


# ---------------------------------------------------------------- the draw


def tournament(runs: list[list]) -> Iterator[tuple]:
    """(entry, run, place in it) of sorted runs in order, by a tree of losers: the winner's next entry only meets the losers on
    its way up."""
    k = len(runs)
    over = (math.inf,)
    place = [0] * k
    head = [r[0] if r else over for r in runs]
    loser = [0] * max(k, 1)

    def winner(node: int) -> int:
        if node >= k:
            return node - k
        a, b = winner(2 * node), winner(2 * node + 1)
        if (head[b], b) < (head[a], a):
            a, b = b, a
        loser[node] = b
        return a

    top = winner(1) if k > 1 else 0
    while k and head[top] is not over:
        yield head[top], top, place[top]
        place[top] += 1
        head[top] = runs[top][place[top]] if place[top] < len(runs[top]) else over
        node = (top + k) // 2
        while node:
            if (head[loser[node]], loser[node]) < (head[top], top):
                top, loser[node] = loser[node], top
            node //= 2


def splitters(per_score: pd.DataFrame, scored: DataFrame, most: int) -> list[tuple[int, int]]:
    """Where ranges begin, as (-score, least id), so that each has about ``most`` rows: after so many rows the next score begins
    one. A score with more than that has its ids parted by quantiles; per_score (score, n) comes highest first."""
    out, held = [], 0
    heavy = per_score[per_score["n"] > 2 * most]
    parted = {}
    if len(heavy):
        n = int(heavy["n"].max())
        shares_of = F.percentile_approx("doc_id", [x * most / n for x in range(1, n // most + 1)], 10_000)
        parted = {r["score"]: r["ids"] for r in scored.where(F.col("score").isin(heavy["score"].tolist())).groupBy("score").agg(shares_of.alias("ids")).collect()}
    least = -(1 << 63)
    for at, n in per_score[["score", "n"]].itertuples(index=False):
        if out and held + n > most:
            out.append((-at, least))
            held = 0
        elif not out:
            out.append((-at, least))
        held += n
        out += [(-at, i) for i in sorted(set(parted.get(at, [])))]
    return out


def place_of(split: list[tuple[int, int]], key: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """First position at or after each splitter in rows sorted by (key, doc_id)."""
    out = []
    for k, i in split:
        a, z = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        out.append(a + np.searchsorted(doc_id[a:z], i, "left"))
    return np.array(out, np.int64)


_PACKED = {"key": "i8", "doc_id": "i8", "n_features": "i8", "weight": "i8", "copies": "i8"}


def sorted_runs(rows: DataFrame, split: list[tuple[int, int]], most: int = RUN) -> DataFrame:
    """rows (doc_id, score, n_features, weight) -> (range, n, packed columns): sorted runs of at most ``most`` rows, cut into ranges."""
    held = rows.sparkSession.sparkContext.broadcast(split)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        key, ids, n, weight = (t.column(c).to_numpy() for c in ("score", "doc_id", "n_features", "weight"))
        key = -key
        order = np.lexsort((n, ids, key))
        key, ids, n, weight = key[order], ids[order], n[order], weight[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])])
        at = np.flatnonzero(new)
        columns = [key[at], ids[at], n[at], weight[at], np.diff(np.append(at, len(key)))]
        cuts = place_of(held.value, columns[0], columns[1])
        ends = np.append(cuts[1:], len(at))
        some = [(i, a, z) for i, (a, z) in enumerate(zip(cuts.tolist(), ends.tolist(), strict=True)) if z > a]
        packed = [pa.array([pack(c[a:z].astype(np.int64)) for _, a, z in some], pa.binary()) for c in columns]
        return pa.record_batch([pa.array([i for i, _, _ in some], pa.int64()), pa.array([int(columns[-1][a:z].sum()) for _, a, z in some], pa.int64()), *packed], names=["range", "n", *_PACKED])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if parts and size + piece.num_rows > most:
                    yield one(parts)
                    parts, size = [], 0
                parts.append(piece)
                size += piece.num_rows
        if parts:
            yield one(parts)

    return map_arrow(rows, run, "range long, n long, " + ", ".join(f"{c} binary" for c in _PACKED))


def merged(runs: DataFrame, draw: int) -> DataFrame:
    """Sorted runs with the rows before their range (before) -> (doc_id, n_features, weight, score, rank), each range by its own
    tournament; past the draw count, which ends it, rows have no rank."""

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        columns = {c: [unpack(x, kind) for x in pieces[c]] for c, kind in _PACKED.items()}
        at = segments(np.array([len(x) for x in columns["key"]], np.int64)).tolist()
        whole = {c: np.concatenate(x) for c, x in columns.items()}
        order, rank, first = [], [], int(pieces["before"].iloc[0]) + 1
        for _, run, place in tournament([list(zip(*(columns[c][i].tolist() for c in ("key", "doc_id", "n_features")), strict=True)) for i in range(len(pieces))]):
            order.append(at[run] + place)
            rank.append(first)
            first += int(columns["copies"][run][place])
            if first > draw:
                break
        rest = np.ones(at[-1], bool)
        rest[order] = False
        order += np.flatnonzero(rest).tolist()
        rank += [draw + 1] * int(rest.sum())
        out = {c: whole[c][order] for c in ("doc_id", "n_features", "weight", "copies")}
        return pd.DataFrame({**out, "score": -whole["key"][order], "first": np.array(rank, np.int64)})

    entries = runs.groupBy("range").applyInPandas(merge, "doc_id long, n_features long, weight long, copies long, score long, first long")
    # An entry's rows, in chunks, so that no array grows with the copies.
    entries = entries.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    entries = entries.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("copies")) - 1)))
    rank = F.col("first") + F.col("i")
    return entries.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.lit(draw), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, run: int = RUN, most: int = RANGE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank of those drawn, in order of score."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession):
        gain = gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select(F.col(target_col).alias("text")), buckets))
        scored = materialise(score(docs, gain, seed), "resample-scores")
        can = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
        per_score = scored.where(can).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)
        draw = percent * int(per_score["n"].sum()) // 100
        reached = per_score["n"].cumsum() - per_score["n"] < draw
        if not reached.any():
            return materialise(scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")), "resample", keep=True)
        per_score = per_score[reached]
        taken = F.coalesce(can & (F.col("score") >= int(per_score["score"].min())), F.lit(False))
        drawn = scored.where(taken).select("doc_id", "score", "n_features", "weight")
        runs = materialise(sorted_runs(drawn, splitters(per_score, drawn, most), run), "resample-runs")
        before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        before = runs.groupBy("range").agg(F.sum("n").alias("n")).select("range", before.alias("before"))
        out = merged(runs.drop("n").join(before, "range"), draw)
        rest = scored.where(~taken).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        return materialise(out.union(rest), "resample", keep=True)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum is a fold over a feature's bytes with the table that the polynomial gives.
OP13_SQL = r"""
WITH RECURSIVE bits(i, step, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE step = 8),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, text, 's' AS side FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, 't' FROM benchmark),
worded AS (
  SELECT row, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (
  SELECT row, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
own AS (SELECT row, side, f, count(*) AS n FROM feature GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM own)),
crc AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, tab),
counted AS (SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM own JOIN crc USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counted),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(c.t, 0)::DOUBLE + 1) * (total.s + 10000) / ((coalesce(c.s, 0)::DOUBLE + 1) * (total.t + 10000))))::BIGINT AS gain FROM counted c, total),
weighed AS (SELECT row, sum(n) AS n, sum(n * gain) AS gain FROM own JOIN crc USING (f) JOIN gain USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
         coalesce(floor(gain::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (row) WHERE side = 's'),
drawn AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, n_features, row) AS rank FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (row)
"""
