"""Entity resolution: exact by normalised name, then fuzzy by shared character shingles: by an exact join on several of them, or, where
signatures are kept with the nodes, by their bands."""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_name
from ..sources.store import written

THRESHOLD, MIN_LENGTH, MIN_ENTROPY = 0.9, 6, 1.5
BANDS, ROWS, CHUNK = 32, 8, 1024

# Numbers that codes of shingles stay below; the most shingles of a key, the most keys of a name, and the largest set that is given keys of several shingles.
MOST_CODES, MOST_SHARED, MOST_KEYS, MOST_SIZE = 2 * 36**3, 6, 40, 128


def exact_resolution(new: DataFrame, known: DataFrame) -> DataFrame:
    """new (uuid, name) and known nodes -> (uuid, resolved, matches): the one known node of the same normalised name; with
    several, none."""
    key = normalized_name(F.col("name"))
    held = known.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("matches"), F.min("uuid").alias("one"))
    own = new.withColumn("key", key).join(held, "key", "left")
    return own.select("uuid", F.when(F.col("matches") == 1, F.col("one")).alias("resolved"), F.coalesce("matches", F.lit(0)).alias("matches"))


def _let(value: Column, use) -> Column:
    """A value bound once, where a column would be computed anew for every use in a lambda."""
    return F.transform(F.array(value), use)[0]


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct k-character shingles of a normalised name without its spaces."""
    all_of = lambda s, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))
    return _let(F.replace(c, F.lit(" "), F.lit("")), lambda s: F.when(F.length(s) >= k, all_of(s, F.length(s) - k + 1)).otherwise(F.array(s)))


def coded(shingled: Column) -> Column:
    """Shingles of up to three of 0-9 and a-z as numbers below MOST_CODES, each its own."""
    return F.transform(shingled, lambda g: F.conv(F.concat(F.lit("1"), g), 36, 10).cast("int"))


def entropy(c: Column) -> Column:
    """Bits a character of a name."""
    bits = lambda chars, n: F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - _let(F.size(F.filter(chars, lambda y: y == x)) / n, lambda p: p * F.log2(p)))
    return _let(F.filter(F.split(c, ""), lambda x: (x != "") & (x != " ")), lambda chars: bits(chars, F.size(chars)))


def _dealt(df: DataFrame, *by: Column | str) -> DataFrame:
    """Rows of few bytes and much work, dealt out to a number of tasks that is kept, where small ones would be made one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _telling(nodes: DataFrame, min_length: int, min_entropy: float) -> DataFrame:
    """(key, uuid, s): each normalised name that is long and varied enough once, with its smallest node and its shingles' codes."""
    names = nodes.select("uuid", normalized_name(F.col("name")).alias("key")).groupBy("key").agg(F.min("uuid").alias("uuid"))
    names = _dealt(names, F.xxhash64("key"))
    # A filter on names must not be pushed below their grouping, to be worked out for every node: a column that is not deterministic
    # keeps it above.
    names = names.withColumn("_row", F.monotonically_increasing_id()).where((F.length("key") >= min_length) & (entropy(F.col("key")) >= min_entropy) & (F.col("_row") >= 0))
    return names.select("key", "uuid", coded(shingles(F.col("key"))).alias("s"))


def _alike(a: str, b: str) -> Column:
    """Jaccard of two sets, as arrays without repetitions."""
    both = F.size(F.array_intersect(a, b))
    return F.round(both / (F.size(a) + F.size(b) - both), 9)


def _best(met: DataFrame, threshold: float) -> DataFrame:
    """met (x, s_x, resolved, s_y) -> (x, resolved, score): the most similar one of each x, at the threshold or above; of equals the smallest."""
    small, large = F.least(F.size("s_x"), F.size("s_y")), F.greatest(F.size("s_x"), F.size("s_y"))
    scored = met.where(small >= F.lit(threshold) * large - 1e-9).select("x", "resolved", _alike("s_x", "s_y").alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("x").agg(F.min(F.struct((-F.col("score")).alias("away"), "resolved")).alias("best"))
    return best.select("x", "best.resolved", (-F.col("best.away")).alias("score"))


def _needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _choices(threshold: float) -> tuple[list[tuple[int, int, list[int]]], list[tuple[int, int, list[int]]], int, int]:
    """(for known sets, for new sets, the largest size of each that has an entry): of a set's size, how many shingles make a key (l),
    and the places in the prefix that each of its keys takes."""
    shared = {}  # by size of the known set
    for m in range(1, MOST_SIZE + 1):
        spare = max(n - _needed(n, threshold) for n in range(m, int(m / threshold + 1e-6) + 1))
        shared[m] = max((j for j in range(1, min(MOST_SHARED, _needed(m, threshold)) + 1) if math.comb(spare + j, j) <= MOST_KEYS), default=1)
    keys = lambda n, j: [(n, j, list(c)) for c in itertools.combinations(range(1, min(n, n - _needed(n, threshold) + j) + 1), j)]
    known = [row for m, j in shared.items() for row in keys(m, j)]
    largest = int(MOST_SIZE / threshold + 1e-6)
    new = [row for n in range(1, largest + 1) for j in {shared.get(m, 1) for m in range(max(1, _needed(n, threshold)), int(n / threshold + 1e-6) + 1)} for row in keys(n, j)]
    return known, new, MOST_SIZE, largest


def fuzzy_resolution(new: DataFrame, known: DataFrame, *, threshold: float = THRESHOLD, min_length: int = MIN_LENGTH, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """(uuid, resolved, score): of each new node the known one whose name's shingles are most similar, at the threshold
    or above; ties go to the smallest uuid. Short names and those of few different characters are not compared.

    Distinct names are compared, not nodes, through an exact join on several shingles at once. Two sets at the threshold have
    ceil(threshold n) shingles in common, for either's size n, so the first l of those, from rare to common, are among the first
    n - ceil(threshold n) + l of each: every choice of l of these is a key. One shingle more or less makes few keys, so l is
    large where names are short, and numbers that share a digit or two do not meet. The order is by counts of shingles,
    of which there are fewer than MOST_CODES."""
    spark, names = new.sparkSession, lambda df: written(_telling(df, min_length, min_entropy), f"names-{uuid.uuid4().hex}")
    na, nb = names(new), names(known)
    weights = bytearray(MOST_CODES)  # a byte a code, 8 log2 of its count: equals go by code
    for r in na.select("s").unionAll(nb.select("s")).select(F.explode("s").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        weights[r["g"]] = min(255, int(8 * math.log2(r["n"])))
    for_known, for_new, most_known, most_new = _choices(threshold)

    def keyed(df: DataFrame, choices: list, most: int) -> DataFrame:
        """Every name under each of its keys; sets larger than ``most`` under single shingles."""
        placed = F.transform("s", lambda g: F.struct(F.substring(F.lit(weights), g + 1, F.lit(1)).alias("n"), g.alias("g")))
        own = df.withColumn("p", F.transform(F.sort_array(placed), lambda x: x["g"])).withColumn("size", F.size("s"))
        chosen = spark.createDataFrame(choices, "size int, l int, at array<int>").groupBy("size").agg(F.collect_list(F.struct("l", "at")).alias("ways"))
        singles = F.transform(F.sequence(F.lit(1), (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int")), lambda i: F.struct(F.lit(1).alias("l"), F.array(i).alias("at")))
        ways = own.join(F.broadcast(chosen), "size", "left").withColumn("ways", F.when(F.col("size") > most, singles).otherwise(F.col("ways")))
        return ways.select("key", "uuid", "s", F.explode(F.transform("ways", lambda w: F.xxhash64(w["l"], F.transform(w["at"], lambda i: F.element_at("p", i))))).alias("k"))

    asked = keyed(na, for_new, most_new).select("k", F.col("key").alias("x"), F.col("s").alias("s_x"))
    met = _dealt(asked, "k").join(keyed(nb, for_known, most_known).select("k", F.col("uuid").alias("resolved"), F.col("s").alias("s_y")), "k")
    a = new.select("uuid", normalized_name(F.col("name")).alias("x"))
    return a.join(_best(met, threshold), "x", "left").select("uuid", "resolved", "score")


def signed_names(nodes: DataFrame, *, bands: int = BANDS, rows: int = ROWS, min_length: int = MIN_LENGTH, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """nodes (uuid, name) -> (key, uuid, s, bands): each telling name once, with its smallest node, its shingles' codes, and the bands of
    its MinHash values: what is to be kept with nodes, so that only new ones are signed."""
    least = lambda h: F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda i: F.array_min(F.transform(h, lambda x: F.xxhash64(x, i))))
    keys = lambda m: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(m, b * rows + 1, rows)))
    hashed = F.transform("s", lambda g: F.xxhash64(g))
    return _telling(nodes, min_length, min_entropy).select("key", "uuid", "s", _let(hashed, lambda h: _let(least(h), keys)).alias("bands"))


def lsh_resolution(new: DataFrame, known: DataFrame, *, threshold: float = THRESHOLD, chunk: int = CHUNK, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uuid, resolved, score) as fuzzy_resolution has it, of new nodes and of known signed names of the same bands: names meet that
    share a band, which two of a similarity of 0.9 miss with a probability of (1 - 0.9^8)^32, below 10^-7, and their exact
    similarity decides where they meet, so no pair is shuffled. A band's known names are dealt to chunks of about ``chunk``, and
    a new name goes to each of them, so a band that many share is not one task's. ``known`` is read twice: keep it written."""
    own = known.select(F.explode("bands").alias("band"), F.col("key").alias("y"), F.col("uuid").alias("resolved"), F.col("s").alias("s_y"))
    sizes = own.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    held = own.join(sizes, "band").withColumn("chunk", F.pmod(F.xxhash64("y"), F.col("chunks")).cast("int")).drop("chunks", "y")
    asked = signed_names(new, bands=bands, rows=rows).select(F.explode("bands").alias("band"), F.col("key").alias("x"), F.col("s").alias("s_x"))
    asked = asked.join(sizes, "band").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    best = _best(_dealt(asked, "band", "chunk").join(held, ["band", "chunk"]), threshold)
    return new.select("uuid", normalized_name(F.col("name")).alias("x")).join(best, "x", "left").select("uuid", "resolved", "score")
