"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every run of non-letters stands for one kind of space, and the 1- to 3-grams of code points are
hashed into ``BUCKETS`` features each order salted its own way. Training counts cover all rows allowed for training:
executors count (language, bucket) pairs and Spark adds them up. The log-probability matrix is broadcast, at most ``MAX_LANGS`` x
``BUCKETS`` of it at a time: further languages are further blocks, each a pass over the rows that carries on the likeliest
language so far and the odds against it, so results do not depend on the blocks. A batch is scored in numpy as a sparse matrix: each document is the list of its buckets, whose
matrix columns are gathered and summed per document.

The score is the posterior of the predicted language with the evidence tempered to at most ``EVIDENCE`` n-grams, as
overlapping n-grams of a long text are far from independent; it ranges from 1/languages to 1.

Defined results. ``und`` with score 0 for a null text or one without a letter, and where no language could be learned.
Rows with a null id are never trained on. Ties go to the language first in code-point order. The driver holds the
names of all languages and one block's matrix. Texts are processed whole, in slices of bounded size.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_arrow, materialise, segments, shielded, slices, sum_by, table

BUCKETS, ORDERS, SMOOTHING, MAX_LANGS, EVIDENCE = 1 << 14, (1, 2, 3), 0.5, 512, 60.0
UNDETERMINED = "und"
SLICE = 1 << 19
COUNTED = 64  # languages of a slice that are counted at a time
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of every n-gram, n + 1 offsets of each text's, whether each text has a letter)."""
    joined = "".join(f" {t.lower()}  " if t else "   " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(t.lower()) + 3 if t else 3 for t in texts), dtype=np.int64, count=len(texts))
    at = segments(lengths)
    letter = _letters()[points]
    has = sum_by(letter.astype(np.int64), at) > 0
    points = np.where(letter, points, np.uint32(32))
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    two = len(points) - 2
    wanted = letter[:two] | letter[1 : two + 1] | letter[2:]  # an n-gram with a letter in reach
    wanted[at[1:-1] - 1] = False  # starts at the second closing space: it would reach into the next text
    wanted[at[1:-1] - 2] = False
    begin = np.flatnonzero(wanted)
    features = np.empty((len(begin), len(ORDERS)), np.int32)
    h = np.zeros(len(begin), np.uint32)
    for k in ORDERS:
        h = (h ^ points[begin + (k - 1)]) * _MULTIPLIERS[k - 1]
        h ^= h >> np.uint32(15)
        features[:, k - 1] = (h * np.uint32(0x27D4EB2F)) >> shift
    return features.ravel(), np.searchsorted(begin, at) * len(ORDERS), has


def train_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n): n-grams counted over every row; bucket -1 counts documents."""

    def drained(total: dict[str, np.ndarray]):
        for lang, held in total.items():
            full = np.flatnonzero(held)
            yield pa.record_batch([pa.array([lang] * len(full)), pa.array(np.where(full == buckets, -1, full).astype(np.int32)), pa.array(held[full])], names=["lang", "bucket", "n"])
        total.clear()

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = part.column("lang").to_pylist()
                features, at, _ = ngrams(part.column("text").to_pylist(), buckets)
                known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                which = np.fromiter((known[x] for x in langs), dtype=np.int64, count=len(langs))
                own, rows_of, names = np.repeat(which, np.diff(at)), np.bincount(which), list(known)
                for lo in range(0, len(names), COUNTED):
                    some = names[lo : lo + COUNTED]
                    here = (own >= lo) & (own < lo + len(some)) if len(some) < len(names) else slice(None)
                    n = np.bincount((own[here] - lo) * buckets + features[here], minlength=len(some) * buckets).reshape(-1, buckets)
                    for i, lang in enumerate(some):
                        held = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                        held[:buckets] += n[i]
                        held[buckets] += int(rows_of[lo + i])
                    if len(total) > MAX_LANGS:
                        yield from drained(total)
        yield from drained(total)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return map_arrow(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


Model = tuple[list[str], np.ndarray, np.ndarray]


def blocks(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, smoothing: float = SMOOTHING, most: int = MAX_LANGS) -> Iterator[Model]:
    """(languages, log priors, log-probability matrix of languages x buckets), of at most ``most`` languages at a time, in
    code-point order; without any language, one empty block. Priors are over all languages."""
    counts = train_counts(docs, text_col=text_col, lang_col=lang_col, buckets=buckets)
    few = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string")).distinct().limit(most + 1).count() <= most
    if few:
        got = counts.toPandas()
        rows = got[got["bucket"] == -1]
    else:
        counts = materialise(counts, "lang-counts", keep=True)
        rows = counts.where("bucket = -1").toPandas()  # one row a language
    sizes = dict(zip(rows["lang"], rows["n"], strict=True))
    langs, total = sorted(sizes), sum(sizes.values()) + len(sizes)
    for lo in range(0, max(1, len(langs)), most):
        some = langs[lo : lo + most]
        if not few:
            got = counts.where(F.col("lang").between(some[0], some[-1])).toPandas()
        held = got[got["bucket"] >= 0]
        grams = np.full((len(some), buckets), float(smoothing))
        grams[held["lang"].map({x: i for i, x in enumerate(some)}).to_numpy(dtype=np.int64), held["bucket"].to_numpy(dtype=np.int64)] += held["n"].to_numpy()
        prior = np.log(np.array([sizes[x] + 1 for x in some], dtype=float) / total) if some else np.empty(0)
        yield some, prior, np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, *, max_langs: int = MAX_LANGS, **columns) -> Model:
    """The one block of at most max_langs languages; more are an error, as they need all of ``blocks``."""
    found = list(itertools.islice(blocks(docs, most=max_langs, **columns), 2))
    if len(found) > 1:
        raise ValueError(f"more than {max_langs} languages; take them in blocks")
    return found[0]


def likeliest(texts: list[str | None], langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Per text: the likeliest of the languages (null if the text has no letter, or there are none), its log likelihood, and
    the sum of all likelihoods divided by its own."""
    features, at, has = ngrams(texts, logp.shape[1])
    n = np.diff(at)
    if not langs:
        return [None] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts))
    evidence = np.stack([sum_by(row[features], at) for row in logp])  # languages x texts
    ll = evidence * (np.minimum(n, EVIDENCE) / np.maximum(n, 1)) + prior[:, None]
    best, top = ll.argmax(axis=0), ll.max(axis=0)
    return [langs[b] if k else None for b, k in zip(best, has & (n > 0), strict=True)], top, np.exp(ll - top).sum(axis=0)


def score_texts(texts: list[str | None], langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    found, _, odds = likeliest(texts, langs, prior, logp)
    known = np.array([x is not None for x in found], bool)
    return [UNDETERMINED if x is None else x for x in found], np.where(known, 1.0 / np.where(known, odds, 1.0), 0.0)


def predict(docs: DataFrame, models: Iterable[Model], *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added, from all blocks of languages; a column of docs with such a name is replaced, and
    so are _top and _odds. Beyond the first block, rows are written between passes, so that a task holds one block."""
    docs = docs.drop("lang_pred", "score", "_top", "_odds")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("_top", T.DoubleType()), T.StructField("_odds", T.DoubleType())])
    names, found = docs.columns, None
    for model in models:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, held=held, first=found is None):
            for batch in batches:
                for part in slices(batch, text_col, SLICE):
                    lang, top, odds = likeliest(part.column(text_col).to_pylist(), *held.value)
                    if not first:
                        had, old_top, old_odds = (part.column(c) for c in ("lang_pred", "_top", "_odds"))
                        old_top, old_odds = old_top.to_numpy(zero_copy_only=False), old_odds.to_numpy(zero_copy_only=False)
                        lang = [a if x >= y else b for a, b, x, y in zip(had.to_pylist(), lang, old_top, top, strict=True)]  # ties: the earlier block
                        both = np.maximum(old_top, top)
                        top, odds = both, old_odds * np.exp(old_top - both) + odds * np.exp(top - both)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(top), pa.array(odds)], names=[*names, "lang_pred", "_top", "_odds"])

        found = map_arrow(docs if found is None else materialise(found, "lang-pass", keep=True), run, schema)
    known = F.col("lang_pred").isNotNull()
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    return found.select(*kept, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.when(known, 1 / F.col("_odds")).otherwise(F.lit(0.0)).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = blocks(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), models).select("doc_id", "held_out", "lang_pred", "score")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is recognised: those without a letter go, and those whose best language is not likelier than
    all others together."""
    models = blocks(docs.where(~held_out()).select("text", "lang"))
    docs, restored = shielded(docs, "text")
    return restored(predict(docs, models).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5)))
