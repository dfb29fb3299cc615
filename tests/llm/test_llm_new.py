"""Odd sketches, the divergence audit and importance resampling against plain versions."""

import collections
import heapq
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import divergence, odd_sketch, resample, terms


@pytest.fixture(scope="module")
def tiny(spark):
    """A table of few words, many ties, repeated rows and ids, nulls and clashing columns."""
    rng = random.Random(5)
    vocabulary = "ab AB cd é ÉÀ x1 2y 日本 ef gh".split()
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))), rng.choice(["en", "en", "de", None]), f"s{rng.randint(0, 8)}", 1, "z") for i in range(120)]
    rows += [rows[7]] * 40 + [(None, rows[9][1], "en", "s1", 2, "y"), (500, None, None, None, 1, "x"), (501, "!!", "xx", "only", 1, "x"), (502, None, "xx", "", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, term string").repartition(3).cache()


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(map(repr, con.execute(sql).fetchall()))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


# ---------------------------------------------------------------- terms


def test_terms_are_maximal_runs():
    texts = ["The cat-2 sat ÉÀ日本 x1", None, "", "a\x1eB", "-", "z"]
    for seen, pattern in ((terms.LETTERS, "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), (terms.ALNUM, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")):
        import re

        fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        codes, at, names = terms.coded(pa.array(texts).slice(0), seen)
        own = [[names[c].as_py() for c in codes[a:z].tolist()] for a, z in zip(at[:-1], at[1:], strict=True)]
        assert own == [re.findall(pattern, (t or "").translate(fold)) for t in texts]
    assert terms.coded(pa.array([], pa.string()), terms.ALNUM)[1].tolist() == [0]


# ---------------------------------------------------------------- odd sketches


def sets_of(pairs, size, rng):
    own, at = [], [0]
    for similarity in pairs:
        common = round(2 * size * similarity / (1 + similarity))
        pool = rng.integers(1, 1 << 63, 2 * size - common, dtype=np.uint64)
        for s in (pool[:size], pool[size - common :]):
            own.append(np.sort(s))
            at.append(at[-1] + len(s))
    return np.concatenate(own), np.array(at)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for j in (0.8, 0.9, 0.97):
        own, at = sets_of([j] * 200, 400, rng)
        words = odd_sketch.odd_sketches(odd_sketch.minima(own, at))
        ones = np.bitwise_count(words[::2] ^ words[1::2]).sum(axis=1)
        estimate = odd_sketch.similarity(ones)
        assert abs(estimate.mean() - j) < 0.01 and estimate.std() < 0.045 and ones.max() <= odd_sketch.most_ones()


def test_bound_of_ones_is_exact():
    """Against draws, at a risk that draws can show."""
    rng = np.random.default_rng(4)
    for percent in (80, 95):
        ones = []
        for d in rng.binomial(64, 1 - percent / 100, 4000):
            ones.append((np.bincount(rng.integers(0, 128, 2 * d), minlength=128) & 1).sum())
        bound = odd_sketch.most_ones(percent, 64, 128, 0.05)
        assert np.mean(np.array(ones) > bound) < 0.065 and np.mean(np.array(ones) > bound - 3) > 0.05
    assert odd_sketch.most_ones() < odd_sketch.BITS // 2


def test_bands_bring_pairs_together():
    own, at = sets_of([0.8] * 300 + [0.3] * 300, 100, np.random.default_rng(6))
    keys = odd_sketch.band_keys(odd_sketch.minima(own, at))
    shared = (keys[::2] == keys[1::2]).any(axis=1)
    assert shared[:300].all() and shared[300:].mean() < 0.45


def test_breadth_first_components_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    words = base[rng.integers(0, 6, 80)].copy()
    for w in words:
        for bit in rng.integers(0, 512, 60):
            w[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    size = rng.integers(80, 130, 80)
    root = odd_sketch.alike(words, size, 95, 80)
    want = list(range(80))
    for _ in range(80):
        for i in range(80):
            for j in range(i):
                if np.bitwise_count(words[i] ^ words[j]).sum() <= 95 and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert root.tolist() == want and 1 < len(set(want)) < 80


def plain_components(rows, k, percent):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = (t or "").translate(fold).split()
        sets[i] = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}


def near_copies():
    """Chains, hubs of near copies, and texts of a passage that many share."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows, i = [], 0
    for _ in range(60):  # a drifting chain: neighbours link, ends do not
        base = base[1:] + [f"w{rng.randint(100, 5000)}"] if rng.random() < 0.7 else base
        rows.append((i, " ".join(base)))
        i += 1
    for g in range(4):
        text = [f"g{g}x{n}" for n in range(30 + 20 * g)]
        for _ in range(30):
            t = list(text)
            for at in rng.sample(range(len(t)), rng.randint(0, 4)):
                t[at] = f"n{rng.randint(0, 9)}"
            rows.append((i, " ".join(t)))
            i += 1
    common = " ".join(f"c{n}" for n in range(40))
    rows += [(i + n, f"{common} " + " ".join(f"u{n}v{m}" for m in range(rng.randint(1, 30)))) for n in range(40)]
    return rows


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80), (3, 90)])
def test_near_duplicates_by_brute_force(spark, k, percent):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_components(rows, k, percent)
    for more in ({}, {"hub": 4, "block": 8, "again": 16}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in odd_sketch.near_duplicates(docs, k=k, percent=percent, **more).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 80


def test_deduplicate_keeps_one_row_a_component(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1), (3, text + " more", 2), (2, text, 3), (2, "another text of its own", 4), (None, "and one without an id", 5), (7, None, 6), (8, "", 7)]
    df = spark.createDataFrame(rows, "component_id long, text string, _row int")
    got = odd_sketch.deduplicate(df, id_col="component_id")
    assert got.columns == df.columns and sorted(r["_row"] for r in got.collect()) == [3, 4, 5, 6, 7]


# ---------------------------------------------------------------- divergence


def test_shares_are_exact_beyond_64_bits():
    for total, kept in ((0, 1), (12, 5), (10**15, 10**9), (9 * 10**15 - 7, 3)):
        count = np.array([0, 1, total // 3, total], np.int64)
        assert divergence.shares(count, total, kept).tolist() == [1 + 10**9 * (c + 1) // (total + kept) for c in count.tolist()]


@pytest.mark.parametrize("more", [{}, {"shard": 2, "cells": 1}, {"shard": 3, "cells": 4, "most": 2}, {"shard": 1, "cells": 64, "most": 1}])
def test_audit_equals_sql(tiny, more):
    """Whatever the shards and cells: odd and even numbers of them, one and many groups a cell."""
    assert rows_of(divergence.audit(tiny.repartition(3), **more)) == by_sql(divergence.OP12_SQL, documents=tiny)


def test_each_pair_of_cells_meets_once(tiny, monkeypatch):
    seen = []
    keep = divergence.rotate
    monkeypatch.setattr(divergence, "rotate", lambda rows, parts, top: seen.append(rows.collect()) or keep(rows, parts, top))
    divergence.audit(tiny, cells=6, most=1)
    rows = seen[0]
    for lang in {r["lang"] for r in rows}:
        homes = {r["source"]: r["cell"] for r in rows if r["lang"] == lang and r["round"] == -1}
        met = collections.Counter(frozenset((homes[r["source"]], r["cell"])) for r in rows if r["lang"] == lang and r["round"] >= 0)
        n = len(set(homes.values()))
        assert n == len(homes) and len(met) == n * (n - 1) // 2 and set(met.values()) <= {1}
        rounds = collections.Counter((r["round"], r["cell"]) for r in rows if r["lang"] == lang and r["round"] >= 0)
        assert set(rounds.values()) <= {1}


def test_ranks_stop_at_the_top(tiny):
    got = divergence.audit(tiny, top=2).where("part = 'term'").collect()
    full = {(r["lang"], r["source"], r["rank"]): r for r in divergence.audit(tiny).where("part = 'term'").collect()}
    assert got and all(r["rank"] <= 2 and full[r["lang"], r["source"], r["rank"]] == r for r in got)


# ---------------------------------------------------------------- resampling


def test_checksums_of_pairs():
    for n in (0, 1, 2, 7, 300, 70_000):
        tables = resample.shift_tables(n)
        for head in (b"", b"a", "über ".encode()):
            c, tail = zlib.crc32(head), b"q" * n
            shifted = 0
            for byte in range(4):
                shifted ^= int(tables[byte][(c >> 8 * byte) & 255])
            assert shifted ^ zlib.crc32(tail) == zlib.crc32(head + tail)
    texts = ["A b é1 日本 b", "", None, "one", "x y"]
    word, at, pair, pair_at = resample.features(pa.array(texts), 10_000)
    for i, t in enumerate(texts):
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        assert word[at[i] : at[i + 1]].tolist() == [zlib.crc32(x.encode()) % 10_000 for x in w]
        assert pair[pair_at[i] : pair_at[i + 1]].tolist() == [zlib.crc32(f"{a} {b}".encode()) % 10_000 for a, b in zip(w, w[1:], strict=False)]


def test_tournament_merges_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randint(0, 20), rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(k)]
        got = list(resample.tournament(runs))
        assert [e for e, _, _ in got] == list(heapq.merge(*runs)) and all(runs[r][i] == e for e, r, i in got)


@pytest.mark.parametrize("more", [{}, {"run": 5, "most": 4}, {"run": 1, "most": 1}])
def test_resample_equals_sql(spark, tiny, more):
    target = spark.createDataFrame([(1, "ab é x1 cd cd"), (2, None), (3, "2y 2y 2y")], "item_id long, text string")
    assert rows_of(resample.resample(tiny.repartition(3), target, **more)) == by_sql(resample.OP13_SQL, documents=tiny, benchmark=target)


def test_resample_by_hand(spark):
    """Without SQL: gains, floors that go down, ranks 1, 2, 3 and the exact number drawn; ids of one score parted."""
    docs = [(i, f"a b {'c' if i % 3 else 'd'} " * 8) for i in range(41)] + [(99, "too short"), (-5, "a " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in resample.resample(df, spark.createDataFrame([("c b",)], "text string"), run=3, most=2).collect()}
    feats = {i: [*t.split(), *(f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False))] for i, t in docs}
    s, t = collections.Counter(), collections.Counter(zlib.crc32(x) % 10_000 for x in (b"c", b"b", b"c b"))
    for f in feats.values():
        s.update(zlib.crc32(x.encode()) % 10_000 for x in f)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (3 + 10_000))))
    for i, f in feats.items():
        assert got[i]["n_features"] == len(f) and got[i]["weight"] == sum(gain(zlib.crc32(x.encode()) % 10_000) for x in f) // len(f)
        assert got[i]["score"] == got[i]["weight"] + resample.noise(i)
    able = sorted((i for i in feats if i != 99), key=lambda i: (-got[i]["score"], i))
    assert [got[i]["rank"] for i in able] == [*range(1, 11), *[None] * 32] and got[99]["rank"] is None
    assert any(r["weight"] < 0 for r in got.values())


def test_a_hot_id_is_drawn_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 7)
    df = spark.createDataFrame([(1, "a " * 30)] * 90 + [(2, "b " * 30)] * 10, "doc_id long, text string").repartition(4)
    got = resample.resample(df, spark.createDataFrame([("a",)], "text string"), most=8).collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26))


def test_splitters_part_a_heavy_score(spark):
    import pandas as pd

    rows = spark.createDataFrame([(i, 5) for i in range(100)] + [(i, 4) for i in range(3)], "doc_id long, score long")
    split = resample.splitters(pd.DataFrame({"score": [5, 4], "n": [100, 3]}), rows, 10)
    assert split == sorted(split) and len(split) >= 10 and split[0][0] == -5
    key, ids = np.array([-5] * 100 + [-4] * 3), np.array([*range(100), 0, 1, 2])
    cuts = resample.place_of(split, key, ids)
    assert cuts[0] == 0 and max(np.diff(np.append(cuts, 103))) <= 20
