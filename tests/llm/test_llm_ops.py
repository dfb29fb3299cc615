import collections
import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import ann, components, langid, mixing, ngram_join, quality_mil, quality_rules, queries, sentencepiece_fst, token_files, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLE[name])


# ---------------------------------------------------------------- WARC


def test_warc_reader_refuses_broken_archives():
    import hashlib

    body = b"x" * 5000
    good = warc.record(1, "http://a", body, len(body), hashlib.sha256(body).hexdigest(), None) + warc.record(2, "http://b", b"", len(body), hashlib.sha256(body).hexdigest(), 1)
    for block in (1, 7, 1 << 16):
        got = list(warc.Reader(io.BytesIO(good), keep=True, block=block))
        assert [r.fields["warc-type"] for r in got] == ["response", "revisit"] and got[0].payload == body and got[1].payload is None and got[1].payload_bytes == 5000
    raw = zlib.decompress(good, 31)
    pack = lambda b: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + z.flush()
    for bad in (raw.replace(b"xxxx", b"yyyy", 1), raw.replace(b"Content-Length: 5", b"Content-Length: 4", 1), raw[:-1], raw + b"z", raw.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(warc.WarcError):
            list(warc.Reader(io.BytesIO(pack(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.Reader(io.BytesIO(good[:-9])))


def test_warc_payloads_and_rolled_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_warc(pages, archive_bytes=20_000)
    assert manifest.count() > 3
    got = {r["page_id"]: (r["url"], r["payload"]) for r in warc.read_warc(manifest, payloads=True).collect() if r["record_type"] == "response"}
    want = {r["page_id"]: (r["url"], r["html"].encode()) for r in pages.collect()}
    assert got and all(want[k] == (u, bytes(p)) for k, (u, p) in got.items())


def test_warc_revisits_are_held_against_their_responses(spark, tmp_path):
    import hashlib

    body = b"y" * 300
    good = hashlib.sha256(body).hexdigest()
    for name, digest, to, ok in (("a", good, 1, True), ("b", "deadbeef" * 8, 1, False), ("c", good, 9, False)):
        (tmp_path / name).write_bytes(warc.record(1, "u", body, 300, good, None) + warc.record(2, "u", b"", 300, digest, to))
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")
        if ok:
            assert warc.verified(manifest).count() == 2
        else:
            with pytest.raises(warc.WarcError):
                warc.verified(manifest)


def test_warc_urls_stay_one_header_value():
    for url, want in (("http://a/\r\nX: y", "http://a/%0D%0AX: y"), (" a b\t", "%20a b%09"), ("  ", "%20%20"), ("", ""), ("ü", "ü")):
        (r,) = warc.Reader(io.BytesIO(warc.record(1, url, b"", 0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", None)))
        assert r.fields["warc-target-uri"] == want and "x" not in r.fields


# ---------------------------------------------------------------- quality rules


def test_binomial_tail_is_exact(spark):
    rows = [(x, n, p) for n in (1, 5, 40, 300, 5000) for p in (0.05, 0.3) for x in (0, 1, 2, n // 20, n // 8) if x < n * p]
    for p in (0.05, 0.3):
        some = [(x, n) for x, n, q in rows if q == p]
        got = spark.createDataFrame(some, "x long, n long").select("x", "n", quality_rules.binomial_tail(F.col("x"), F.col("n"), p).alias("t")).collect()
        for r in got:
            exact = math.fsum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(p) + (r["n"] - i) * math.log1p(-p)) for i in range(r["x"] + 1))
            assert r["t"] == pytest.approx(exact, rel=1e-8)


def test_cutoffs_hold_the_risk(spark):
    """A stratum whose good documents are rejected too often at a level stops before it; few labels refute nothing."""
    rows = [("a", 8)] * 400 + [("a", 5)] * 60 + [("b", 8)] * 20 + [("c", 8)] * 400
    cuts = {r["stratum"]: r["max_level"] for r in quality_rules.cutoffs(spark.createDataFrame(rows, "stratum string, reject_level int")).collect()}
    assert cuts == {"a": 4, "b": -1, "c": 7}
    pooled = {r["stratum"] for r in quality_rules.cutoffs(spark.createDataFrame(rows, "stratum string, reject_level int"), max_strata=2).collect()}
    assert pooled == {"a", "c", quality_rules.POOLED}


def test_repeat_words_by_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("ab cd ef gh".split(), k=rng.randint(0, 40))) for _ in range(80)]
    got = quality_rules.with_measures(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        w = t.split()
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(marked))


# ---------------------------------------------------------------- SentencePiece


def _model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_bpe_grammar_equals_the_library(spark, sf_dir):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=_model())
    encoder = sentencepiece_fst.Encoder(sentencepiece_fst.Transducer(_model()))
    rng = random.Random(5)
    alphabet = "abcdeABC 019  .,;\n\t-_éß漢🎉▁'\""
    texts = [t for _, t in documents(spark, sf_dir)] + ["", " ", "   a", "a  b   c    d", "\n\n", "a\x00b", "x" * 300, " " * 37, "<s> </s> <0x41>", "don't.stop", "v1.2,3!!"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    for some in (texts, ["with \x1e inside", *texts[:20]]):
        ids, at = encoder.encode(pa.array(some))
        decoded = sentencepiece_fst.decode(ids, at, encoder.fst).to_pylist()
        for i, t in enumerate(some):
            own = ids[at[i] : at[i + 1]].tolist()
            assert own == lib.encode(t)
            assert decoded[i].decode() == t.replace("▁", " ") == lib.decode(own).replace("▁", " ")


def test_unigram_weights_equal_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(_model())
    m.trainer_spec.model_type = 1
    rng = random.Random(2)
    for p in m.pieces:
        if p.type == 1:
            p.score = -rng.uniform(3, 20)
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    fst = sentencepiece_fst.Transducer(m.SerializeToString())
    score = lambda ids: sum(m.pieces[i].score if m.pieces[i].type == 1 else 0 for i in ids)
    texts = ["".join(rng.choices("abcde fghi.", k=rng.randint(1, 40))) for _ in range(500)]
    ids, at = sentencepiece_fst.Encoder(fst).encode(pa.array(texts))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == lib.encode(t) or score(own) == pytest.approx(score(lib.encode(t)), abs=1e-3)  # a tie


def test_other_normalisers_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(_model())
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        sentencepiece_fst.Transducer(m.SerializeToString())
    m.normalizer_spec.remove_extra_whitespaces = False
    m.pieces[500].type = 4  # user-defined
    with pytest.raises(ValueError):
        sentencepiece_fst.Transducer(m.SerializeToString())


def test_shortest_path_is_the_least_of_all():
    """Against all sequences of pieces of short texts, weighed by the grammar on their own: BPE (one of weight zero) and unigram."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(_model())
    rng = random.Random(9)
    for kind in (2, 1):
        m.trainer_spec.model_type = kind
        if kind == 1:
            for p in m.pieces:
                p.score = -rng.uniform(3, 20)
        fst = sentencepiece_fst.Transducer(m.SerializeToString())

        def paths(text):
            if not text:
                yield []
            for k in range(1, len(text) + 1):
                if text[:k] in fst.ids or (k == 1 and text[:1] not in fst.ids):
                    yield from ([text[:k], *rest] for rest in paths(text[k:]))

        def total(path):
            return sum(fst.grammar.weigh(None if kind == 1 or not i else path[i - 1], x, {}) for i, x in enumerate(path))

        for _ in range(40):
            text = " " + "".join(rng.choices("thein ga漢", k=rng.randint(1, 9)))
            by = sorted((total(p), p) for p in paths(text.replace(" ", "▁")))
            assert total(fst.shortest(text)) == pytest.approx(by[0][0])
            if kind == 2:
                assert by[0][0] == 0 and by[0][1] == fst.shortest(text) and (len(by) == 1 or by[1][0] == math.inf)


# ---------------------------------------------------------------- token files


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [5, 5, 9, 1000, 10**6, 10**12], np.sort(rng.integers(0, 10**7, 5000)), np.arange(10_000) * 3, np.full(1000, 7), [0] * 700 + [2**40]):
        e = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
        n = len(values)
        for a, b in {(0, n), (0, n // 2), (n // 3, n), (n // 2, n // 2), (n // 4, n // 4 + min(n, 3) // 3)}:
            assert e.slice(a, b).tolist() == list(map(int, values[a:b]))
        assert all(e[k] == values[k] for k in range(0, len(values), max(1, len(values) // 300)))
    n = 10_000
    size = len(token_files.EliasFano.encode(np.sort(rng.integers(0, n * 1000, n))).to_bytes()) * 8 / n
    assert size < 2 + math.log2(1000) + 1.5  # bits a value; a table of 64-bit offsets takes 64
    with pytest.raises(ValueError):
        token_files.EliasFano.encode(np.array([2, 1]))


def test_encoder_equals_the_library():
    tokenizer = token_files._tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    parts = ["a", "B", "é", "é", "Σ", "ς", " ", "  ", "\n", "\t", ".", ",", "!", "'s", "'t", "n't", "1", "23", "<|endoftext|>", "<|", "|>", "́", "İ", "漢", "🎉", "\xa0", " ", "\x0b", "$$$", "ſ", "-", "Å", ";", "क़"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)] + ["", None]
    ids, at = token_files.Encoder(tokenizer).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_token_files_read_back(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = token_files._tokenizer(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(3)
    got = token_files.read_token_files(token_files.write_token_files(docs, path, file_tokens=20_000), ids=True).orderBy("start").collect()
    at = 0
    for r, (doc_id, t) in zip(got, documents(spark, sf_dir), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_file_random_access():
    class Held(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def close(self):
            pass

    f = Held()
    w = token_files.TokenFileWriter(f, 2)
    docs = [(None, [5]), (-3, []), (7, [1, 2, 3]), (7, [9] * 300)]
    for i, ids in docs:
        w.add(i, np.array(ids, np.uint16))
    assert w.close() == (4, 304)
    r = token_files.TokenFile(f)
    assert r.doc_ids() == [None, -3, 7, 7] and [r.document(k).tolist() for k in range(4)] == [x for _, x in docs]
    assert all(r.doc_ids(a, b) == [None, -3, 7, 7][a:b] for a in range(5) for b in range(a, 5))
    for size, ids in ((1, 1), (2, 100), (3, 3), (9, 9)):
        blocks = list(r.blocks(size, ids))
        assert [int(x) for _, b in blocks for x in b[:-1]] == [0, 1, 1, 4] and [k for k, b in blocks for k in range(k, k + len(b) - 1)] == [0, 1, 2, 3]
        assert all(len(b) == 2 or b[-1] - b[0] <= ids for _, b in blocks)
    with pytest.raises(ValueError):
        late = token_files.TokenFileWriter(Held(), 2)
        late.add(1, np.array([1]))
        late.add(None, np.array([1]))


@pytest.mark.parametrize("hot", [None, 5, -(2**63)])
def test_a_hot_id_fills_several_ranges(spark, monkeypatch, hot):
    """Half of all rows have one id, or none: they are dealt out, and the order holds over all files."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(hot, f"text {i} of the same id") for i in range(300)] + [(i, "w " * (i % 7)) for i in range(-100, 100)] + [(None, "a"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    cuts = token_files.range_cuts(df.select("doc_id"), 8)
    assert len(cuts) == 7 and len(set(cuts.tolist())) < 6
    manifest = token_files.write_token_files(df, path)
    assert manifest.agg(F.max("docs")).first()[0] < 200
    got = token_files.read_token_files(manifest, ids=True).orderBy("start").collect()
    key = lambda i: (i is not None, i or 0)
    assert [key(r["doc_id"]) for r in got] == sorted(key(i) for i, _ in rows)
    tokenizer = token_files._tokenizer(path)
    want = sorted((key(i), [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((key(r["doc_id"]), r["ids"]) for r in got) == want and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


# ---------------------------------------------------------------- n-gram join


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups, most):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice((2, 4, 9, 30, 80, 700)))
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append(" ".join(text))
    passage = " ".join(rng.choices(words, k=60))
    docs += [f"{passage} {' '.join(rng.choices(words, k=rng.randint(0, 50)))}" for _ in range(60)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def joined(spark, docs, **more):
    got = ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **more).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def test_join_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert joined(spark, docs) == brute_components(docs)
    docs = near_copies(1, 60, 8)
    assert joined(spark, docs) == brute_components(docs)


@pytest.mark.parametrize("block", [4, 9, 30])
def test_join_of_large_groups(spark, monkeypatch, block):
    """Frequent shingles as nodes, and groups of more than BLOCK documents in blocks."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "HUB", block)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "AGAIN", block + 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    docs = near_copies(2, 12, 60)
    assert joined(spark, docs) == brute_components(docs)


def test_long_lists_outside_the_table_of_frequent_buckets(spark, monkeypatch):
    """A shingle that the table misses counts as rare; its list is still a node once it is longer than HUB."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(ngram_join, "HUB", 5)
    docs = near_copies(7, 10, 40)
    assert joined(spark, docs) == brute_components(docs)


def test_buckets_are_counted_over_all_documents(spark, monkeypatch):
    """Counts of several flushes and tasks add up."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "COUNTED", 500)
    texts = [t for _, t in near_copies(8, 20, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bucket, n = ngram_join.frequent_buckets(df, 4, 8)
    own, _ = ngram_join.shingle_sets(pa.array(texts))
    want = {int(b): c for b, c in collections.Counter((own >> np.uint64(32)).tolist()).items() if c > 1}
    assert dict(zip(bucket.tolist(), n.tolist(), strict=True)) == want


def test_divide_skip_finds_every_link():
    texts = [t for _, t in near_copies(3, 40, 6)] + ["a b c d e f g h"] * 3
    own, at = ngram_join.shingle_sets(pa.array(texts))
    sets = [set(own[a:b].tolist()) for a, b in itertools.pairwise(at.tolist())]
    want = {frozenset((i, j)) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    pairs = lambda links: [(int(i), int(j)) for a, b in links for i, j in zip(a, b, strict=True)]
    got = [frozenset(p) for p in pairs(ngram_join.divide_skip(own, at))]
    assert len(got) == len(set(got)) and set(got) == want
    # With a forest: fewer links, of the same components.
    few = pairs(ngram_join.divide_skip(own, at, forest=ngram_join.Forest(len(sets))))
    roots = lambda p: components.local_roots(np.array([i for i, _ in p]), np.array([j for _, j in p]), len(sets)).tolist()
    assert {frozenset(p) for p in few} <= want and len(few) < len(want) and roots(few) == roots([tuple(p) for p in want])


def test_possible_pairs_lose_none():
    texts = [t for _, t in near_copies(4, 30, 6)]
    own, at = ngram_join.shingle_sets(pa.array(texts))
    sets = [own[a:b] for a, b in itertools.pairwise(at.tolist())]
    size = np.array([len(s) for s in sets])
    kept = {(int(i), int(j)) for a, b in ngram_join.possible_pairs(size, [ngram_join.bitmap(s) for s in sets], np.array([0, len(sets)])) for i, j in zip(a, b, strict=True)}
    every = len(sets) * (len(sets) - 1) // 2
    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(np.intersect1d(sets[i], sets[j]))
        assert (i, j) in kept or 100 * o < 85 * (len(sets[i]) + len(sets[j]) - o)
    assert len(kept) < every / 5


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_runs_end_where_keys_end(most):
    rng = random.Random(most)
    keys = sorted(rng.choices(range(40), k=200)) + [99] * 30
    batches = [pa.record_batch([pa.array(keys[a : a + 17], pa.int64())], names=["k"]) for a in range(0, len(keys), 17)]
    got = [t.column("k").to_pylist() for t in ngram_join.runs_of(batches, "k", most)]
    assert list(itertools.chain(*got)) == keys and all(len(x) <= most or len(set(x)) == 1 for x in got)
    assert all(a[-1] != b[0] for a, b in itertools.pairwise(got))
    assert list(ngram_join.runs_of([], "k", most)) == []


def test_sieve_loses_none(spark):
    ids = np.concatenate([np.arange(0, 5000, 7), [-5, 2**62, -(2**63)]])
    sieve = ngram_join.sieve_of(spark.createDataFrame([(int(i),) for i in ids], "node long").repartition(3))
    assert sieve.has(ids).all() and sieve.has(np.arange(10_000, 30_000)).mean() < 0.1
    assert not ngram_join.sieve_of(spark.createDataFrame([], "node long")).has(ids).any()


def test_packed_columns():
    rng = np.random.default_rng(0)
    for kind in ("u4", "u8", "i8"):
        x = np.sort(rng.integers(0, 1 << 30, 1000)).astype(kind)
        assert (ngram_join.unpack(ngram_join.pack(x, gaps=True), kind, gaps=True) == x).all() and (ngram_join.unpack(ngram_join.pack(x), kind) == x).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)]
    root = components.local_roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 400)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: int(root[i]) for i in {x for e in edges for x in e if e[0] != e[1]}}


# ---------------------------------------------------------------- nearest neighbours


def test_nearest_recall(spark, sf_dir):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[100]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.search(v, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(score == pytest.approx(s[i]) for i, score in got[q])
        hit += len({i for i, _ in got[q]} & set(order))
    assert hit / (150 * 20) >= 0.9


@pytest.mark.parametrize("least", [0.5, 1.0])
def test_probes_are_tuned_for_inner_products(least):
    """Norms between least and 2: the probed lists hold the neighbours by inner product of a table beyond the sample."""
    n, k = 6000, 20
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 24))
    x *= rng.uniform(least, 2, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(x[:1500], float(np.linalg.norm(x, axis=1).max()), n, k)
    asked = np.arange(0, n, 30)
    own = index.assign(index.augment(x))
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.stack([ann.places(o, own[i]) for o, i in zip(index.order(index.queries(x[asked])), near, strict=True)])
    assert (place < index.probes).mean() >= 0.93


def test_lists_grow_with_the_table(monkeypatch):
    """Beyond COARSE x PER_LIST vectors, lists are pairs of a coarse and a fine cell; the order of lists is that of the
    distances to the sums of both centroids, and probes are tuned on it."""
    monkeypatch.setattr(ann, "COARSE", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 12)) * rng.uniform(0.5, 2, (4000, 1))
    few, many = (ann.Index(x[:2000], float(np.linalg.norm(x, axis=1).max()), rows, 20) for rows in (2000, 128 * 16 * 10))
    assert few.lists == 15 and many.lists == 160 and len(many.fine) == 10
    q = many.queries(x[2000:2050])
    sums = (many.coarse[:, None] + many.fine).reshape(160, -1)
    for row, order in zip(q, many.order(q), strict=True):
        d = ((sums - row) ** 2).sum(axis=1)
        assert sorted(order.tolist()) == list(range(160)) and np.diff(d[order]).min() > -1e-9
    own = many.assign(many.augment(x))
    s = x[2000:2050] @ x.T
    s[np.arange(50), np.arange(2000, 2050)] = -np.inf
    near = np.argpartition(-s, 20, axis=1)[:, :20]
    place = np.stack([ann.places(o, own[i]) for o, i in zip(many.order(q), near, strict=True)])
    assert (place < many.probes).mean() >= 0.9 and many.probes < many.lists


def nearest(x, q, k=20):
    s = x @ x[q]
    return [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k], s


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings_table(spark, sf):
    """Whole tables, with a sample smaller than the table."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    got = collections.defaultdict(set)
    for r in queries.QUERIES["op6_nearest_neighbours"](spark, f"/root/testdata/{sf}").collect():
        got[r["query_id"]].add(r["vec_id"])
    asked = np.flatnonzero(ids % 20 == 0)
    hit = sum(len(got[int(ids[q])] & set(ids[nearest(x, q)[0]].tolist())) for q in asked)
    assert hit / (20 * len(asked)) >= 0.9


def test_doubles_are_scored_as_they_are(spark):
    """Ten vectors that agree as floats."""
    x = np.full((40, 4), 3.0) + np.arange(40)[:, None] * 1e-10
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(v, F.col("vec_id") == 0).orderBy("rank").collect()
    order, s = nearest(x, 0)
    assert [r["vec_id"] for r in got] == order and all(r["score"] == pytest.approx(s[r["vec_id"]], rel=1e-15) for r in got)


def test_blocks_of_vectors_meet_all_blocks_of_queries(spark, monkeypatch):
    """With tiny blocks and every list probed, answers are exact."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    monkeypatch.setattr(ann.Index, "_tune", lambda self: self.lists)
    x = np.random.default_rng(8).normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(v, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == {q: nearest(x, q)[0] for q in range(0, 300, 20)}


@pytest.mark.parametrize("probes", [None, 1])
def test_answers_come_from_the_lists(spark, monkeypatch, probes):
    """No other path makes up for lists that are not probed: with one list a query, the sample being the whole table, many
    neighbours are missed; with probes as tuned, the sample being a quarter of the table, few."""
    n = 4000
    monkeypatch.setattr(ann, "SAMPLE", n if probes else n // 4)
    if probes:
        monkeypatch.setattr(ann.Index, "_tune", lambda self: probes)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(n, 24)) * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(set)
    for r in ann.search(v, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    hit = sum(len(got[q] & set(np.argsort(-s[q])[:20].tolist())) for q in range(0, n, 20)) / (n // 20 * 20)
    assert all(len(got[q]) == 20 for q in range(0, n, 20)) and (hit < 0.7 if probes else hit >= 0.93)


def test_scan_abandons_early_but_keeps_the_near():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(5, 64))
    d = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    bound = np.sort(d, axis=1)[:, 20]
    i, j = ann.scan_list(x, q, bound, 21)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    near = {(a, int(b)) for a in range(5) for b in np.argsort(d[a])[:20]}
    assert len(found & near) >= 0.95 * len(near) and len(found) < 5 * 60


# ---------------------------------------------------------------- classifiers


def test_mil_gradients():
    rng = np.random.default_rng(0)
    model = quality_mil.Model(6, rng)
    x, at, y, w = rng.normal(size=(9, 6)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        p = model.forward(x, at)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in model.gradients(x, at, y, w).items():
        for i in list(np.ndindex(model.w[k].shape))[:5]:
            model.w[k][i] += 1e-5
            up = loss()
            model.w[k][i] -= 2e-5
            down = loss()
            model.w[k][i] += 1e-5
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_mil_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_quality_mil"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def plain_hash(word):
    """Of a word's bytes, in whole numbers."""
    codes = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64).tolist()
    base, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    return plain_mix((sum(codes[b] * pow(base, i, 1 << 64) for i, b in enumerate(word)) + len(word)) & full)


def plain_mix(h):
    full = (1 << 64) - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * factor & full
    return h ^ h >> 33


def plain_passages(text, per=64):
    """Encodings of a text's passages, byte by byte and word by word."""
    raw = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    groups = [words[i : i + per] for i in range(0, len(words), per)] or [[]]
    cuts = [0, *(g[0][0] for g in groups[1:]), len(raw)]
    marks = ".,;:?'\"-()"

    def kind(b):
        c = chr(b)
        return 7 if b > 127 else 0 if c in " \t\r\v\f" else 1 if c == "\n" else 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 5 if c in marks else 6

    out = []
    for (a, b), g in zip(itertools.pairwise(cuts), groups, strict=True):
        part, v = raw[a:b], np.zeros(quality_mil.WIDTH)
        for x in part:
            v[x if x < 128 else 128 + x % 8] += 1
        for x, y in itertools.pairwise(part):
            v[136 + kind(x) * 8 + kind(y)] += 1
        v[:200] = np.sqrt(v[:200] / max(1, len(part)))
        keys = [plain_hash(raw[s:e].lower()) for s, e in g]
        for x in keys:
            v[200 + (x >> 32) % 64] += 1
        for x, y in itertools.pairwise(keys):
            v[264 + (plain_mix((x * 3 + y) & ((1 << 64) - 1)) >> 32) % 64] += 1
        n = max(1, len(g))
        v[200:328] = np.sqrt(v[200:328] / n)
        first = words.index(g[0]) if g else 0
        v[328] = sum(i > 0 and raw[slice(*words[i])].lower() == raw[slice(*words[i - 1])].lower() for i in range(first, first + len(g))) / n
        v[329:] = math.log1p(len(g)), len(part) / n / 10
        out.append(v)
    return out


def test_mil_encoding_by_brute_force(spark, sf_dir):
    rng = random.Random(4)
    texts = [t for _, t in documents(spark, sf_dir)[:25]] + [None, "", "  \n", "a A a", "é" * 50, " ".join(rng.choices(["a", "B", "c1", "Δx", "!?"], k=300))]
    h, at = quality_mil.encode_passages(pa.array(texts))
    for i, t in enumerate(texts):
        want = plain_passages(t)
        assert at[i + 1] - at[i] == len(want) and np.allclose(h[at[i] : at[i + 1]], want, atol=1e-9)


def test_mil_forward_by_brute_force():
    rng = np.random.default_rng(1)
    model = quality_mil.Model(5, rng)
    x, at = rng.normal(size=(7, 5)), [0, 3, 4, 7]
    w = {k: v.tolist() for k, v in model.w.items()}
    dot = lambda a, m, j: sum(p * row[j] for p, row in zip(a, m, strict=True))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for bag, (a, b) in enumerate(itertools.pairwise(at)):
        e = [[math.tanh(dot(row, w["W"], j) + w["b"][j]) for j in range(len(w["b"]))] for row in x[a:b].tolist()]
        gated = [[math.tanh(dot(v, w["V"], j)) * sigmoid(dot(v, w["U"], j)) for j in range(len(w["a"]))] for v in e]
        power = [math.exp(dot(v, w["a"], 0)) for v in gated]
        z = [sum(p * v[j] for p, v in zip(power, e, strict=True)) / sum(power) for j in range(len(e[0]))]
        assert model.forward(x, np.array(at))["y"][bag] == pytest.approx(sigmoid(dot(z, w["c"], 0) + w["d"][0]))


def test_mil_sample_is_of_whole_documents(spark, monkeypatch):
    """The bound on passages leaves out documents, never parts of one; copies of a labelled row count once."""
    rows = [(i, " ".join(f"w{j}" for j in range(64 * (1 + i % 5)))) for i in range(30)] + [(3, "other text")] + [(4, "copy")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality_mil, "train", lambda h, at, label: seen.update(h=h, at=at, label=label))
    quality_mil.fit(docs, labels)
    assert len(seen["label"]) == 32 and len(seen["h"]) == sum(1 + i % 5 for i in range(30)) + 2
    quality_mil.fit(docs, labels, max_passages=20)
    assert 16 < len(seen["h"]) <= 20 and set(np.diff(seen["at"])) <= {1, 2, 3, 4, 5}
    quality_mil.fit(docs, labels, max_docs=4)
    assert len(seen["label"]) == 4


def test_mil_passages_cover_whole_texts():
    text = " ".join(f"word{i}" for i in range(1000))
    h, at = quality_mil.encode_passages(pa.array([text, None, "", "one"]))
    assert np.diff(at).tolist() == [16, 1, 1, 1] and np.isfinite(h).all()
    assert quality_mil.train(np.empty((0, quality_mil.WIDTH)), np.array([0]), np.empty(0)).constant == 0.5


def plain_ngrams(text, buckets=1 << 14):
    """Features of a text's 1- to 3-grams, character by character."""
    full, out = 0xFFFFFFFF, []
    chars = [c if c.isalpha() else " " for c in f" {text.lower()}  "] if text else []
    for i in range(len(chars) - 2):
        if "".join(chars[i : i + 3]).strip(" "):
            h = 0
            for c, factor in zip(chars[i : i + 3], (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), strict=True):
                h = (h ^ ord(c)) * factor & full
                h ^= h >> 15
                out.append((h * 0x27D4EB2F & full) >> 32 - (buckets.bit_length() - 1))
    return out


def test_langid_ngrams_by_brute_force(spark, sf_dir):
    texts = [t for _, t in documents(spark, sf_dir)[:40]] + [None, "", "x", "ab", "İstanbul ẞ", "漢字 🎉 a", "1 2 3", "a\n\nb", "über der"]
    features, at, has = langid.ngrams(texts)
    for i, t in enumerate(texts):
        assert features[at[i] : at[i + 1]].tolist() == plain_ngrams(t) and has[i] == any(c.isalpha() for c in (t or "").lower())


def test_langid_counts_and_scores_by_brute_force(spark):
    docs = [("de", "Über die Brücke, über"), ("en", "over the bridge"), ("en", "the over"), (None, "x"), ("fr", None), ("de", "über 12 der")]
    df = spark.createDataFrame(docs, "lang string, text string")
    counts = collections.Counter()
    for lang, t in docs:
        if lang and t:
            counts.update((lang, f) for f in plain_ngrams(t))
            counts[lang, -1] += 1
    assert {(r["lang"], r["bucket"]): r["n"] for r in langid.train_counts(df).collect()} == counts
    langs, prior, logp = langid.fit(df)
    assert langs == ["de", "en"] and np.exp(logp).sum(axis=1) == pytest.approx([1, 1])
    names, scores = langid.score_texts(["über der Brücke", "the bridge", "", None, "12 !?"], langs, prior, logp)
    assert names == ["de", "en", "und", "und", "und"] and scores[2:].tolist() == [0, 0, 0] and (scores[:2] > 0.5).all()
    many = langid.ngrams(["ab", "über der", "x"])
    for i, t in enumerate(["ab", "über der", "x"]):
        one = langid.ngrams([t])
        assert many[0][many[1][i] : many[1][i + 1]].tolist() == one[0].tolist()
    with pytest.raises(ValueError):
        langid.fit(df, max_langs=1)


@pytest.mark.parametrize("most", [1, 2])
def test_langid_blocks_of_languages_agree(spark, sf_dir, most):
    """Languages in several passes give what one pass gives, on rows with ties, no letters, nulls and clashing columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit(5).alias("_top"), F.lit("x").alias("a b"))
    more = spark.createDataFrame([(-1, None, "en", 1, "y"), (-2, "", "de", 1, "y"), (-3, "1 2 3", None, 1, "y"), (-4, "aaa", "zz", 1, "y"), (-5, "aaa", "zy", 1, "y")], docs.schema)
    docs = docs.unionByName(more)
    one, some = list(langid.blocks(docs)), list(langid.blocks(docs, most=most))
    assert len(one) == 1 and len(some) == -(-len(one[0][0]) // most) and sum((b[0] for b in some), []) == one[0][0]
    assert np.array_equal(np.concatenate([b[2] for b in some]), one[0][2]) and np.array_equal(np.concatenate([b[1] for b in some]), one[0][1])
    want, got = (langid.predict(docs.select("doc_id", "text", "_top", "a b"), m) for m in (one, some))
    assert got.columns == ["doc_id", "text", "a b", "lang_pred", "score"] == want.columns
    want, got = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in x.collect()} for x in (want, got))
    assert {i: g for i, (g, _) in got.items()} == {i: g for i, (g, _) in want.items()} and got[-1] == ("und", 0.0)
    assert [got[i][1] for i in sorted(got)] == pytest.approx([want[i][1] for i in sorted(want)], abs=1e-9)


def test_langid_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97


# ---------------------------------------------------------------- mixing


def test_targets_fill_like_water(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 50), ("d", 400), (None, 3)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    held, left = {}, 1.5 * 1463
    while True:  # share by weight, stop what is above, share the rest again
        open_ = [s for s, _ in sizes if s not in held]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * dict(sizes)[s]]
        if not full:
            break
        for s in full:
            held[s] = 2 * dict(sizes)[s]
            left -= held[s]
    assert got == pytest.approx(held | share)


def test_mix_is_near_its_targets_and_repeatable(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = mixing.mix(docs)
    per = a.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1.05 * r["m"] for r in per)
    rows = lambda d: sorted(tuple(r) for r in d.select("doc_id", "taken").collect())
    assert rows(a) == rows(mixing.mix(docs.repartition(5)))
