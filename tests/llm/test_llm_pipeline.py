"""The pipeline against a plain version of each stage."""

import pathlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tests.llm.test_llm_new import plain_components
from tests.llm.test_llm_ops import plain_ngrams

import corpus_pipeline
from chronoloom.llm import langid, mixing, ngram_join, quality_rules


def planted(sf_dir, at):
    """The tables with pairs of 141 words, three of them changed: 122 of 152 shingles of five words are shared (80.3 %), 126 of 150 of
    four (84 %), so the stage's rule links them and that of the query of its own does not."""
    import pandas as pd

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    more = []
    for text in docs[docs["lang"] == "en"]["text"]:
        words = (text or "").split()[:141]
        if len(words) == 141 and len(set(words)) > 80 and len(more) < 20:
            other = [f"{w}x" if i in (30, 70, 110) else w for i, w in enumerate(words)]
            more += [(10**6 + len(more), " ".join(words)), (10**6 + 1 + len(more), " ".join(other))]
    extra = docs.iloc[: len(more)].copy()
    extra["doc_id"], extra["text"], extra["lang"], extra["n_chars"] = [i for i, _ in more], [x for _, x in more], "en", [len(x) for _, x in more]
    pd.concat([docs, extra.astype(docs.dtypes)]).to_parquet(f"{at}/documents.parquet", index=False)
    (at / "labels.parquet").symlink_to(pathlib.Path(f"{sf_dir}/labels.parquet"))
    return str(at)


@pytest.mark.parametrize("which", ["given", "planted"])
def test_pipeline_by_brute_force(spark, sf_dir, tmp_path, which):
    import pandas as pd

    sf_dir = sf_dir if which == "given" else planted(sf_dir, tmp_path)

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    # 1. Naive Bayes with counters.
    rows = [(i, t, g) for i, t, g in zip(docs["doc_id"], docs["text"], docs["lang"], strict=True)]
    learn = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2 and g is not None and t is not None]
    langs = sorted({g for _, g in learn})
    n = np.full((len(langs), langid.BUCKETS), langid.SMOOTHING)
    for t, g in learn:
        np.add.at(n[langs.index(g)], plain_ngrams(t), 1)
    prior = np.log((np.array([sum(g == x for _, g in learn) for x in langs]) + 1) / (len(learn) + len(langs)))
    logp = np.log(n / n.sum(axis=1, keepdims=True))
    keep = []
    for _, t, _ in rows:
        f, has = plain_ngrams(t), any(c.isalpha() for c in (t or "").lower())
        ll = logp[:, f].sum(axis=1) * min(len(f), langid.EVIDENCE) / max(len(f), 1) + prior
        keep.append(has and 1 / np.exp(ll - ll.max()).sum() >= 0.5)
    documents = docs[keep]
    # 2. and 4. in SQL; 3. pair by pair.
    con = duckdb.connect()
    con.register("labels", pd.read_parquet(f"{sf_dir}/labels.parquet"))
    con.register("documents", documents)
    kept = con.execute(f"SELECT doc_id FROM ({quality_rules.OP2_SQL}) WHERE kept").fetchall()
    documents = documents[documents["doc_id"].isin([r[0] for r in kept])]
    rows = list(zip(documents["doc_id"], documents["text"], strict=True))
    group = plain_components(rows, ngram_join.STAGE_SHINGLE, ngram_join.STAGE_PERCENT)
    roots = lambda g: {i: r for i, (_, r) in g.items()}
    assert which == "given" or roots(group) != roots(plain_components(rows, ngram_join.SHINGLE, ngram_join.PERCENT))
    documents = documents[[group[i][1] == i for i in documents["doc_id"]]]
    con.register("documents", documents)
    copies = dict(con.execute(f"SELECT doc_id, taken // size FROM ({mixing.OP9_SQL}) WHERE taken > 0").fetchall())
    # 5. with the library.
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in zip(documents["doc_id"], documents["text"], strict=True):
        want += [(i, lib.encode(t))] * int(copies.get(i, 0))
    got = [(r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50
