"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Tables other than documents (labels) are read from sf_dir.

1. language ID: documents without a recognised language go.
2. quality rules: documents that fail the base rules or a risk-controlled cutoff go.
3. n-gram Jaccard join: of every component of near copies, the document with the smallest id stays.
4. mixing sources to target weights: a document appears as often as the mix takes it, twice at most; untaken ones go.
5. SentencePiece encoding: the ids of every row, with their count and checksum, and whether they decode to the text.

Defined results. A null or empty text, or one without a letter, goes in stage 1. A null language has no cutoffs of its own, a null
source is a source. Rows without an id, or that share one, are told apart by keys of the stages' own and each meet their own
verdict; of rows that are near copies, one without an id stays only if none has one. Repeated rows are copies of one text, so one stays,
and may then be taken twice. Columns beside those named pass through, whatever their names. An empty table gives no rows.

What a stage writes on its way is deleted once its own result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import common, langid, mixing, ngram_join, quality_rules, sentencepiece_fst

STAGES = [
    ("language_id", langid.filter_stage),
    ("quality_rules", quality_rules.filter_stage),
    ("ngram_join", ngram_join.dedupe_stage),
    ("mix_sources", mixing.mix_stage),
    ("sentencepiece", sentencepiece_fst.encode_stage),
]

#: SQL cannot take shortest paths through a transducer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.Scratch(spark):
            docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
