"""Gates of the write path, as columns over proposals: the first rule that refuses, secrets, atomicity, rejections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import content_digest
from ..functions.text import secret_shapes, sentences, words

# Fixed values.
FACT_TYPES = ("belief", "source-fact", "action-record", "live-finding")
OPERATIONS = ("assert", "revise", "invalidate", "retire")
EXIT = {"rejected": 2, "not_atomic": 4, "resembles_rejected": 5, "secret": 6}
SIMILARITY = 0.75
SENT_WORDS = 200_000  # words of rejections that go to all tasks


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def first_refusal(proposals: DataFrame, *, require_source: bool = False) -> DataFrame:
    """proposals (facts array, fact_type, operation, supersedes, provenance, source, link, said) with ``refusal``, the
    name of the first filing rule that refuses, null if none does."""
    n = F.size(F.filter(F.coalesce("facts", F.array().cast("array<string>")), lambda t: F.trim(t) != ""))
    rules = [
        ("fact_type", ~F.coalesce(F.col("fact_type").isin(list(FACT_TYPES)), F.lit(False))),
        ("operation", ~F.coalesce(F.col("operation").isin(list(OPERATIONS)), F.lit(False))),
        ("empty", n == 0),
        ("supersedes", (F.col("operation") != "assert") & _blank("supersedes")),
        ("bundle_source", (n > 1) & _blank("provenance") & _blank("source") & _blank("link") & _blank("said")),
        ("source_required", F.lit(require_source) & (_blank("source") | _blank("link"))),
    ]
    return proposals.withColumn("refusal", F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules]))


def gate_codes(proposals: DataFrame, rejected: DataFrame | None = None, *, threshold: float = SIMILARITY, require_source: bool = False) -> DataFrame:
    """proposals with refusal, secrets, n_sentences and exit_code: 2 a filing rule, 6 a secret, 4 a fact of several
    sentences, 5 one that resembles a rejection (id in ``resembles``) that is not named as superseded; 0 none."""
    p = first_refusal(proposals, require_source=require_source)
    texts = F.concat_ws("\n", "facts")
    p = p.withColumn("secrets", secret_shapes(texts, *[F.col(c) for c in ("supersedes", "provenance", "source", "link", "said")]))
    p = p.withColumn("n_sentences", F.coalesce(F.array_max(F.transform("facts", lambda t: F.size(sentences(t)))), F.lit(0)))
    if rejected is not None:
        facts = p.select("id", "domain", F.explode("facts").alias("text"))
        hits = rejected_matches(facts, rejected, threshold).groupBy("id").agg(F.collect_set("rejected_id").alias("hits"), F.max("ratio").alias("ratio"))
        p = p.join(hits, "id", "left")
        named = F.coalesce(F.array_contains("hits", F.col("supersedes_rejection")), F.lit(False))
        p = p.withColumn("resembles", F.when(~named, F.array_min("hits"))).drop("hits")
    else:
        p = p.withColumn("resembles", F.lit(None).cast("string"))
    code = F.when(F.col("refusal").isNotNull(), EXIT["rejected"]).when(F.size("secrets") > 0, EXIT["secret"])
    code = code.when(F.col("n_sentences") > 1, EXIT["not_atomic"]).when(F.col("resembles").isNotNull(), EXIT["resembles_rejected"])
    return p.withColumn("exit_code", code.otherwise(0))


def rejected_matches(texts: DataFrame, rejected: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """texts (id, domain, text) and rejected (id, domain, facts) -> (id, text, rejected_id, ratio): pairs of one domain
    whose word sets have a Jaccard ratio of the threshold or more, the best over a rejection's facts.

    An exact prefix join: a rejection of n words shares one of the first n - ceil(threshold n) + 1 of them, from rare to common among the
    rejections, with any set that reaches the threshold; only those words are posted. Texts whose number of words no rejection could
    reach are left out first. Up to SENT_WORDS posted words go to all tasks, so that texts are compared where they are read and only
    matches are shuffled. Two empty sets are equal; they meet under a word of their own."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0, at most 1")
    digest = lambda c: F.md5(F.coalesce(c, F.lit("")))
    blank = lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(w)
    refused = rejected.select(F.col("id").alias("rejected_id"), "domain", F.explode("facts").alias("text")).withColumn("key_b", digest(F.col("text")))
    right = refused.groupBy("domain", "key_b").agg(F.first("text").alias("text")).select("domain", "key_b", words(F.col("text")).alias("w_b"))
    long = right.select("domain", "key_b", "w_b", F.explode(blank(F.col("w_b"))).alias("word"))
    count = F.count(F.lit(1)).over(Window.partitionBy("domain", "word"))
    place = F.row_number().over(Window.partitionBy("domain", "key_b").orderBy("n", "word"))
    size = F.size("w_b")
    posted = long.withColumn("n", count).withColumn("place", place).where(F.col("place") <= F.greatest(size, F.lit(1)) - F.ceil(F.lit(threshold) * F.greatest(size, F.lit(1)) - 1e-9) + 1).select("domain", "word", "key_b", "w_b")
    of = right.agg(F.coalesce(F.sum(F.greatest(size, F.lit(1))), F.lit(0)).alias("words"), F.coalesce(F.min(size), F.lit(0)).alias("least"), F.coalesce(F.max(size), F.lit(0)).alias("most")).first()
    posted = F.broadcast(posted) if of["words"] <= SENT_WORDS else posted

    # A filter on the words must not be pushed below them, where they would be found anew: a column that is not deterministic keeps it above.
    left = texts.select("id", "domain", "text", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("_row"))
    left = left.where((F.size("w") >= F.lit(threshold * of["least"] - 1e-9)) & (F.size("w") <= F.lit(of["most"] / threshold + 1e-9)) & (F.col("_row") >= 0))
    small, large = F.least(F.size("w"), size), F.greatest(F.size("w"), size)
    met = left.select("id", "domain", "text", "w", F.explode(blank(F.col("w"))).alias("word")).join(posted, ["domain", "word"]).where(small >= F.lit(threshold) * large - 1e-9)
    # Sets without repetitions: what they share tells what either has.
    both = F.size(F.array_intersect("w", "w_b"))
    ratio = F.when(large == 0, F.lit(1.0)).otherwise(both / (F.size("w") + size - both))
    close = met.select("id", "domain", "text", "key_b", ratio.alias("ratio")).where(F.col("ratio") >= threshold)
    close = close.withColumn("key", digest(F.col("text"))).groupBy("id", "domain", "key", "key_b").agg(F.first("text").alias("text"), F.max("ratio").alias("ratio"))
    found = close.join(refused.select("rejected_id", "domain", "key_b"), ["domain", "key_b"])
    best = found.groupBy("id", "domain", "key", "rejected_id").agg(F.first("text").alias("text"), F.max("ratio").alias("ratio"))
    return best.select("id", "text", "rejected_id", "ratio")


def ranked_matches(matches: DataFrame, rejected: DataFrame, most: int = 5) -> DataFrame:
    """For each proposal, the rejections it resembles most: by ratio, of equals the newest decision, and of them the smallest id
    first, ``most`` of them; with place, and text and reason of the rejection."""
    own = rejected.select(F.col("id").alias("rejected_id"), F.col("text").alias("rejected_text"), "reason", F.coalesce("decided_at", F.lit("")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ratio"), F.desc("_at"), "rejected_id"))
    best = matches.groupBy("id", "rejected_id").agg(F.max("ratio").alias("ratio"))
    return best.join(own, "rejected_id").withColumn("place", place).where(F.col("place") <= most).drop("_at")


@dataclass(frozen=True)
class ApproveRule:
    """Approve a new fact of a type that carries the evidence: "source-link", or "said"."""

    fact_type: str
    require: str

    def __post_init__(self):
        if self.fact_type not in FACT_TYPES[1:] or self.require not in ("source-link", "said"):
            raise ValueError(f"not a rule: {self}")


def approving_rule(proposals: DataFrame, rules: list[ApproveRule]) -> DataFrame:
    """proposals with ``rule``, the first that approves. Corrections, and what supersedes a rejection, wait for a person."""
    has = lambda c: ~_blank(c)
    when = [F.when((F.col("fact_type") == r.fact_type) & (has("said") if r.require == "said" else has("source") & has("link")), F.lit(f"policy:{r.fact_type}:{r.require}")) for r in rules]
    found = F.coalesce(*when) if when else F.lit(None).cast("string")
    return proposals.withColumn("rule", F.when((F.col("operation") == "assert") & _blank("supersedes_rejection"), found))


def decidable(status: str) -> Column:
    """Whether a reviewer can now give a proposal the status approved or rejected."""
    if status == "approved":
        again = F.col("approved_digest").isNull()
    else:
        again = _blank("draining_at") & (F.coalesce(F.size("landed"), F.lit(0)) <= 0)
    return F.when(F.col("status") == "pending", True).when(F.col("status") == "approved", again).otherwise(False)


def binding_error(columns: list[str]) -> Column:
    """Why an approved proposal may not land: it has no digest, or its content changed since."""
    return F.when(F.col("approved_digest").isNull(), "missing").when(F.col("approved_digest") != content_digest(columns), "mismatch")
