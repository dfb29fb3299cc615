"""An index of words: postings in blocks with what bounds their contribution, and searches that read only the blocks they need.

*Layout.* A segment's postings of a term are dealt out to slices by document, so that a term that every document has is
no one task's; within a slice and group they go in order of ids, in blocks of at most ``BLOCK``. A block tells its first and last
id, and the largest and smallest counts and lengths of its documents, which bound a BM25 contribution from above and below for any
corpus statistics. Files are partitioned by a hash of the term, so a search opens the folders of its terms alone.

*Segments.* A change adds a segment with the postings of new rows, the ids that are gone, and the change in counts, which may be
negative; a bound of a block holds without what is gone. Searches add up the segments; beyond ``FAN`` of them the writer merges
them into one, from postings, without a look at texts.

*Search* (MaxScore with block maxima). Counts give each term's weight. (1) Of every term, the blocks with the best lower bounds
give a score that enough documents reach; where too many documents are gone for counts to tell, the documents of a few such blocks. (2) Terms whose upper bounds together stay below it need not be looked through; of the
others, only blocks are read that could reach it together with all other terms. (3) Documents found there whose bound falls
below the best partial scores are dropped. (4) What is left looks up its other terms in the blocks whose range of ids has it. The
scores are those of the scan, summed in the same order."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.commits import Conflict, put_if_absent, read_text
from ..sources.records import replace_table
from .search import B, K1, question_terms

BLOCK, BUCKETS, SLICE_DOCS, FAN, SLACK, FEW = 128, 16, 1 << 20, 8, 1e-8, 4096
KEY = ("seg", "bucket", "term", "grp", "slice", "block")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _posted(rows: DataFrame, slices: int) -> DataFrame:
    """rows (id, grp, text) of unique ids -> (term, grp, slice, id, tf, dl). A text's words are sorted and each run is counted in its row, so
    counting shuffles nothing and keeps no table of words."""
    slice_ = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    own = rows.select("id", "grp", slice_, F.sort_array(tokens(F.col("text"))).alias("t")).where(F.size("t") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    own = own.select("id", "grp", "slice", "t", F.size("t").alias("dl"), starts.alias("starts"))
    counted = F.transform("starts", lambda s, j: F.struct(F.get("t", s).alias("term"), (F.coalesce(F.get("starts", j + 1), F.col("dl")) - s).alias("tf")))
    return own.select("id", "grp", "slice", "dl", F.explode(counted).alias("w")).select("w.term", "grp", "slice", "id", "w.tf", "dl")


def _blocks(posted: DataFrame, buckets: int, block: int) -> DataFrame:
    """(term, grp, slice, id, tf, dl) as blocks; all steps on one partitioning by bucket and slice, each one file."""
    dealt = posted.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition("bucket", "slice")
    nth = F.row_number().over(Window.partitionBy("bucket", "term", "slice", "grp").orderBy("id")) - 1
    own = dealt.withColumn("block", F.floor(nth / block).cast("int")).groupBy("bucket", "term", "slice", "grp", "block").agg(
        F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("p"), F.count(F.lit(1)).cast("int").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"),
        F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.min("tf").alias("least_tf"), F.max("dl").alias("most_dl"),
    )
    return own.select("bucket", "term", "grp", "slice", "block", "n", "first", "last", "most_tf", "least_dl", "least_tf", "most_dl", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


class WordIndex:
    """An index in a folder. ``meta.json`` fixes its buckets, slices and block size; numbered manifests name its segments."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        text = read_text(spark, f"{self.base}/meta.json")
        self.meta = json.loads(text) if text else None

    # ------------------------------------------------------------ writes

    @classmethod
    def create(cls, rows: DataFrame, base: str, *, id_col: str = "uuid", text: Column, group_col: str = "group_id", buckets: int = BUCKETS, block: int = BLOCK, slice_docs: int = SLICE_DOCS, of: str = "") -> WordIndex:
        """An index of rows, whose ids are unique, where there is none yet; ``of`` is a name of the state of the rows that it has.
        Only slices grow with the rows, so files are as many as rows ask for and not as their square."""
        spark, base = rows.sparkSession, base.rstrip("/")
        own = cls._own(rows, id_col, text, group_col)
        slices = max(1, math.ceil(own.count() / slice_docs))
        meta = {"buckets": buckets, "block": block, "slices": slices}
        if not put_if_absent(spark, f"{base}/meta.json", json.dumps(meta)):
            raise ValueError(f"{base}: there is an index already")
        index = cls(spark, base)
        index._publish([index._segment(own, None)], 0, of)
        return index

    @staticmethod
    def _own(rows: DataFrame, id_col: str, text: Column, group_col: str) -> DataFrame:
        return rows.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("grp"), text.alias("text")).where("id IS NOT NULL")

    def update(self, before: DataFrame, after: DataFrame, *, id_col: str = "uuid", text: Column, group_col: str = "group_id", of: str = "") -> None:
        """A segment of what differs between two states of the rows; ids are unique in each. The states meet once, and what differs is
        written: postings, counts and the ids that are gone are all read from there."""
        side = lambda rows, name: self._own(rows, id_col, text, group_col).select("id", F.xxhash64("grp", "text").alias("h"), F.struct("grp", "text").alias(name))
        both = side(before, "a").join(side(after, "b"), ["id", "h"], "full_outer").where("a IS NULL OR b IS NULL")
        changes = replace_table(both.select("id", F.col("b").isNotNull().alias("new"), F.coalesce("b", "a").alias("r")).select("id", "new", "r.grp", "r.text"), f"{self.base}/changes")
        held = self.spark.read.schema("id string, new boolean, grp string, text string").parquet(changes)
        segments, number = self._segments()
        segments = [*segments, self._segment(held.where("new").drop("new"), held.where("NOT new").drop("new"))]
        self._publish([self._merged(segments)] if len(segments) > FAN else segments, number, of)
        self._drop(changes)

    def _segment(self, added: DataFrame, gone: DataFrame | None) -> str:
        """Blocks, counts of terms, counts of groups and the ids that are gone, as tables of a folder of their own."""
        path, m = f"{self.base}/segments/{uuid.uuid4().hex}", self.meta
        _blocks(_posted(added, m["slices"]), m["buckets"], m["block"]).sortWithinPartitions("bucket", "term", "slice", "grp", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
        counts = self.spark.read.parquet(f"{path}/blocks") if self._any(f"{path}/blocks") else None
        parts, terms = [added.select("grp", F.lit(1).alias("n"), F.lit(0).alias("dl"))], []
        if counts is not None:  # words of all texts together are those of the blocks, so that no text is taken apart for its length
            parts.append(counts.select("grp", F.lit(0).alias("n"), F.aggregate("tfs", F.lit(0), lambda s, x: s + x).alias("dl")))
            terms.append(counts.select("term", "grp", "n"))
        if gone is not None:
            parts.append(gone.select("grp", F.lit(-1).alias("n"), (-F.size(tokens(F.col("text")))).alias("dl")))
            terms.append(_posted(gone, 1).select("term", "grp", F.lit(-1).alias("n")))
            gone.select("id").write.parquet(f"{path}/gone")
        self._write_counts(path, terms, parts)
        return path

    def _write_counts(self, path: str, terms: list[DataFrame], parts: list[DataFrame]) -> None:
        whole, groups = terms[0] if terms else self.spark.createDataFrame([], "term string, grp string, n int"), parts[0]
        for t in terms[1:]:
            whole = whole.union(t)
        for p in parts[1:]:
            groups = groups.union(p)
        df = whole.groupBy("term", "grp").agg(F.sum("n").alias("df")).withColumn("bucket", bucket_of(F.col("term"), self.meta["buckets"]))
        df.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms")
        groups.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("dl").cast("long").alias("dl")).coalesce(1).write.parquet(f"{path}/groups")

    def _merged(self, segments: list[str]) -> str:
        """One segment of several, without what is gone."""
        path, m = f"{self.base}/segments/{uuid.uuid4().hex}", self.meta
        posted = self._postings(self._read(segments, "blocks"), segments).select("term", "grp", "slice", "id", "tf", "dl")
        _blocks(posted, m["buckets"], m["block"]).sortWithinPartitions("bucket", "term", "slice", "grp", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
        terms = self._read(segments, "terms").select("term", "grp", F.col("df").alias("n"))
        self._write_counts(path, [terms], [self._read(segments, "groups").select("grp", "n", "dl")])
        return path

    def _manifest(self) -> tuple[dict, int]:
        """(the last manifest, its number)."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/manifests")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName().removesuffix(".json") for s in fs.listStatus(where)] if fs.exists(where) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return (json.loads(read_text(self.spark, f"{self.base}/manifests/{number:012d}.json")), number) if number else ({"segments": [], "of": None}, 0)

    def _segments(self) -> tuple[list[str], int]:
        """(segments, oldest first; the number of their manifest)."""
        held, number = self._manifest()
        return held["segments"], number

    @property
    def of(self) -> str | None:
        """The state of the rows that the index has; None for none."""
        return self._manifest()[0]["of"]

    def _publish(self, segments: list[str], after: int, of: str) -> None:
        if not put_if_absent(self.spark, f"{self.base}/manifests/{after + 1:012d}.json", json.dumps({"segments": segments, "of": of})):
            raise Conflict(f"{self.base}: another writer came first")

    def _drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    # ------------------------------------------------------------ reads

    def _any(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(where) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(where))

    _SCHEMAS = {
        "blocks": "term string, grp string, slice int, block int, n int, first string, last string, most_tf int, least_dl int, least_tf int, most_dl int, ids array<string>, tfs array<int>, dls array<int>, bucket int",
        "terms": "term string, grp string, df long, bucket int", "groups": "grp string, n long, dl long", "gone": "id string",
    }

    def _read(self, segments: list[str], name: str) -> DataFrame:
        """A table of all segments, with the number of the segment."""
        out = None
        for i, path in enumerate(segments):
            if self._any(f"{path}/{name}"):
                one = self.spark.read.schema(self._SCHEMAS[name]).parquet(f"{path}/{name}").withColumn("seg", F.lit(i))
                out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], self._SCHEMAS[name] + ", seg int") if out is None else out

    def _postings(self, blocks: DataFrame, segments: list[str]) -> DataFrame:
        """Blocks as postings (term, grp, slice, id, tf, dl), without those of ids that a later segment has as gone."""
        p = blocks.select("seg", "term", "grp", "slice", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("seg", "term", "grp", "slice", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        return self._alive(p, segments)

    def _alive(self, p: DataFrame, segments: list[str]) -> DataFrame:
        gone = self._read(segments, "gone").groupBy("id").agg(F.max("seg").alias("until"))
        return p.join(gone, "id", "left").where("until IS NULL OR seg >= until").drop("until")

    def look_up(self, terms: Sequence[str], groups: Sequence[str] | None = None) -> DataFrame:
        """(term, grp, slice, id, tf, dl, seg): the postings of the terms."""
        segments, _ = self._segments()
        return self._postings(self._of(self._read(segments, "blocks"), terms, groups), segments)

    def _of(self, df: DataFrame, terms: Sequence[str], groups: Sequence[str] | None) -> DataFrame:
        """Rows of the terms: the folders are named as literals, so that others are not listed as inputs of the scan."""
        buckets = sorted(r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.meta["buckets"])).distinct().collect())
        df = df.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        return df if groups is None else df.where(F.col("grp").isin(list(groups)))

    def search(self, question: str, limit: int, groups: Sequence[str] | None = None, *, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score): the ``limit`` best by BM25, ties by id, of all or of the groups, whose own statistics count."""
        segments, _ = self._segments()
        held = self._read(segments, "groups")
        held = held if groups is None else held.where(F.col("grp").isin(list(groups)))
        of = held.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        n, avgdl = of["n"] or 0, ((of["dl"] or 0) / of["n"] if of["n"] else 0.0) or 1.0
        terms = question_terms(question)
        counts = {r["term"]: r["df"] for r in self._of(self._read(segments, "terms"), terms, groups).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        part = lambda weight, tf, dl: weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))  # noqa: E731  as the scan has it
        blocks = self._of(self._read(segments, "blocks"), terms, groups)
        one = F.lit(1.0)
        blocks = blocks.withColumn("above", part(one, F.col("most_tf"), F.col("least_dl"))).withColumn("below", part(one, F.col("least_tf"), F.col("most_dl")))
        most = {r["term"]: r["m"] for r in blocks.groupBy("term").agg(F.max("above").alias("m")).collect()}
        live = [t for t in terms if counts.get(t, 0) > 0 and t in most]
        if not live:
            return self.spark.createDataFrame([], "id string, score double")
        inside = {t: 1 + (n - counts[t] + 0.5) / (counts[t] + 0.5) for t in live}
        idf = {t: math.log(x) for t, x in inside.items()}
        upper = {t: idf[t] * most[t] for t in live}
        whole = sum(upper.values())

        def weighed(found: DataFrame) -> DataFrame:
            place, weight, bound = (F.lit(None).cast(kind) for kind in ("int", "double", "double"))
            for i, t in enumerate(live):
                is_t = F.col("term") == t
                place, weight, bound = F.when(is_t, F.lit(i)).otherwise(place), F.when(is_t, F.log(F.lit(inside[t]))).otherwise(weight), F.when(is_t, F.lit(upper[t])).otherwise(bound)
            return found.where(F.col("term").isin(live)).withColumn("i", place).withColumn("c", part(weight, F.col("tf"), F.col("dl"))).withColumn("upper", bound)

        # (1) What enough documents reach by one term: from narrow columns of the blocks with the best lower bounds.
        least, dead = -math.inf, self._read(segments, "gone").count()
        if dead <= FEW:
            wanted = limit + dead
            nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("below"), F.desc("n")))
            reached = dict.fromkeys(live, 0)
            for r in blocks.select("term", "n", "below").withColumn("nth", nth).where(F.col("nth") <= wanted).orderBy("term", "nth").collect():
                if (t := r["term"]) in reached and reached[t] < wanted:
                    reached[t] += r["n"]
                    if reached[t] >= wanted:
                        least = max(least, idf[t] * r["below"])

        else:  # counts do not tell how many of a block are left: those of a few blocks of each term are looked at
            nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("below"), F.desc("seg"), F.desc("n")))
            best = blocks.select(*KEY, "below", "n").withColumn("nth", nth).where(F.col("nth") <= limit).select(*KEY)
            probed = weighed(self._postings(blocks.join(F.broadcast(best), list(KEY)), segments))
            reached = [r["c"] for r in probed.groupBy("id").agg(F.sum("c").alias("c")).orderBy(F.desc("c")).limit(limit).select("c").collect()]
            least = reached[-1] if len(reached) == limit else least

        # (2) Terms whose bounds together stay below that are only looked up; of the others, the blocks that could reach it.
        only_looked_up, total = set(), 0.0
        for t in sorted(live, key=upper.get):
            if total + upper[t] >= least - SLACK:
                break
            total += upper[t]
            only_looked_up.add(t)
        reach = F.lit(False)
        for t in live:
            if t not in only_looked_up:
                reach = reach | ((F.col("term") == t) & (F.col("above") * idf[t] + (whole - upper[t]) >= least - SLACK))

        # (3) Partial scores, and what they could become.
        partial = weighed(self._postings(blocks.where(reach), segments)).groupBy("id").agg(F.first("slice").alias("slice"), F.sum("c").alias("partial"), (F.sum("c") + F.lit(whole) - F.sum("upper")).alias("bound"))
        best = [r["partial"] for r in partial.select("partial").orderBy(F.desc("partial")).limit(limit).collect()]
        least = max(least, best[-1]) if len(best) == limit else least
        left = partial.where(F.col("bound") >= least - SLACK).select("id", "slice")

        # (4) All terms of what is left, from the blocks whose range has it: few go to all tasks, many meet the postings by id.
        few = left.limit(FEW + 1).collect()
        if len(few) <= FEW:
            asked = F.broadcast(self.spark.createDataFrame([tuple(r) for r in few], "id string, _s int"))
            near = blocks.join(asked, (F.col("slice") == F.col("_s")) & (F.col("id") >= F.col("first")) & (F.col("id") <= F.col("last")))
            near = near.withColumn("at", F.array_position("ids", F.col("id")).cast("int")).where("at > 0")
            found = self._alive(near.select("seg", "term", "id", F.element_at("tfs", F.col("at")).alias("tf"), F.element_at("dls", F.col("at")).alias("dl")), segments)
        else:
            found = self._postings(blocks, segments).join(left.select("id"), "id", "left_semi")
        scored = weighed(found).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs"))
        score = F.round(F.aggregate("cs", F.lit(0.0), lambda s, x: s + x["c"]), 9)
        return scored.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
