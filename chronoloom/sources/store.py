"""A graph and its queue as tables under one commit log, and the word indexes beside them.

A write of tables is one commit and never touches older versions; a read takes the last commit, so one that began before a write goes
on with what it had, and the next sees the write, of all tables or of none. An index tells which version of its kind it has: a search
uses it where that is the one it reads, and scans otherwise."""

from __future__ import annotations

import contextlib
import tempfile
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.checks import counted_checks
from ..operators.index import WordIndex
from ..operators.reads import in_groups
from ..operators.search import Asked, Found, find_facts, find_nodes
from .commits import CommitLog, Conflict, Snapshot, Transaction
from .records import replace_table
from .views import KINDS, PROPOSAL

TABLES = {**KINDS, "queue": PROPOSAL, "archive": PROPOSAL}

# What is indexed by its words: (kind, columns).
INDEXES = {"episode_content": ("episodic_node", ("content",)), "node_name_and_summary": ("entity_node", ("name", "summary")), "edge_name_and_fact": ("entity_edge", ("name", "fact"))}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a folder of our own only where all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that all share: what several outputs read is computed once, and plans do not grow."""
    return df.sparkSession.read.schema(df.schema).parquet(replace_table(df, f"{shared_dir(df.sparkSession)}/chronoloom-{name}"))


def fitted(rows: DataFrame, name: str) -> DataFrame:
    """rows in the columns and types of a table; what they lack is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.log = CommitLog(spark, self.base, TABLES)

    def set_up(self) -> None:
        """Empty tables, in one commit, where there is no commit yet."""
        if not self.log.head():
            with self.log.transaction("set up") as t:
                for name, schema in TABLES.items():
                    t.write(name, self.spark.createDataFrame([], schema))

    def write(self, kind: str, rows: DataFrame) -> int:
        """Replace a table, whatever it was: the number of the commit."""
        return self.write_all({kind: rows})

    def write_all(self, tables: dict[str, DataFrame]) -> int:
        """Replace tables in one commit."""
        staged = {name: self.log.stage(name, fitted(rows, name)) for name, rows in tables.items()}
        while True:
            try:
                return self.log.commit(staged, self.log.head())
            except Conflict:  # another came between; what is there is replaced all the same
                continue

    def change(self, work: Callable[[Transaction], object], note: str = ""):
        """What ``work`` gives, which reads and writes tables in a transaction; done anew where another commit came between."""
        return self.log.retried(work, note=note)

    def read(self, kind: str, groups: list[str] | None = None, number: int | None = None) -> DataFrame:
        return in_groups(self.log.at(number).read(kind), groups)

    def counts(self, number: int | None = None) -> dict[str, int]:
        """Rows of every table of a commit, as its writes counted them: no table is read."""
        return {kind: of["rows"] for kind, of in self.log.at(number).counts.items()}

    def checks(self, number: int | None = None) -> DataFrame:
        """(kind, check, status, detail) of a commit's rows, as its writes counted them; ``data_checks`` has those that need joins."""
        return counted_checks(self.spark, self.log.at(number).counts)

    def sql(self, text: str, **args) -> DataFrame:
        """A query over the tables of one commit, with named parameters (:name)."""
        held = self.log.at()
        for name in TABLES:
            held.read(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args)

    # ------------------------------------------------------------ indexes

    def index(self, name: str) -> WordIndex:
        return WordIndex(self.spark, f"{self.base}/indexes/{name}")

    def build_indexes(self) -> None:
        """Bring every index to the last commit: a segment of what changed since the version that it has."""
        held = self.log.at()
        for name, (kind, columns) in INDEXES.items():
            index, path, text = self.index(name), held.paths.get(kind, ""), F.concat_ws(" ", *columns)
            if index.meta is None:
                WordIndex.create(held.read(kind), index.base, text=text, of=path)
            elif (had := index.of) != path:
                before = self.spark.read.schema(KINDS[kind]).parquet(had) if had else self.spark.createDataFrame([], KINDS[kind])
                index.update(before, held.read(kind), text=text, of=path)

    def missing_indexes(self) -> list[str]:
        """Indexes that are not there, or do not have the last commit."""
        held = self.log.at()
        return [n for n, (kind, _) in INDEXES.items() if self._fit(n, kind, held) is None]

    def _fit(self, name: str, kind: str, held: Snapshot) -> WordIndex | None:
        index = self.index(name)
        return index if index.meta is not None and index.of == held.paths.get(kind, "") else None

    def look_up(self, index: str, terms: list[str]) -> DataFrame:
        """(uuid, term, tf, dl) of the terms, read from the index alone."""
        return self.index(index).look_up(terms).select(F.col("id").alias("uuid"), "term", "tf", "dl")

    def find_facts(self, asked: Asked, now: Column, **how) -> Found:
        """The search of facts of the last commit, through the index where it has that commit."""
        held = self.log.at()
        return find_facts(held.read("entity_edge"), asked, now, index=self._fit("edge_name_and_fact", "entity_edge", held), **how)

    def find_nodes(self, asked: Asked) -> Found:
        held = self.log.at()
        return find_nodes(held.read("entity_node"), asked, edges=held.read("entity_edge"), index=self._fit("node_name_and_summary", "entity_node", held))


def term_counts(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, dl). Texts are dealt out by id before they are taken apart, so words are counted where they are and never shuffled."""
    own = rows.select(id_col, text.alias("_text")).repartition(id_col).select(id_col, tokens(F.col("_text")).alias("t"))
    own = own.select(id_col, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return own.groupBy(id_col, "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select(id_col, "term", "tf", "dl")


def postings(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, dl), sorted by term in its files, so that a read of a term skips the others' row groups."""
    return term_counts(rows, id_col, text).repartitionByRange("term", id_col).sortWithinPartitions("term", id_col)


@contextlib.contextmanager
def bounded(spark: SparkSession, seconds: float, what: str) -> Iterator[None]:
    """Cancel the jobs that are started inside once the time is over; then it is a TimeoutError."""
    name, late = f"bounded-{what}", threading.Event()
    spark.sparkContext.setJobGroup(name, what, interruptOnCancel=True)

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(name)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"{what}: more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
