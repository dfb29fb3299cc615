"""The graph's records as views of the driver's tables, and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOW = "2024-01-16 00:00:00"  # the instant at which graded queries ask; never the clock

_s, _t = T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ENTITY = _struct(uuid=_s, name=_s, group_id=_s, labels=T.ArrayType(_s), created_at=_t, summary=_s, attributes=T.MapType(_s, _s), name_embedding=T.ArrayType(T.FloatType()))
EPISODE = _struct(uuid=_s, name=_s, group_id=_s, source=_s, source_description=_s, content=_s, valid_at=_t, created_at=_t, entity_edges=T.ArrayType(_s), labels=T.ArrayType(_s))
FACT = _struct(uuid=_s, name=_s, fact=_s, source_node_uuid=_s, target_node_uuid=_s, episodes=T.ArrayType(_s), group_id=_s, created_at=_t, valid_at=_t, invalid_at=_t, expired_at=_t, fact_embedding=T.ArrayType(T.FloatType()))
MENTION = _struct(uuid=_s, group_id=_s, source_node_uuid=_s, target_node_uuid=_s, created_at=_t)
PROPOSAL = _struct(
    id=_s, created_at=_s, domain=_s, fact_type=_s, provenance=_s, source=_s, link=_s, valid_at=_s, learned_at=_s, supersedes_rejection=_s, said=_s, operation=_s, text=_s,
    facts=T.ArrayType(_s), edges=T.ArrayType(_s), supersedes=_s, status=_s, decided_at=_s, decided_by=_s, approved_digest=_s, reason=_s, draining_at=_s,
    landed=T.ArrayType(T.IntegerType()), episodes=T.ArrayType(_s), drained_at=_s, retracts=_s, retired=T.ArrayType(_s), already_invalid=T.ArrayType(_s),
)
RECORD = _struct(name=_s, body=_s, domain=_s, valid_at=_s, provenance=_s)
LEDGER = _struct(key=_s, domain=_s, name=_s, ingested_at=_s)
DECISION = _struct(kind=_s, record_kind=_s, uuid=_s, fact=_s, decision=_s, reason=_s)
KINDS = {"entity_node": ENTITY, "episodic_node": EPISODE, "entity_edge": FACT, "episodic_edge": MENTION}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, name, group_id, labels): customers, suppliers, parts, nations and regions."""
    kinds = (("C", "customer", "c_custkey", "c_name"), ("S", "supplier", "s_suppkey", "s_name"), ("P", "part", "p_partkey", "p_name"), ("N", "nation", "n_nationkey", "n_name"), ("R", "region", "r_regionkey", "r_name"))
    out = None
    for mark, name, key, label in kinds:
        one = table(spark, sf_dir, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("uuid"), F.col(label).alias("name"), F.lit(name).alias("group_id"), F.array(F.lit(name)).alias("labels"))
        out = one if out is None else out.unionByName(one)
    return out


def temporal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from events: each holds until the same user's next event of its type."""
    e = table(spark, sf_dir, "events")
    following = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    key = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("uuid"), F.upper("event_type").alias("name"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"), F.lit(" with key "), F.coalesce(key, F.lit("none"))).alias("fact"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_node_uuid"), F.concat(F.lit("K"), F.coalesce(key, F.lit(""))).alias("target_node_uuid"),
        F.pmod("user_id", F.lit(4)).cast("string").alias("group_id"), F.col("ts").alias("created_at"), F.col("ts").alias("valid_at"), following.alias("invalid_at"),
    )


def supply_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from order lines: a supplier supplies a part; the order is the episode."""
    x = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    return x.select(
        F.concat(F.lit("L"), text("l_orderkey"), F.lit("-"), text("l_linenumber"), F.lit("-"), text("l_partkey"), F.lit("-"), text("l_suppkey")).alias("uuid"),
        F.lit("SUPPLIES").alias("name"), F.concat(F.lit("Supplies, under "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(".")).alias("fact"),
        F.concat(F.lit("S"), text("l_suppkey")).alias("source_node_uuid"), F.concat(F.lit("P"), text("l_partkey")).alias("target_node_uuid"),
        F.array(F.concat(F.lit("O"), text("l_orderkey"))).alias("episodes"), F.col("l_returnflag").alias("group_id"), F.col("l_shipdate").alias("created_at"),
    )


SUPPLY_SQL = """
SELECT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS uuid, 'SUPPLIES' AS name,
       'Supplies, under ' || l_returnflag || l_linestatus || '.' AS fact, 'S' || l_suppkey AS source_node_uuid, 'P' || l_partkey AS target_node_uuid,
       ['O' || l_orderkey] AS episodes, l_returnflag AS group_id, l_shipdate AS created_at FROM lineitem"""

TEMPORAL_SQL = """
SELECT 'E' || event_id AS uuid, upper(event_type) AS name,
       'user ' || user_id || ' did ' || event_type || ' with key ' || coalesce(json_extract_string(props, '$.k'), 'none') AS fact,
       'U' || user_id AS source_node_uuid, 'K' || coalesce(json_extract_string(props, '$.k'), '') AS target_node_uuid,
       CAST(user_id % 4 AS VARCHAR) AS group_id, ts AS created_at, ts AS valid_at,
       lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at
FROM events"""

ENTITY_SQL = """
SELECT 'C' || c_custkey AS uuid, c_name AS name, 'customer' AS group_id FROM customer
UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'P' || p_partkey, p_name, 'part' FROM part
UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, 'region' FROM region"""
