"""Reads of the graph: currency, filters, provenance joins, duplicate reports and counts.

Every function takes and returns DataFrames. Facts have (uuid, name, fact, source_node_uuid, target_node_uuid, episodes,
group_id, created_at, valid_at, invalid_at), of which a function needs those that it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_name


def is_current(now: Column, invalid_at: str = "invalid_at") -> Column:
    """A fact without an end, or whose end lies strictly ahead. Nothing else counts."""
    return F.col(invalid_at).isNull() | (F.col(invalid_at) > now)


def current_facts(facts: DataFrame, now: Column, *, include_invalidated: bool = False) -> DataFrame:
    return facts if include_invalidated else facts.where(is_current(now))


def suppressed(facts: DataFrame, now: Column, *keys: str) -> DataFrame:
    """Per key: facts seen, current, and left out as not current."""
    current = F.count_if(is_current(now))
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates_seen"), current.alias("eligible"), (F.count(F.lit(1)) - current).alias("suppressed"))


def in_date_range(facts: DataFrame, *, valid_after=None, valid_before=None, invalid_after=None, invalid_before=None) -> DataFrame:
    """Inclusive at both ends; a bound leaves out facts without the date."""
    for column, after, before in (("valid_at", valid_after, valid_before), ("invalid_at", invalid_after, invalid_before)):
        facts = facts if after is None else facts.where(F.col(column) >= after)
        facts = facts if before is None else facts.where(F.col(column) <= before)
    return facts


def of_types(facts: DataFrame, names: list[str]) -> DataFrame:
    return facts.where(F.col("name").isin(names)) if names else facts


def with_any_label(nodes: DataFrame, labels: list[str]) -> DataFrame:
    return nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))) if labels else nodes


def allowed_groups(requested: list[str] | None, configured: list[str], granted: list[str] | None = None) -> list[str]:
    """Groups to read: those asked for, or all; an unknown or ungranted one is an error that names the first in order."""
    pool = configured if granted is None else [g for g in configured if g in granted]
    wanted = pool if not requested else requested
    for what, known in (("unknown", configured), ("ungranted", pool)):
        if refused := sorted(set(wanted) - set(known)):
            raise ValueError(f"{what} group: {refused[0]}")
    return list(dict.fromkeys(wanted))


def in_groups(df: DataFrame, groups: list[str] | None, *, or_none: bool = False) -> DataFrame:
    """Rows of the groups (None: all); or_none: rows without a group too."""
    if groups is None:
        return df
    inside = F.col("group_id").isin(groups)
    return df.where(inside | F.coalesce(F.col("group_id") == "", F.lit(True)) if or_none else inside)


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def collect_scopes(scopes: list[DataFrame], key: str = "uuid") -> DataFrame:
    """Records of several scopes, one a key, of the first scope that has it."""
    out = None
    for i, df in enumerate(scopes):
        df = df.withColumn("_scope", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_wins(out, key, F.col("_scope")).drop("_scope")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the values that come last in order, at the place (the ``place`` column) of what came first."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias("place")).select(key, "_r.*", "place")


def scopes_of(groups: list[str], layout: str) -> list[list[str]]:
    """Where the records of groups live, in the order they are read: by layout, each group is a scope of its own ("separate"), all are
    one ("shared"), or all are one and the nameless group another ("single", whose writes name no group)."""
    if layout == "separate":
        return [[g] for g in groups]
    if layout not in ("shared", "single"):
        raise ValueError(f"not a layout: {layout}")
    return [list(groups), [""]] if layout == "single" else [list(groups)]


def read_scopes(records: DataFrame, groups: list[str], layout: str, key: str = "uuid") -> DataFrame:
    """Records of the groups' scopes, one a key, of the first scope that has it. A read of a scope is a filter on the group, so
    that only its files are opened."""
    return collect_scopes([records.where(F.col("group_id").isin(s)) for s in scopes_of(groups, layout)], key)


def single_group(groups: list[str], configured: list[str]) -> str:
    """The one group of a read of separate stores."""
    if len(groups) != 1:
        raise ValueError("a read names one group, of: " + ", ".join(groups or configured))
    return groups[0]


def status_by_store(nodes: DataFrame, groups: list[str], stores: list[str]) -> DataFrame:
    """Nodes of every distinct store, told under the group that comes in its place: with one store for all, only the first group
    is named."""
    seen = list(dict.fromkeys(stores))
    spark = nodes.sparkSession
    named = spark.createDataFrame(list(zip(groups, seen, strict=False)), "group_id string, store string")
    return named.join(nodes.groupBy("store").agg(F.count(F.lit(1)).alias("n")), "store", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("nodes"))


def find_edge(drivers: list[DataFrame], uuid: str) -> DataFrame:
    return collect_scopes([d.where(F.col("uuid") == uuid) for d in drivers])


def recent_episodes(episodes: DataFrame, n: int, now: Column | None = None, at: str = "valid_at", *ties: str) -> DataFrame:
    if now is not None:
        episodes = episodes.where(F.col(at) <= now)
    return episodes.orderBy(F.desc(at), *ties).limit(n)


# ---------------------------------------------------------------- projections


def node_rows(nodes: DataFrame) -> DataFrame:
    plain = F.map_filter("attributes", lambda k, v: ~F.lower(k).contains("embedding"))
    return nodes.select("uuid", "name", "group_id", "labels", "created_at", "summary", plain.alias("attributes"))


def fact_rows(facts: DataFrame, *more: str) -> DataFrame:
    from ..functions.times import iso

    stamps = [iso(F.col(c)).alias(c) for c in ("created_at", "valid_at", "invalid_at", "expired_at")]
    episodes = F.coalesce("episodes", F.array().cast("array<string>")).alias("episodes")
    return facts.select("uuid", "name", "fact", "source_node_uuid", "target_node_uuid", episodes, "group_id", *stamps, *more)


def member(summary: Column, most: int = 120) -> Column:
    return F.substring(F.coalesce(summary, F.lit("")), 1, most)


# ---------------------------------------------------------------- provenance


def episode_edges(episodes: DataFrame, facts: DataFrame, now: Column | None = None, groups: list[str] | None = None) -> DataFrame:
    """Facts that the given episodes (uuid, entity_edges) produced: current, of the groups, once each; with ``only``,
    whether no other episode supports them. A fact that names no episode counts as theirs alone.

    What supports a fact is compared in a join of (fact, episode) rows with the given ids, so neither side has to fit a
    task."""
    wanted = episodes.select(F.explode("entity_edges").alias("uuid")).distinct()
    found = facts.join(wanted, "uuid")
    found = in_groups(found if now is None else found.where(is_current(now)), groups)
    support = met_support(found.select("uuid", F.explode("episodes").alias("_episode")), episodes).groupBy("uuid").agg(F.count_if(F.col("_given").isNull()).alias("_others"))
    return found.join(support, "uuid", "left").withColumn("only", F.coalesce("_others", F.lit(0)) == 0).drop("_others")


def met_support(support: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows (_episode, ...) of what supports something, with ``_given``, which is null where the episode is none of the given (uuid)."""
    given = episodes.select(F.col("uuid").alias("_episode")).distinct().withColumn("_given", F.lit(1))
    return support.join(given, "_episode", "left")


def support_split(support: DataFrame, episodes: DataFrame, *key: str) -> DataFrame:
    """(key, uuid, only) of what a given episode supports, from rows (key, uuid, _episode) of its facts: the smallest uuid of them, and whether
    no other episode supports it. Rows meet the given ones once and are then added up by key, so no list of episodes is gathered."""
    added = met_support(support.where("_episode IS NOT NULL"), episodes).groupBy(*key).agg(F.min("uuid").alias("uuid"), F.count("_given").alias("_given"), F.count_if(F.col("_given").isNull()).alias("_others"))
    return added.where("_given > 0").select(*key, "uuid", (F.col("_others") == 0).alias("only"))


def episode_entities(episodes: DataFrame, facts: DataFrame, mentions: DataFrame, nodes: DataFrame, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, mentioned nodes) of the given episodes, once each."""
    edges = facts.join(episodes.select(F.explode("entity_edges").alias("uuid")).distinct(), "uuid", "left_semi")
    mentioned = mentions.join(episodes.select(F.col("uuid").alias("source_node_uuid")).distinct(), "source_node_uuid", "left_semi").select(F.col("target_node_uuid").alias("uuid")).distinct()
    found = nodes.join(mentioned, "uuid", "left_semi")
    groups = None if group is None else [group]
    return in_groups(edges, groups), in_groups(found, groups)


def edge_sources(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """(uuid, pos, episode, name, valid_at ...): a fact's episodes in their order; one that is missing has nulls."""
    listed = facts.select(F.col("uuid"), F.posexplode("episodes").alias("pos", "episode"))
    return listed.join(episodes.withColumnRenamed("uuid", "episode"), "episode", "left")


def with_missing(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """All edges, with which of their endpoints is the first that is not among the nodes (uuid); null where both are. Nodes are met by sorting,
    as their columns' size in files, by which a plan would send them to all tasks, is far below what a table of their ids takes in each."""
    has = lambda df, c: df.select(F.col("uuid").alias(c)).distinct().withColumn(f"_has_{c}", F.lit(True)).hint("merge")
    both = edges.join(has(sources, "source_node_uuid"), "source_node_uuid", "left").join(has(targets, "target_node_uuid"), "target_node_uuid", "left")
    missing = F.when(F.col("_has_source_node_uuid").isNull(), F.lit("source")).when(F.col("_has_target_node_uuid").isNull(), F.lit("target"))
    return both.withColumn("missing", missing).drop("_has_source_node_uuid", "_has_target_node_uuid")


def dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose endpoints are not both among the nodes (uuid), with which is missing first."""
    return with_missing(edges, sources, targets).where("missing IS NOT NULL")


# ---------------------------------------------------------------- duplicates and counts


def duplicate_entities(nodes: DataFrame, *, members: bool = True) -> DataFrame:
    """Clusters of two or more nodes of one normalised name, over all groups: (name, count[, members]), a member being (uuid, name,
    group_id, summary). Sort and limit are the report's. Names are counted first, with partial aggregation, and only repeated
    ones gather members; ``entity_members`` gives those of a report's clusters as rows."""
    keyed = nodes.withColumn("key", normalized_name(F.col("name"))).where("key <> ''")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1").withColumnRenamed("key", "name")
    if not members:
        return counts
    rows = entity_members(nodes, counts).select("cluster", F.struct("uuid", "name", "group_id", "summary").alias("m"))
    return counts.join(rows.groupBy(F.col("cluster").alias("name")).agg(F.sort_array(F.collect_list("m")).alias("members")), "name")


def entity_members(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, uuid, name, group_id, summary): the members of the clusters (name), a row each, however many a cluster has."""
    summary = member(F.col("summary") if "summary" in nodes.columns else F.lit(None).cast("string"))
    rows = nodes.select(normalized_name(F.col("name")).alias("cluster"), "uuid", "name", "group_id", summary.alias("summary"))
    return rows.join(clusters.select(F.col("name").alias("cluster")), "cluster")


FACT_CLUSTER = ("source_node_uuid", "target_node_uuid", "key_digest")


def keyed_facts(facts: DataFrame, now: Column | None = None, order: Column | None = None) -> DataFrame:
    """Current facts that say something, with the digest of their normalised text (128 bits, so no text is a join's key), written:
    counting and gathering read it, and texts are normalised once."""
    from ..sources.store import written

    facts = facts if now is None else facts.where(is_current(now))
    group = F.col("group_id") if "group_id" in facts.columns else F.lit(None).cast("string")
    key = normalized_name(F.col("fact"))
    own = facts.where(key != "").select(*FACT_CLUSTER[:2], F.unhex(F.md5(key)).alias("key_digest"), "uuid", "fact", group.alias("group_id"), "created_at", (F.col("uuid") if order is None else order).alias("place"))
    return written(own, "keyed-facts")


def fact_clusters(keyed: DataFrame) -> DataFrame:
    """Clusters of two or more of ``keyed_facts``: (source, target, key_digest, key, fact, count). The label is the first member's fact in
    the order of scan; its normalised text, which all members share, is the key."""
    counts = keyed.groupBy(*FACT_CLUSTER).agg(F.count(F.lit(1)).alias("count"), F.min_by("fact", "place").alias("fact")).where("count > 1")
    return counts.withColumn("key", normalized_name(F.col("fact")))


def fact_members(keyed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source, target, key_digest, at, uuid, group_id, created_at): the members of the clusters, a row each, however many a cluster has."""
    at = F.coalesce(F.col("created_at").cast("string"), F.lit("None"))
    return keyed.select(*FACT_CLUSTER, at.alias("at"), "uuid", "group_id", "created_at").join(clusters.select(*FACT_CLUSTER), list(FACT_CLUSTER))


def duplicate_facts(facts: DataFrame, now: Column | None = None, order: Column | None = None) -> DataFrame:
    """Clusters of current facts that say the same of the same two entities: (source, target, key, fact, count, members), a
    member being (uuid, group_id, created_at). The label is the first member's fact in the order of scan (``order``; ids by
    default); members go by created_at as text ("None" for null), then id. Clusters are counted before members are gathered; a
    report limits ``fact_clusters`` first, and reads ``fact_members`` of what is left."""
    keyed = keyed_facts(facts, now, order)
    clusters = fact_clusters(keyed)
    rows = fact_members(keyed, clusters).select(*FACT_CLUSTER, F.struct("at", "uuid", "group_id", "created_at").alias("m"))
    gathered = rows.groupBy(*FACT_CLUSTER).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: F.struct(m["uuid"].alias("uuid"), m["group_id"].alias("group_id"), m["created_at"].alias("created_at"))).alias("members"))
    return clusters.join(gathered, list(FACT_CLUSTER)).drop("key_digest")


def total_members(clusters: DataFrame) -> DataFrame:
    """Members of all clusters, before any limit."""
    return clusters.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicates"))


def report(clusters: DataFrame, limit: int = 50, label: str = "name") -> DataFrame:
    return clusters.orderBy(F.desc("count"), label).limit(limit)


def count_by_group(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes of every listed group (group_id), 0 where it has none."""
    return groups.join(nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group_id", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("nodes"))


def count_by_kind(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) of several record kinds; a kind without records has 0."""
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
