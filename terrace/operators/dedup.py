"""Duplicates, repeat groups and their composition into components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.order import running_totals
from terrace.operators.skew import attach
from terrace.session import durable


def drop_exact_duplicates(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """First of each set of equal rows; all columns but ``order`` are the key.

    Rows are grouped by a digest, so a text is never a shuffle key, and
    ``min_by`` combines on the map side: a row copied billions of times
    reaches the reducer as one row per task.
    """
    keys = columns or [c for c in df.columns if c != order]
    first = df.groupBy(key_hash(keys).alias("_digest")).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_first"))
    return first.select("_first.*")


def drop_key_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def flag_duplicates(df: DataFrame, keys: list[str], order: str, keep: str = "none") -> DataFrame:
    """``is_duplicate``: members of repeated keys, or only the later copies (``keep='first'``)."""
    dim = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
    joined = attach(df, dim, keys, "_size")
    flag = F.col("_size") > 1
    if keep == "first":
        flag = flag & (F.col(order) > F.col("_first"))
    return joined.withColumn("is_duplicate", flag.cast("int")).drop("_size", "_first")


def count_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: total rows, distinct keys, and rows beyond the first of each key."""
    groups = df.groupBy(key_hash(columns or df.columns).alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def key_hash(columns: list[str]) -> Column:
    """128-bit key digest in which NULL and the empty string differ."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def repeat_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys held by two or more rows, with size and first row."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first_row"))
        .where(F.col("size") > 1)
    )


def repeat_levels(df: DataFrame, levels: dict[str, list[str]], order: str) -> DataFrame:
    """First row of the repeat group at each level, or NULL where a row is alone."""
    result = df.withColumns({f"_key_{name}": key_hash(keys) for name, keys in levels.items()})
    hashed = result
    for name in levels:
        dim = hashed.groupBy(f"_key_{name}").agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias(name))
        repeated = dim.where("_size > 1")
        result = attach(result, repeated, [f"_key_{name}"], "_size").drop(f"_key_{name}", "_size")
    return result


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list ``(u, v)``: ``(node, component)``, smallest node as component.

    Every round, each node takes the smallest label among its neighbours and
    then the label of its label, so labels travel twice as far each time. The
    minima combine on the map side and no row holds a neighbourhood, so a hub
    costs one row per task. Labels are written after each round: a lost
    executor costs one round, and a round counts its own changes.
    """
    ends = edges.where("u <> v").select("u", "v")
    links = durable(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = durable(links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "labels")
    for _ in range(max_rounds):
        heard = links.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "component")
        least = heard.unionByName(labels).groupBy("node").agg(F.min("component").alias("near"))
        target = labels.select(F.col("node").alias("_at"), F.col("component").alias("_next"))
        jumped = least.join(target, F.col("near") == F.col("_at")).select("node", F.least("near", "_next").alias("component"))
        before = labels.select(F.col("node").alias("_n"), F.col("component").alias("_was"))
        marked = durable(
            jumped.join(before, F.col("node") == F.col("_n")).select("node", "component", (F.col("component") < F.col("_was")).alias("moved")), "labels"
        )
        labels = marked.select("node", "component")
        if marked.where("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def compose_groups(df: DataFrame, levels: list[str], order: str) -> DataFrame:
    """Transitive union of repeat relations: ``component`` = smallest member row.

    Each level column holds the first row of the row's group at that level.
    Rows only link the groups they belong to, so the graph is built on distinct
    combinations of group representatives; the members of a hot group collapse
    into one combination before any shuffle.
    """
    members = F.filter(F.array(*[F.col(c) for c in levels]), lambda x: x.isNotNull())
    tagged = df.withColumn("_anchor", F.get(members, F.lit(0)))
    edges = (
        df.select(members.alias("_m"))
        .where(F.size("_m") > 1)
        .distinct()
        .select(F.explode(F.transform(F.slice("_m", 2, len(levels)), lambda x: F.struct(x.alias("u"), F.get("_m", F.lit(0)).alias("v")))).alias("_e"))
        .select("_e.u", "_e.v")
    )
    labels = component_labels(edges)
    anchors = tagged.where(F.col("_anchor").isNotNull()).groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    dim = anchors.join(labels, F.col("_anchor") == F.col("node"), "left").select(
        "_anchor", "_n", F.coalesce("component", "_anchor").alias("component")
    )
    joined = attach(tagged, dim, ["_anchor"], "_n")
    return joined.withColumn("component", F.coalesce("component", F.col(order))).drop("_anchor", "_n")


def number_groups(df: DataFrame, prefix: str, row_id: str, component: str = "component") -> DataFrame:
    """Readable group ids: ``A_RG_0001`` by first row, ``A_UNIQUE_<id>`` for single rows.

    ``component`` is the smallest row of the group. Numbers come from bucketed
    running totals over the repeated groups, not from one sorted task.
    """
    sizes = df.groupBy(component).agg(F.count(F.lit(1)).alias("group_size"))
    repeated = sizes.where("group_size > 1").select(component, F.lit(1).alias("_one"))
    numbered = running_totals(repeated, [], component, "_one").select(
        component, (F.col("_before") + 1).alias("_number")
    )
    dim = sizes.join(numbered, component, "left")
    joined = attach(df, dim, [component], "group_size")
    name = F.concat(F.lit(f"{prefix}_RG_"), F.lpad(F.col("_number").cast("string"), 4, "0"))
    wide = F.concat(F.lit(f"{prefix}_RG_"), F.col("_number").cast("string"))
    repeat_id = F.when(F.col("_number") > 9999, wide).when(F.col("_number").isNotNull(), name)
    return (
        joined.withColumn("repeat_group_id", F.coalesce(repeat_id, F.lit("")))
        .withColumn("group_id", F.coalesce(repeat_id, F.concat(F.lit(f"{prefix}_UNIQUE_"), F.col(row_id).cast("string"))))
        .withColumn("is_grouped_repeat", F.col("_number").isNotNull().cast("int"))
        .drop("_number")
    )


def strongest_level(df: DataFrame, levels: list[str], labels: list[str], group: str | None = None) -> DataFrame:
    """Label of the first (strongest) level a row matches at; NULL if none.

    With ``group``, one row per group with the strongest level inside it.
    """
    rank = F.least(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(levels)], F.lit(len(levels)))

    def label(r: Column) -> Column:
        return reduce(lambda a, i: a.when(r == i, F.lit(labels[i])), range(1, len(labels)), F.when(r == 0, F.lit(labels[0])))

    if group is None:
        return df.withColumn("strongest_level", label(rank))
    return df.groupBy(group).agg(F.min(rank).alias("_r")).select(group, label(F.col("_r")).alias("strongest_level"))


def repeat_group_summary(
    df: DataFrame, levels: list[str], row_id: str, fold: str, group: str = "repeat_group_id"
) -> DataFrame:
    """Per repeat group: size, rows and sub-groups per level, folds touched, all member ids in ascending order.

    ``members`` is one string, as long as its group; :func:`repeat_members`
    gives the same ids as one row each.
    """
    grouped = df.where(F.col(group) != "")
    aggregates = [F.count(F.lit(1)).alias("size")]
    for level in levels:
        aggregates.append(F.count(level).alias(f"rows_{level}"))
    base = grouped.groupBy(group).agg(
        *aggregates, F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"),
        F.array_join(F.sort_array(F.collect_set(F.col(fold).cast("int"))), "|").alias("folds"),
        (F.count_distinct(fold) > 1).cast("int").alias("crosses_folds"),
    )
    listed = repeat_members(grouped, row_id, group).groupBy(group).agg(
        F.array_join(F.sort_array(F.collect_list(row_id)), "|").alias("members")
    )
    for level in levels:
        parts = grouped.groupBy(group, level).agg(F.lit(1).alias("_x")).groupBy(group).agg(
            F.count(level).alias(f"groups_{level}")
        )
        base = base.join(parts, group, "left")
    return base.join(listed, group, "left")


def repeat_members(df: DataFrame, row_id: str, group: str = "repeat_group_id") -> DataFrame:
    """Group members as rows, for groups of any size."""
    return df.where(F.col(group) != "").select(group, row_id)


def repeat_counts(summary: DataFrame) -> DataFrame:
    """One-row totals over :func:`repeat_group_summary`."""
    crossing = F.col("crosses_folds") == 1
    return summary.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("grouped_rows"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("rows_beyond_first"),
        F.count_if(crossing).alias("groups_crossing"),
        F.coalesce(F.sum(F.when(crossing, F.col("size"))), F.lit(0)).alias("rows_in_crossing"),
    )
