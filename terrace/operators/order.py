"""Exact ranks, running totals and quantiles without a one-task sort.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and an unpartitioned window sorts the table in one task.
Both stop working on large groups. Quantiles therefore first measure the largest
group, and only groups proven small use ``percentile``. A few large groups are
bracketed by a sketch, and only the rows in the brackets are ranked. For many
groups, and for ranks of all rows, the functions here

1. count equal values first, so ties collapse on the map side;
2. cut the value range at approximate quantiles, so each bucket holds about
   the same share of rows whatever the skew (the cut points, a bounded list,
   are the only thing that reaches the driver, as in Spark's own range sort);
3. run the window inside ``(group, bucket)`` and add the bucket's offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.session import durable, shuffle_width

MAX_BUCKETS = 4096
# Groups up to this many rows fit one aggregation buffer.
PERCENTILE_ROWS = 1_000_000
# Sketch accuracy (rank errors of 1e-4 of a group), half the share of rows between two bounds, and the most groups and quantiles that are bracketed.
SKETCH, BRACKET, MAX_GROUPS, MAX_WANTED = 10_000, 0.00025, 64, 4


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match; the right keys are dropped."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """At most ``MAX_BUCKETS`` balanced cut points of a numeric column."""
    if buckets is None:
        buckets = max(8, min(4 * shuffle_width(df.sparkSession), MAX_BUCKETS))
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, shares, 10 * buckets).alias("cuts")).first()
    return sorted({float(v) for v in (row["cuts"] or [])})


def with_bucket(df: DataFrame, value: str, cuts: list[float], name: str = "_bin") -> DataFrame:
    """Order-preserving bucket number of a non-null numeric column."""
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    typed = df.withColumn("_binned", F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="_binned", outputCol=name).transform(typed).drop("_binned")


def running_totals(
    df: DataFrame, by: list[str], value: str, weight: str, cuts: list[float] | None = None
) -> DataFrame:
    """Add ``_before`` and ``_total``: weight ahead of this value and in the group.

    ``df`` holds one row per ``(by, value)``.
    """
    cuts = cut_points(df, value) if cuts is None else cuts
    binned = with_bucket(df, value, cuts)
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # One row per (group, bucket): at most MAX_BUCKETS rows in any window partition.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*by, "_bin")
        .agg(F.sum(weight).alias("_in_bin"))
        .withColumn("_offset", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_in_bin").over(group))
        .drop("_in_bin")
    )
    ranked = binned.withColumn("_cum", F.sum(weight).over(inside))
    return (
        null_safe_join(ranked, offsets, [*by, "_bin"])
        .withColumn("_before", F.col("_cum") - F.col(weight) + F.col("_offset"))
        .drop("_bin", "_cum", "_offset")
    )


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows per distinct value; ties collapse before the shuffle."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group.

    ``wanted`` maps output column to quantile. Missing and NaN values are left
    out; groups made of such rows only do not appear.
    """
    present = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = present.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("top"), F.count(F.lit(1)).alias("groups")).first()
    if (sizes["top"] or 0) <= PERCENTILE_ROWS:
        return small_quantiles(present, by, wanted)
    if sizes["groups"] <= MAX_GROUPS and len(wanted) <= MAX_WANTED:
        found = bracketed_quantiles(present, by, wanted)
        if found is not None:
            return found
    return bucketed_quantiles(present, by, wanted)


def small_quantiles(present: DataFrame, by: list[str], wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """Quantiles of column ``_v``, each row counting ``weight`` times, by one aggregation buffer a group."""
    levels = sorted(set(wanted.values()))
    shares = F.array(*[F.lit(float(q)) for q in levels])
    exact = F.percentile("_v", shares) if weight is None else F.percentile("_v", shares, F.col(weight))
    held = present.groupBy(*by).agg(exact.alias("_q")).where(F.col("_q").isNotNull())
    return held.select(*by, *[F.get("_q", F.lit(levels.index(q))).alias(n) for n, q in wanted.items()])


def bracketed_quantiles(present: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame | None:
    """Quantiles of column ``_v`` from the rows near them, for few groups of any size; nothing if a bracket missed one.

    A sketch gives a lower and an upper bound for each quantile. Rows between
    the bounds, about one in 2,000, are counted by value; all others are only
    counted between brackets, so no other row leaves its task. The counts tell
    exactly which ranks a bracket holds.
    """
    shares = {f"{side}_{i}": q + d for i, q in enumerate(wanted.values()) for side, d in (("lo", -BRACKET), ("hi", BRACKET))}
    inner = {n: q for n, q in shares.items() if 0.0 < q < 1.0}
    sketch = F.percentile_approx("_v", F.array(*[F.lit(q) for q in inner.values() or (0.5,)]), SKETCH)
    bounds = present.groupBy(*by).agg(sketch.alias("_s"))
    ends = {n: F.get("_s", F.lit(list(inner).index(n))) if n in inner else F.lit(float("-inf") if q <= 0.0 else float("inf")) for n, q in shares.items()}
    edges = durable(bounds.select(*by, *[c.alias(f"_{n}") for n, c in ends.items()]), "edges")
    placed = null_safe_join(present, F.broadcast(edges), by)
    sides = [(F.col(f"_lo_{i}"), F.col(f"_hi_{i}")) for i in range(len(wanted))]
    near = reduce(lambda a, b: a | b, [(F.col("_v") >= lo) & (F.col("_v") <= hi) for lo, hi in sides])
    # A row outside all brackets counts behind the end of the last bracket below it.
    below = F.greatest(F.lit(float("-inf")), *[F.when(hi < F.col("_v"), hi) for _, hi in sides])
    keyed = placed.select(*by, F.when(near, F.col("_v")).otherwise(below).alias("_v"), (~near).cast("int").alias("_lump"))
    counts = durable(keyed.groupBy(*by, "_v", "_lump").agg(F.count(F.lit(1)).alias("_n")), "near")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ahead = F.coalesce(F.sum("_n").over(group.orderBy("_v", "_lump").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumns({"_before": ahead, "_total": F.sum("_n").over(group)})
    found = durable(picked_quantiles(ranked, by, wanted, F.max("_hit")), "quantiles")
    if found.where("_hit").limit(1).count():
        return None
    return found.drop("_hit")


def bucketed_quantiles(present: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """Quantiles of column ``_v`` from bucketed ranks, for groups of any size."""
    return picked_quantiles(running_totals(value_counts(present, by, "_v"), by, "_v", "_n"), by, wanted)


def picked_quantiles(ranked: DataFrame, by: list[str], wanted: dict[str, float], hit: Column | None = None) -> DataFrame:
    """The values at the wanted ranks of counted values with ``_before`` and ``_total``.

    With ``hit``, ``_hit`` tells whether a rank fell among rows of unknown value (``_lump``).
    """
    aggregates: list[Column] = []
    lumped = []
    for name, q in wanted.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        for suffix, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            held = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
            aggregates.append(F.max(F.when(held, F.col("_v"))).alias(f"_{suffix}_{name}"))
            lumped.append(held)
        aggregates.append(F.max(position).alias(f"_at_{name}"))
    rows = ranked
    if hit is not None:
        rows = ranked.withColumn("_hit", (F.col("_lump") == 1) & reduce(lambda a, b: a | b, lumped))
        aggregates.append(hit.alias("_hit"))
    picked = rows.groupBy(*by).agg(*aggregates)
    values = [interpolated(F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_at_{n}")).alias(n) for n in wanted]
    return picked.select(*by, *values, *(["_hit"] if hit is not None else []))


def counted_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """:func:`quantiles` of values that repeat often: equal values are counted in one pass, and the counts are ranked."""
    counts = durable(value_counts(df.select(*by, F.col(value).cast("double").alias("_v")), by, "_v"), "counts")
    top = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("top")).first()["top"]
    return small_quantiles(counts, by, wanted, "_n") if (top or 0) <= PERCENTILE_ROWS else quantiles(df, by, value, wanted)


def fold_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], fold: str, folds: int, name: str = "outer_fold") -> DataFrame:
    """Exact quantiles of each fold's training rows, one row per fold and group.

    Equal values of a fold are counted first, so the copies for the training
    sets are made of counts, not of rows.
    """
    rows = df.select(*by, fold, F.col(value).cast("double").alias("_v"))
    counts = durable(value_counts(rows, [*by, fold], "_v"), "counts")
    others = F.explode(F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda k: k != F.col(fold)))
    merged = counts.withColumn(name, others).groupBy(*by, name, "_v").agg(F.sum("_n").alias("_n"))
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("top"), F.count(F.lit(1)).alias("groups")).first()
    if (sizes["top"] or 0) <= PERCENTILE_ROWS:
        return small_quantiles(merged, [*by, name], wanted, "_n")
    if sizes["groups"] * folds <= MAX_GROUPS and len(wanted) <= MAX_WANTED:
        present = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn(name, others).drop(fold)
        found = bracketed_quantiles(present, [*by, name], wanted)
        if found is not None:
            return found
    return picked_quantiles(running_totals(durable(merged, "counts"), [*by, name], "_v", "_n"), [*by, name], wanted)


def training_quantiles(df: DataFrame, value: str, wanted: dict[str, float], fold: str = "fold", folds: int = 5, name: str = "outer_fold") -> DataFrame:
    """Exact quantiles of each fold's training rows, one row per fold, without copies of rows.

    A value is counted once, with the rows of each fold beside those of all. Running
    totals of both give its rank in every training set: all rows less the fold's.
    """
    rows = df.select(fold, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col(fold).isNotNull())
    held = ["_all", *[f"_in{k}" for k in range(1, folds + 1)]]
    each = [F.sum((F.col(fold) == k).cast("long")).alias(f"_in{k}") for k in range(1, folds + 1)]
    counts = durable(rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_all"), *each), "counts")

    def per_fold(ranked: DataFrame, *extra: str) -> DataFrame:
        sets = [F.struct(F.lit(k).alias(name), (F.col("_all") - F.col(f"_in{k}")).alias("_n"), *[(F.col(f"{e}_all") - F.col(f"{e}_in{k}")).alias(e) for e in extra]) for k in range(1, folds + 1)]
        return ranked.select("_v", F.inline(F.array(*sets))).where("_n > 0")

    if counts.count() <= PERCENTILE_ROWS:
        return small_quantiles(per_fold(counts), [name], wanted, "_n")
    binned = with_bucket(counts, "_v", cut_points(counts, "_v"))
    # One row per bucket: at most MAX_BUCKETS rows in this window.
    whole = Window.partitionBy(F.lit(1))
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("_bin").agg(*[F.sum(c).alias(c) for c in held])
    offsets = sums.select("_bin", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_offset{c}") for c in held], *[F.sum(c).over(whole).alias(f"_total{c}") for c in held])
    inside = Window.partitionBy("_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = binned.select("_bin", "_v", *held, *[F.sum(c).over(inside).alias(f"_cum{c}") for c in held]).join(F.broadcast(offsets), "_bin")
    ranked = running.withColumns({f"_before{c}": F.col(f"_cum{c}") - F.col(c) + F.col(f"_offset{c}") for c in held})
    return picked_quantiles(per_fold(ranked, "_before", "_total"), [name], wanted)


def interpolated(low: Column, high: Column, position: Column) -> Column:
    """Value at a fractional rank by the formula of ``percentile``, so that a group's size never shows in the last digit."""
    between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
    return F.when((F.ceil(position) == F.floor(position)) | (low == high), low).otherwise(between)


def with_quantiles(
    aggregated: DataFrame, df: DataFrame, by: list[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Join exact quantiles onto an aggregate that has one row per group."""
    found = quantiles(df, by, value, wanted)
    if not by:
        return aggregated.join(F.broadcast(found), F.lit(True), "left")
    return null_safe_join(aggregated, found, by, "left")


def hashed_rank(df: DataFrame, digest: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Dense 0-based position in the order of a unique hex digest column.

    The first three hex digits split the order into 4,096 even buckets, so no
    task sorts more than its share.
    """
    by = by or []
    tagged = df.withColumn("_bin", F.substring(digest, 1, 3))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*by, "_bin")
        .agg(F.count(F.lit(1)).alias("_in_bin"))
        .withColumn("_offset", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)))
        .drop("_in_bin")
    )
    inside = Window.partitionBy(*by, "_bin").orderBy(digest)
    ranked = tagged.withColumn("_in_rank", F.row_number().over(inside))
    return (
        null_safe_join(ranked, offsets, [*by, "_bin"])
        .withColumn(name, F.col("_offset") + F.col("_in_rank") - 1)
        .drop("_bin", "_offset", "_in_rank")
    )
