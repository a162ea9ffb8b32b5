"""Exact global order without a single-task sort: ranks, running totals, quantiles, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstprint.session import materialise


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Adds, per ``group`` and in ``order``, the total of each weight over all *earlier* rows.

    The rows are range-partitioned and sorted by (group, order), which cuts hot groups into many
    ranges. Each range is summed locally and the ranges' offsets (one row per range and group) are
    joined back. The sorted table is written out first, so a re-run after an executor loss cannot
    see other range bounds. ``order`` should be unique inside a group for repeatable results.
    """
    group = list(group or [])
    ids = F.monotonically_increasing_id()
    weights = {f"_w_{n}": c for n, c in totals.items()}
    ranged = materialise(
        df.withColumns(weights).orderBy(*group, *order)
        .withColumn("_at", ids).withColumn("_range", F.shiftright("_at", 33)),
        "ordered",
    )
    local = Window.partitionBy("_range", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy("_range", *group).agg(*[F.sum(w).alias(w) for w in weights])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_o{w}") for w in weights],
    )
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & (F.col(g) == F.col(f"_g_{g}"))
    summed = ranged.withColumns({f"_l{w}": F.coalesce(F.sum(w).over(local), F.lit(0)) for w in weights})
    joined = summed.join(offsets, same)
    return joined.select(
        *df.columns, *[(F.col(f"_l_w_{n}") + F.col(f"_o_w_{n}")).alias(n) for n in totals]
    )


def global_position(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in ``order`` inside its ``group``."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, group)


def with_group_size(df: DataFrame, group: list[str] | None = None, name: str = "n_rows") -> DataFrame:
    """Adds the row count of the group: one small aggregate joined back (one row per group)."""
    group = list(group or [])
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    return df.join(F.broadcast(sizes), group) if group else df.join(F.broadcast(sizes))


def temporal_blocks(df: DataFrame, order: list[str], k: int, group: list[str] | None = None,
                    name: str = "block") -> DataFrame:
    """Splits each group, in order, into k blocks; the first (n mod k) blocks hold one row more."""
    placed = with_group_size(global_position(df, order, group, "_pos"), group, "_n")
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    big = extra * (size + 1)
    block = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (size + 1))).otherwise(
        extra + F.floor((F.col("_pos") - big) / F.when(size > 0, size))
    )
    return placed.withColumn(name, block.cast("int")).drop("_pos", "_n")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], group: list[str] | None = None,
                    weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles: (group..., quantiles array), in the order of ``probs``.

    ``weight``, if named, is a whole number that says how often a row counts.
    Equal values are counted first, then ranked with ``running_totals``; each wanted rank selects
    the one value whose rank span holds it. No group is ever sorted or buffered in a single task.
    """
    group = list(group or [])
    levels = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_c"))
    ranked = running_totals(levels, [value], {"_before": F.col("_c")}, group)
    sizes = levels.groupBy(*group).agg(F.sum("_c").alias("_n"))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    wanted = (
        sizes.select(*group, "_n", F.explode(points).alias("_p"))
        .withColumn("_x", (F.col("_n") - 1) * F.col("_p.q"))
        .withColumn("_ranks", F.array(F.floor("_x"), F.ceil("_x")))
    )
    # groups x quantiles x 2 rows: a fixed number per group
    ranks = wanted.select(*group, "_p", "_x", F.explode("_ranks").alias("_rank")).distinct()
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
    hits = ranked.join(F.broadcast(ranks), group) if group else ranked.join(F.broadcast(ranks), inside)
    lo, hi = F.min(value), F.max(value)
    frac = F.max(F.col("_x") - F.floor("_x"))
    nearer = F.when(frac >= 0.5, hi - (hi - lo) * (1 - frac)).otherwise(lo + (hi - lo) * frac)
    per_point = hits.where(inside).groupBy(*group, "_p").agg(nearer.alias("_v"))
    packed = F.sort_array(F.collect_list(F.struct(F.col("_p.i").alias("i"), F.col("_v").alias("v"))))
    return per_point.groupBy(*group).agg(F.transform(packed, lambda s: s["v"]).alias("quantiles"))


def rolled(df: DataFrame, order: list[str], column: str, shift: int, name: str = "rolled") -> DataFrame:
    """Adds the value ``shift`` positions earlier in order, wrapping round at the start."""
    placed = with_group_size(global_position(df, order, None, "_pos"), None, "_n")
    source = placed.select(((F.col("_pos") + shift) % F.col("_n")).alias("_to"), F.col(column).alias(name))
    return placed.join(source, F.col("_pos") == F.col("_to")).drop("_pos", "_to", "_n")


def temporal_split(df: DataFrame, train_frac: float = 0.6, val_frac: float = 0.2, key: str = "symbol",
                   day: str = "asof_date") -> DataFrame:
    """Adds ``split``: keys ordered by their first day are cut into train, val and test."""
    firsts = df.groupBy(key).agg(F.min(day).alias("_first"))
    placed = with_group_size(global_position(firsts, ["_first", key], None, "_pos"), None, "_n")
    train_end = F.floor(F.col("_n") * F.lit(train_frac))
    val_end = F.floor(F.col("_n") * F.lit(train_frac + val_frac))
    split = F.when(F.col("_pos") < train_end, "train").when(F.col("_pos") < val_end, "val").otherwise("test")
    return df.join(placed.select(key, split.alias("split")), key)
