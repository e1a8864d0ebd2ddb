"""Reconciling aggregates of two independent feeds: gap filling, forward fill, deltas, alias joins, tolerance diffs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import collapse_category, difference, label_to_phase, rounded_difference, snap_difference, version_filter
from quarry.operators.prefix import WINDOW_ROWS, Running, heavy_groups, parted, scan
from quarry.runtime import broadcast_if_small, materialize

ALIASES = {"category_variant_1": "category_base_1", "category_variant_2": "category_base_2"}
GROUPS = {"type_a": ("type_a1", "type_a2"), "type_b": ("type_b1", "type_b2")}


# ---- two sources, one period: consistency check -------------------------------------------------------------------


def source_a_totals(detail: DataFrame, version: int = 1) -> DataFrame:
    """Sums by batch, both region levels and category; a net or total is null if one of its sums is."""
    sums = detail.where(F.col("version_flag") == version).groupBy("batch_id", "region_lv1", "region_lv2", "category")
    m1, m2, m3 = (F.sum(f"metric_{k}") for k in (1, 2, 3))
    return sums.agg(
        m1.alias("a_metric_1"), m2.alias("a_metric_2"), m3.alias("a_metric_3"), (m1 - m2).alias("a_net_metric"), (m1 + m3).alias("a_total_metric")
    )


def source_b_totals(data: DataFrame, suffix: str = "XX", suffixed: int = 3, plain: int = 1) -> DataFrame:
    """Main sums with the sub sums of the same category name; sub categories without a main row vanish. Null counts as 0 in the total."""
    valid = data.where(version_filter(F.col("batch_id"), F.col("version_flag"), suffix, suffixed, plain))
    main = valid.groupBy("batch_id", "region_lv2", "category_main").agg(F.sum("metric_main").alias("b_metric_main"))
    sub = valid.groupBy("batch_id", "region_lv2", F.col("category_sub").alias("category_main")).agg(F.sum("metric_sub").alias("b_metric_sub"))
    total = F.coalesce("b_metric_main", F.lit(0)) + F.coalesce("b_metric_sub", F.lit(0))
    return main.join(sub, ["batch_id", "region_lv2", "category_main"], "left").withColumn("b_total_metric", total)


def source_b_totals_stacked(data: DataFrame, suffix: str = "XX", suffixed: int = 3, plain: int = 1) -> DataFrame:
    """The rows of :func:`source_b_totals` from one scan and one shuffle: main and sub rows are stacked and grouped once."""
    valid = data.where(version_filter(F.col("batch_id"), F.col("version_flag"), suffix, suffixed, plain))
    main = F.struct(F.col("category_main").alias("c"), F.col("metric_main").alias("m"), F.expr("metric_sub * null").alias("s"), F.lit(True).alias("is_main"))
    sub = F.struct(F.col("category_sub").alias("c"), F.expr("metric_main * null").alias("m"), F.col("metric_sub").alias("s"), F.lit(False).alias("is_main"))
    stacked = valid.select("batch_id", "region_lv2", F.inline(F.array(main, sub)))
    grouped = stacked.groupBy("batch_id", "region_lv2", F.col("c").alias("category_main")).agg(
        F.sum("m").alias("b_metric_main"), F.sum("s").alias("__sub"), F.bool_or("is_main").alias("__main")
    )
    # a left join never matches a null key
    keyed = F.col("batch_id").isNotNull() & F.col("region_lv2").isNotNull() & F.col("category_main").isNotNull()
    out = grouped.where("__main").withColumn("b_metric_sub", F.when(keyed, F.col("__sub")))
    total = F.coalesce("b_metric_main", F.lit(0)) + F.coalesce("b_metric_sub", F.lit(0))
    return out.withColumn("b_total_metric", total).drop("__sub", "__main")


def alias_join_or(a: DataFrame, b: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Rows of a and b with equal batch and region, and b's main category equal to a's or to what a's is an alias of."""
    same = F.col("sa.category") == F.col("sb.category_main")
    for variant, base in aliases.items():
        same |= (F.col("sa.category") == variant) & (F.col("sb.category_main") == base)
    on = (F.col("sa.batch_id") == F.col("sb.batch_id")) & (F.col("sa.region_lv2") == F.col("sb.region_lv2")) & same
    return a.alias("sa").join(b.alias("sb"), on).drop(F.col("sb.batch_id"), F.col("sb.region_lv2"))


def alias_join(a: DataFrame, b: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """The rows of :func:`alias_join_or` by a pure equi join: a's category is exploded into itself and its base."""
    base = None
    for variant, name in aliases.items():
        hit = F.col("category") == variant
        base = F.when(hit, F.lit(name)) if base is None else base.when(hit, F.lit(name))
    names = F.array(F.col("category"), base) if base is not None else F.array(F.col("category"))
    widened = a.withColumn("category_main", F.explode(F.array_distinct(F.array_compact(names))))
    return widened.join(b, ["batch_id", "region_lv2", "category_main"])


def consistency_check(detail: DataFrame, data: DataFrame, aliases: Mapping[str, str] = ALIASES, suffix: str = "XX", tolerance: str = "1e-9", equi: bool = True, stacked: bool = False) -> DataFrame:
    """Source A against source B by batch, region and category, with differences.

    Only the main difference is snapped to 0 below the tolerance. Keys of one side alone are not reported (see
    :func:`outer_audit`). A is summed by its first region level too, which is not in the result: B is compared once for each.
    """
    b = (source_b_totals_stacked if stacked else source_b_totals)(data, suffix)
    joined = (alias_join if equi else alias_join_or)(source_a_totals(detail), b, aliases)
    return joined.select(
        "batch_id",
        "region_lv2",
        "category",
        "a_metric_1",
        "a_metric_3",
        "a_total_metric",
        "b_metric_main",
        "b_metric_sub",
        "b_total_metric",
        snap_difference(F.col("a_metric_1"), F.col("b_metric_main"), tolerance).alias("diff_main_metric"),
        difference(F.col("a_metric_3"), F.col("b_metric_sub")).alias("diff_sub_metric"),
        difference(F.col("a_total_metric"), F.col("b_total_metric")).alias("diff_total_metric"),
    ).orderBy(*(F.col(c).asc_nulls_last() for c in ("batch_id", "region_lv2", "category")))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerances: Mapping[str, str] | None = None, how: str = "inner") -> DataFrame:
    """Metrics of a and b side by side with ``diff_<metric>``; a metric with a tolerance is snapped to 0 below it."""
    tolerances = tolerances or {}
    left = a.select(*keys, *(F.col(m).alias(f"a_{m}") for m in metrics))
    right = b.select(*keys, *(F.col(m).alias(f"b_{m}") for m in metrics))
    diffs = {}
    for m in metrics:
        pair = F.col(f"a_{m}"), F.col(f"b_{m}")
        diffs[f"diff_{m}"] = snap_difference(*pair, tolerances[m]) if m in tolerances else difference(*pair)
    return left.join(right, list(keys), how).withColumns(diffs)


def outer_audit(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side alone has, with ``side`` a or b. An extension: the checks themselves join both sides."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = left.join(right, list(keys), "full")
    return both.where("__a is null or __b is null").select(*keys, F.when(F.col("__a"), F.lit("a")).otherwise(F.lit("b")).alias("side"))


def anomalies(compared: DataFrame, diffs: Sequence[str]) -> DataFrame:
    """Compared rows with a difference."""
    wrong = F.lit(False)
    for name in diffs:
        wrong |= F.coalesce(F.col(name) != 0, F.lit(False))
    return compared.where(wrong)


# ---- phases: spine, forward fill, deltas ---------------------------------------------------------------------------

ENTITY = ("batch_id", "entity_id", "category_group")


def base_schedule(schedule: DataFrame, groups: Mapping[str, Sequence[str]] = GROUPS) -> DataFrame:
    """The schedule with a phase from its label and a category group."""
    return schedule.select(
        "batch_id",
        "entity_id",
        "period_label",
        label_to_phase(F.col("period_label")).alias("phase"),
        "category_code",
        "category_name",
        collapse_category(F.col("category_name"), groups).alias("category_group"),
    )


def phase_spine(base: DataFrame, phases: int = 5) -> DataFrame:
    """Phases 1 to ``phases`` for each labelled entity and group, with the schedule's rows where it has them."""
    entities = base.where(F.col("period_label").isNotNull()).select(*ENTITY).distinct()
    spine = entities.withColumn("phase", F.explode(F.sequence(F.lit(1), F.lit(phases))))
    return spine.join(base, [*ENTITY, "phase"], "left")


def forward_fill(filled: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Code and name carried over phases without a label, each as the maximum of its fill group; the label as a running maximum.

    A fill group starts at each phase with a label; peers share values, as the default range frame has it. One shuffle
    serves all four windows. Entities in ``heavy``, too large to be one task's, are reduced to a row for each phase and scanned by ranges.
    """
    if heavy is None:
        return _filled_by_windows(filled)
    rows, large = parted(filled, ENTITY, heavy)
    return _filled_by_windows(rows).unionByName(_filled_by_scan(large))


def _filled_by_windows(filled: DataFrame) -> DataFrame:
    running = Window.partitionBy(*ENTITY).orderBy(F.col("phase").asc_nulls_last())
    within = Window.partitionBy(*ENTITY, "grp").orderBy(F.col("phase").asc_nulls_last())
    grouped = filled.withColumn("grp", F.sum(F.when(F.col("period_label").isNotNull(), 1).otherwise(0)).over(running))
    return grouped.select(
        "batch_id",
        "entity_id",
        "phase",
        "category_group",
        "grp",
        F.max("category_code").over(within).alias("category_code"),
        F.max("category_name").over(within).alias("category_name"),
        F.max("period_label").over(running).alias("period_label"),
    )


#: Equal rows that one array stands for.
REPEATED = 4096


def _filled_by_scan(filled: DataFrame) -> DataFrame:
    """The same: maxima of a fill group are running maxima that begin anew at a phase with a label.

    Rows of an entity and phase come out equal, so one goes through the scan with their number, and is repeated afterwards.
    """
    carried = ("category_code", "category_name", "period_label")
    phases = filled.groupBy(*ENTITY, "phase").agg(F.count("*").alias("rows"), F.count("period_label").alias("labels"), *(F.max(c).alias(c) for c in carried))
    phases = phases.withColumn("starts", F.col("labels") > 0)
    values = {"grp": Running("sum", "labels"), **{f"{c}_so_far": Running("max", c, "starts") for c in carried[:2]}, "period_label_so_far": Running("max", "period_label")}
    scanned = scan(phases, [F.col("phase").asc_nulls_last()], ENTITY, values)
    known = scanned.select("rows", *ENTITY, "phase", "grp", *(F.col(f"{c}_so_far").alias(c) for c in carried))
    # a phase of many rows is no long array
    known = known.withColumn("__first", F.explode(F.sequence(F.lit(1), F.col("rows"), F.lit(REPEATED).cast("long"))))
    known = known.withColumn("__row", F.explode(F.sequence(F.col("__first"), F.least(F.col("rows"), F.col("__first") + REPEATED - 1))))
    return known.select("batch_id", "entity_id", "phase", "category_group", "grp", *carried)


def last_known(df: DataFrame, value: str, by: Sequence[str], order: str, most: int = WINDOW_ROWS) -> DataFrame:
    """The usual forward fill: the last non-null value so far. Unlike :func:`forward_fill` it reaches back past null codes.

    Nulls of ``order`` come last, and rows of equal order in any one. Groups of more than ``most`` rows are scanned by ranges.
    """
    sequence = F.col(order).asc_nulls_last()

    def by_windows(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(sequence).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(value, F.last(value, ignorenulls=True).over(window))

    heavy = heavy_groups(df, by, most)
    if heavy is None:
        return by_windows(df)
    rows, large = parted(df, by, heavy)
    scanned = scan(large, [sequence], by, {"__last": Running("last", value)})
    return by_windows(rows).unionByName(scanned.withColumn(value, F.col("__last")).drop("__last"))


def filled_spine(base: DataFrame, phases: int = 5, most: int = WINDOW_ROWS) -> DataFrame:
    """The phase spine of a schedule, filled. An entity has no more rows there than in the schedule and phases, so the schedule tells the heavy ones."""
    heavy = heavy_groups(base, ENTITY, max(0, most - phases))
    if heavy is None:
        return _filled_by_windows(phase_spine(base, phases))
    light, large = parted(materialize(base, "base"), ENTITY, heavy)
    return _filled_by_windows(phase_spine(light, phases)).unionByName(_filled_by_scan(phase_spine(large, phases)))


def joined_status(normalised: DataFrame, status: DataFrame, groups: Mapping[str, Sequence[str]] = GROUPS) -> DataFrame:
    """The filled schedule with status rows of the same entity, phase and group; the region is the status row's."""
    grouped = status.select(
        "batch_id", "entity_id", "phase", "region", "status_flag", "value_current", collapse_category(F.col("category_name"), groups).alias("category_group")
    )
    joined = normalised.join(grouped, [*ENTITY, "phase"])
    previous = F.lag("value_current").over(Window.partitionBy(*ENTITY).orderBy(F.col("phase").asc_nulls_last()))
    return joined.withColumn("prev_value", previous)


def phase_totals(rows: DataFrame, value: str) -> DataFrame:
    """Sums by batch, region, phase, label and category, with the previous phase's sum less this one's.

    Phase 1 has no delta. The previous row is the one before in order of phase (null last), then label, of the same batch,
    region and category name, whatever its phase.
    """
    keys = ["batch_id", "region", "phase", "period_label", "category_name"]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("current_value"))
    order = Window.partitionBy("batch_id", "region", "category_name").orderBy(F.col("phase").asc_nulls_last(), F.col("period_label").asc_nulls_last())
    delta = F.lag("current_value").over(order) - F.col("current_value")
    return totals.withColumn("delta_value", F.when(F.col("phase") == 1, None).otherwise(delta))


def phase_comparison(schedule: DataFrame, status: DataFrame, external: DataFrame, groups: Mapping[str, Sequence[str]] = GROUPS, phases: int = 5) -> DataFrame:
    """Both sources' values and deltas by batch, region, phase, label and category, and their rounded differences."""
    normalised = filled_spine(base_schedule(schedule, groups), phases)
    a = phase_totals(joined_status(normalised, status, groups), "value_current")
    b = phase_totals(external, "metric_value")
    keys = ["batch_id", "region", "phase", "period_label", "category_name"]
    named = lambda df, side: df.select(*keys, *(F.col(f"{c}_value").alias(f"source_{side}_{c}") for c in ("current", "delta")))
    joined = named(a, "a").join(named(b, "b"), keys)
    return joined.withColumns(
        {
            "diff_current": rounded_difference(F.col("source_a_current"), F.col("source_b_current")),
            "diff_delta": rounded_difference(F.col("source_a_delta"), F.col("source_b_delta")),
        }
    ).orderBy(*(F.col(c).asc_nulls_last() for c in ("batch_id", "region", "phase", "category_name", "period_label")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows, which would fan out a join, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def window_delta(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``delta``: the previous row's value less this one's."""
    return df.withColumn("delta", F.lag(value).over(Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_last() for c in order))) - value)
