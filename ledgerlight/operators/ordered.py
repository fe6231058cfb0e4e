"""Ordered operators that stay safe when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. That is the cheapest plan for
ordinary keys (one exchange serves every window of the key), so it is kept for them. Keys above
``hot_key_rows`` are found by one partial aggregation and take another way: their rows are cut into
value or time slices of equal size, every slice is scanned by its own task, and what earlier slices
contribute is carried over from a small per-slice summary. Both ways give the same result; copies of
a row (equal in the whole order) may share out their numbers in either order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.functions.timeparts import micros
from ledgerlight.session import materialise


@dataclass(frozen=True)
class HotKeys:
    """Keys above the row limit; ``small`` says their count was checked against the bound."""

    table: DataFrame
    key: str
    small: bool

    def hinted(self) -> DataFrame:
        return F.broadcast(self.table) if self.small else self.table


class Heat(NamedTuple):
    """Hot keys, if there are any, whether rows without a key exist, and the number of ordinary rows (0: not known)."""

    hot: HotKeys | None
    nulls: bool
    rows: int = 0


def find_heat(df: DataFrame, key: str, cfg: EngineConfig) -> Heat:
    """Keys with more than ``hot_key_rows`` rows (at most rows / hot_key_rows of them), rows without key, and ordinary rows.

    One aggregation tells all; its few rows (one for all ordinary keys) are saved and only looked at afterwards.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    kind = F.when(F.col(key).isNull(), "null").when(F.col("_rows") > cfg.hot_key_rows, "hot").otherwise("ordinary")
    named = counts.select(kind.alias("_kind"), F.when(kind == "hot", F.col(key)).alias(key), "_rows")
    found = materialise(named.groupBy("_kind", key).agg(F.sum("_rows").alias("_rows")))
    heavy = found.where(F.col("_kind") == "hot").select(key)
    hot = heavy.limit(cfg.broadcast_rows + 1).count()
    others = {r["_kind"]: r["_rows"] for r in found.where(F.col("_kind") != "hot").collect()}
    return Heat(HotKeys(heavy, key, hot <= cfg.broadcast_rows) if hot else None, "null" in others, others.get("ordinary", 0))


def find_hot_keys(df: DataFrame, key: str, cfg: EngineConfig) -> tuple[HotKeys | None, bool]:
    """The hot keys and whether rows without key exist."""
    return find_heat(df, key, cfg)[:2]


def dealt(df: DataFrame, key: str, rows: int, cfg: EngineConfig) -> DataFrame:
    """Rows dealt by key, to as many tasks as ``rows`` need at ``task_rows`` each.

    Few rows are left to Spark, which joins small partitions but knows only their compressed bytes: the sorts of
    windows and aggregates would then grow with the table.
    """
    pieces = -(-rows // cfg.task_rows)
    return df.repartition(pieces, key) if pieces > df.sparkSession.sparkContext.defaultParallelism else df.repartition(key)


def dealt_whole(df: DataFrame, key: str, rows: int, cfg: EngineConfig) -> DataFrame:
    """The same for rows that several steps read: they travel whole, in one column, and are taken apart where they arrive.

    Spark drops columns below an exchange that the step above does not use, so steps that use different columns of one frame
    would each scan, join and shuffle it anew. Of rows dealt like this they all read the same exchange.
    """
    others = [F.col(c) for c in df.columns if c != key]
    packed = dealt(df.select(key, F.array(F.struct(*others)).alias("_whole")), key, rows, cfg)
    return packed.select(*[F.col(key) if c == key else F.element_at("_whole", 1)[c].alias(c) for c in df.columns])


def by_heat(
    df: DataFrame,
    key: str,
    cfg: EngineConfig,
    regular: Callable[[DataFrame], DataFrame],
    skewed: Callable[[DataFrame, HotKeys], DataFrame],
    keep_null: bool = True,
    heat: Heat | None = None,
    shared: bool = False,
) -> DataFrame:
    """Run ``regular`` on ordinary keys and ``skewed`` on hot keys, and put the rows together.

    Rows without a key belong to no history: they keep their columns and have NULL in all new ones
    (``keep_null=False`` leaves them out, for results that are one row a key). ``heat`` is the answer of
    ``find_heat`` for these rows or for more, if it is known already; with its number of rows (or if it is found here) the
    ordinary rows are dealt by key before ``regular``. ``shared`` says that other steps deal the same ``df``, too: its rows are dealt whole.
    """
    known = df.where(F.col(key).isNotNull())
    heat = find_heat(df, key, cfg) if heat is None else heat
    hot, nulls = heat.hot, heat.nulls

    def ordinary(cold: DataFrame) -> DataFrame:
        return regular((dealt_whole if shared else dealt)(cold, key, heat.rows, cfg) if heat.rows else cold)

    if hot is None:
        out = ordinary(known)
    else:
        cold_rows = known.join(hot.hinted(), key, "left_anti")
        hot_rows = known.join(hot.hinted(), key, "left_semi")
        out = ordinary(cold_rows).unionByName(skewed(hot_rows, hot))
    if nulls and keep_null:
        rest = df.where(F.col(key).isNull()).select(*[c for c in df.columns if c in out.columns])
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def with_slices(df: DataFrame, keys: Sequence[str], at: str, cfg: EngineConfig) -> DataFrame:
    """Saved rows with ``_slice``: ranges of (key, ``at``) of about ``slice_rows`` rows each.

    Spark cuts the ranges by a sample of the rows, so they hold equal numbers of rows however uneven
    the values lie; equal positions of a key stay together. The rows are saved, so that every later
    step sees the same cuts.
    """
    saved = materialise(df)
    pieces = max(1, -(-saved.count() // cfg.slice_rows))
    return materialise(saved.repartitionByRange(pieces, *keys, at).withColumn("_slice", F.spark_partition_id().cast("long")))


def running_sums(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    base: DataFrame | None = None,
    each: bool = False,
) -> DataFrame:
    """Running totals over each key in ``order``; equal positions count together, or one by one with ``each``.

    ``base`` is where the per-slice totals are read from: the saved slices, when ``sliced`` already
    carries further columns, so that chained steps do not repeat each other's work.
    """
    keys = list(keys)
    base = sliced if base is None else base
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        base.groupBy(*keys, "_slice")
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
        .select(*keys, "_slice", *[F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in sums])
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    if each:
        within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = sliced.withColumns({f"_in_{n}": F.sum(c).over(within) for n, c in sums.items()})
    joined = scanned.join(carry, [*keys, "_slice"], "left")
    zero = F.lit(0)
    totals = {n: F.coalesce(F.col(f"_in_{n}"), zero) + F.coalesce(F.col(f"_carry_{n}"), zero) for n in sums}
    return joined.withColumns(totals).drop(*[f"_in_{n}" for n in sums], *[f"_carry_{n}" for n in sums])


def running_extremes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, sliced: bool = False) -> DataFrame:
    """Add ``_most`` and ``_least``: the extremes of ``value`` over each key up to the row in ``order``, row by row.

    ``sliced``: the rows are those of ``with_slices``; slices are scanned apart and take over the extremes of earlier ones.
    """
    ends = {"_most": F.max, "_least": F.min}
    if not sliced:
        within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({n: f(value).over(within) for n, f in ends.items()})
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_slice").agg(*[f(value).alias(n) for n, f in ends.items()])
    carry = carry.select(*keys, "_slice", *[f(n).over(earlier).alias(f"_carry{n}") for n, f in ends.items()])
    scanned = rows.withColumns({f"_in{n}": f(value).over(within) for n, f in ends.items()}).join(carry, [*keys, "_slice"], "left")
    merged = {"_most": F.greatest("_in_most", "_carry_most"), "_least": F.least("_in_least", "_carry_least")}
    return scanned.withColumns(merged).drop(*[f"_{x}{n}" for x in ("in", "carry") for n in ends], "_slice")


def previous_values(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    name: str,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add struct ``name`` with ``values`` of the preceding row of the key, null for the first."""
    keys = list(keys)
    row = F.struct(*values)
    last = (sliced if base is None else base).groupBy(*keys, "_slice").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carry = last.select(
        *keys, "_slice", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_slice_before")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_lagged", F.lag(row).over(within))
        .join(carry, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce("_lagged", "_slice_before"))
        .drop("_lagged", "_slice_before")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], cfg: EngineConfig
) -> DataFrame:
    """Exact interpolated quantiles per key without holding a key's values in one task.

    Equal values are counted first; positions are then found by a sliced running count.
    """
    keys = list(keys)
    group = keys or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    counts = source.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(counts, keys, value, wanted, cfg)


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], cfg: EngineConfig
) -> DataFrame:
    """The same from distinct values (not null) with their numbers of rows, ``_n``; without keys there is a column ``_all``."""
    keys = list(keys)
    group = keys or ["_all"]
    sliced = with_slices(counts, group, value, cfg)
    running = running_sums(sliced, group, [value], {"_upto": F.col("_n")})
    totals = sliced.groupBy(*group).agg(F.sum("_n").alias("_total"))
    placed = running.join(totals, group)
    picks = []
    for name, share in wanted.items():
        position = (F.col("_total") - 1) * F.lit(float(share))
        for tag, index in (("low", F.floor(position)), ("high", F.ceil(position))):
            inside = (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{tag}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_part"))
    found = placed.groupBy(*group).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n)
            for n in wanted
        ],
    )


def rolling_distinct(
    df: DataFrame, key: str, item: str, window_us: int, name: str, cfg: EngineConfig, ts: str = "timestamp"
) -> DataFrame:
    """Distinct ``item`` values per ``key`` in the trailing left-open window, peers included.

    An item counts from its use until the window has passed without another use, so the answer is
    a running sum of +1 and -1 steps: linear, where collecting sets per row would be quadratic.
    """
    rows = df.withColumn("_us", micros(ts))
    return by_heat(
        rows,
        key,
        cfg,
        lambda cold: distinct_steps(cold, key, item, window_us, name),
        lambda hot, keys: distinct_steps_sliced(hot, key, item, window_us, name, cfg),
    ).drop("_us")


def distinct_steps(df: DataFrame, key: str, item: str, window_us: int, name: str) -> DataFrame:
    """All windows share one exchange by ``key``; expiry steps are exploded in place."""
    uses = Window.partitionBy(key, item).orderBy("_us")
    before = F.col("_us") - F.lag("_us").over(uses)
    after = F.lead("_us").over(uses) - F.col("_us")
    present = F.col(item).isNotNull()
    stepped = df.withColumns(
        {
            "_starts": present & (before.isNull() | (before >= window_us)),
            "_ends": present & (after.isNull() | (after >= window_us)),
        }
    )
    own = F.struct(F.col("_us").alias("at"), F.col("_starts").cast("int").alias("step"), F.lit(True).alias("real"))
    expiry = F.when(
        F.col("_ends"),
        F.struct((F.col("_us") + window_us).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("real")),
    )
    events = stepped.withColumn("_event", F.explode(F.array_compact(F.array(own, expiry))))
    timeline = Window.partitionBy(key).orderBy("_event.at")
    return (
        events.withColumn(name, F.sum("_event.step").over(timeline).cast("long"))
        .where(F.col("_event.real"))
        .drop("_event", "_starts", "_ends")
    )


def distinct_steps_sliced(
    df: DataFrame, key: str, item: str, window_us: int, name: str, cfg: EngineConfig, base: DataFrame | None = None
) -> DataFrame:
    """The same steps for hot keys, on distinct uses cut into time slices."""
    source = df if base is None else base
    uses = source.where(F.col(item).isNotNull()).select(key, item, "_us").distinct()
    uses = with_slices(uses, [key], "_us", cfg)
    seen = previous_values(uses, [key, item], ["_us"], ["_us"], "_prev")
    gap = F.col("_us") - F.col("_prev._us")
    # a run opens at its first use; the run before it, if any, closed one window after its last use
    opened = F.struct(F.col("_us").alias("at"), F.lit(1).alias("step"))
    closed = F.when(gap.isNotNull(), F.struct((F.col("_prev._us") + window_us).alias("at"), F.lit(-1).alias("step")))
    runs = (
        seen.where(gap.isNull() | (gap >= window_us))
        .select(key, F.explode(F.array_compact(F.array(opened, closed))).alias("_event"))
        .select(key, F.col("_event.at").alias("_us"), F.col("_event.step").alias("_step"))
    )
    final = uses.groupBy(key, item).agg((F.max("_us") + window_us).alias("_us")).select(key, "_us", F.lit(-1).alias("_step"))
    asked = source.select(key, "_us", F.lit(0).alias("_step"))
    steps = runs.unionByName(final).unionByName(asked)
    steps = steps.groupBy(key, "_us").agg(F.sum("_step").alias("_step"))
    steps = with_slices(steps, [key], "_us", cfg)
    counted = running_sums(steps, [key], ["_us"], {name: F.col("_step")})
    return df.join(counted.select(key, "_us", F.col(name).cast("long").alias(name)), [key, "_us"], "left")


def occurrence_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """1, 2, 3, … per key in ``order``; null where any key is null. For ordinary keys."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = F.col(keys[-1]).isNotNull()
    return df.withColumn(name, F.when(known, number).cast("long"))


def occurrence_number_sliced(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, base: DataFrame | None = None
) -> DataFrame:
    """The same numbering for rows that already carry ``_slice``."""
    known = F.col(keys[-1]).isNotNull()
    unit = F.when(known, F.lit(1)).otherwise(F.lit(0))
    numbered = running_sums(sliced, keys, order, {name: unit}, base, each=True)
    return numbered.withColumn(name, F.when(known, F.col(name)).cast("long"))


def with_previous(
    df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], name: str, cfg: EngineConfig
) -> DataFrame:
    """Struct ``name`` with ``values`` of the key's preceding row; ``order[0]`` must be numeric."""

    def skewed(hot: DataFrame, keys: HotKeys) -> DataFrame:
        sliced = with_slices(hot, [key], order[0], cfg)
        return previous_values(sliced, [key], order, values, name).drop("_slice")

    before = F.lag(F.struct(*values)).over(Window.partitionBy(key).orderBy(*order))
    return by_heat(df, key, cfg, lambda cold: cold.withColumn(name, before), skewed)


@dataclass(frozen=True)
class Rolling:
    """One trailing total: sum of ``value`` over the left-open window of ``length_us``."""

    value: Column
    length_us: int
    kind: str = "bigint"


def rolling_totals(
    df: DataFrame, key: str, totals: dict[str, Rolling], cfg: EngineConfig, ts: str = "timestamp"
) -> DataFrame:
    """Trailing totals per key, peers included; ``kind`` should be an exact type (integer or decimal)."""
    rows = df.withColumn("_us", micros(ts))

    def regular(cold: DataFrame) -> DataFrame:
        def over(length: int):
            return Window.partitionBy(key).orderBy("_us").rangeBetween(-length + 1, 0)

        return cold.withColumns(
            {n: F.coalesce(F.sum(r.value.cast(r.kind)).over(over(r.length_us)), F.lit(0)) for n, r in totals.items()}
        )

    return by_heat(
        rows, key, cfg, regular, lambda hot, keys: hot.join(rolling_sliced(hot, key, totals, cfg), [key, "_us"], "left")
    ).drop("_us")


def rolling_sliced(df: DataFrame, key: str, totals: dict[str, Rolling], cfg: EngineConfig) -> DataFrame:
    """(key, _us, totals) at every instant of a hot key: a running sum of arrivals minus expiries.

    Rows of one instant are added up first, then every instant adds its values and takes them away
    again one window later. Exact types leave no residue, and the cost is linear in the rows.
    """
    ticks = df.groupBy(key, "_us").agg(
        *[F.coalesce(F.sum(r.value.cast(r.kind)), F.lit(0)).cast(r.kind).alias(n) for n, r in totals.items()]
    )

    def move(shift: int, real: int) -> Column:
        def amount(name: str, r: Rolling) -> Column:
            if real:
                return F.col(name)
            return (-F.col(name) if r.length_us == shift else F.lit(0)).cast(r.kind).alias(name)

        columns = [amount(n, r) for n, r in totals.items()]
        return F.struct((F.col("_us") + shift).alias("_us"), *columns, F.lit(real).alias("_real"))

    lengths = sorted({r.length_us for r in totals.values()})
    moves = F.array(move(0, 1), *[move(length, 0) for length in lengths])
    steps = ticks.select(key, F.explode(moves).alias("_move")).select(key, "_move.*")
    steps = steps.groupBy(key, "_us").agg(
        *[F.sum(n).cast(r.kind).alias(n) for n, r in totals.items()], F.max("_real").alias("_real")
    )
    steps = with_slices(steps, [key], "_us", cfg)
    running = running_sums(steps, [key], ["_us"], {f"_run_{n}": F.col(n) for n in totals})
    return running.where(F.col("_real") == 1).select(key, "_us", *[F.col(f"_run_{n}").alias(n) for n in totals])
