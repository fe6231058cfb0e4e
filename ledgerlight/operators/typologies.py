"""Typologies that need several rows: windows per account and bounded joins over money-flow edges.

Edges are (transaction_id, src, dst, timestamp, amount). Accounts may be hubs: trailing counts take
the sliced way for hot accounts, and whether an edge has a follower is a running extreme over cells of
time and size, linear in a hub's edges. Only edges that can be part of a whole cycle are paired. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.functions.timeparts import DAY, HOUR, micros
from ledgerlight.operators.ordered import (
    Heat,
    HotKeys,
    Rolling,
    by_heat,
    find_hot_keys,
    rolling_distinct,
    rolling_totals,
    running_extremes,
    with_previous,
    with_slices,
)
from ledgerlight.session import materialise

MONEY = "decimal(24,6)"
# Merchant categories of trade-based laundering.
TRADE_CATEGORIES = ("Freight/Shipping", "Building Materials", "Wire Transfer Agency")


def edges_from_transactions(transactions: DataFrame) -> DataFrame:
    """Transfers between two accounts as edges."""
    return transactions.where(F.col("counterparty_account_id").isNotNull()).select(
        "transaction_id", F.col("account_id").alias("src"), F.col("counterparty_account_id").alias("dst"),
        "timestamp", "amount",
    )


# --- trailing counts per account --------------------------------------------------------------------


def structuring(
    transactions: DataFrame, key: str = "account_id", threshold: float | None = None,
    cfg: EngineConfig = EngineConfig(), credit_types: tuple[str, ...] | None = ("Credit",),
) -> DataFrame:
    """Credits in the band just below the threshold, with at least ``structuring_count`` in the window."""
    limit = cfg.reporting_threshold if threshold is None else threshold
    low, high = cfg.structuring_band
    rows = transactions
    if credit_types is not None:
        rows = rows.where(F.col("transaction_type").isin(*credit_types))
    near = rows.where(F.col("amount").between(low * limit, high * limit))
    spec = {"near_threshold_count": Rolling(F.lit(1), cfg.structuring_days * DAY)}
    return rolling_totals(near, key, spec, cfg).where(F.col("near_threshold_count") >= cfg.structuring_count)


def smurfing(edges: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Payments into an account that had at least ``smurfing_senders`` senders in the window."""
    counted = rolling_distinct(edges, "dst", "src", cfg.smurfing_hours * HOUR, "senders", cfg)
    return counted.where(F.col("senders") >= cfg.smurfing_senders)


def velocity_anomalies(transactions: DataFrame, key: str = "account_id", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """More than ``velocity_max_per_day`` in 24 h or ``burst_max_per_hour`` in one hour."""
    spec = {"count_24h": Rolling(F.lit(1), DAY), "count_1h": Rolling(F.lit(1), HOUR)}
    return rolling_totals(transactions, key, spec, cfg).withColumns(
        {
            "is_velocity": F.coalesce(F.col("count_24h") > cfg.velocity_max_per_day, F.lit(False)),
            "is_burst": F.coalesce(F.col("count_1h") > cfg.burst_max_per_hour, F.lit(False)),
        }
    )


def mule_pass_through(edges: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Incoming payments of which at least ``mule_ratio`` leaves the account within the window.

    The outflow in (t, t + window] is a trailing total asked for at t + window.
    """
    length = cfg.mule_hours * HOUR
    out = edges.select(F.col("src").alias("account"), micros("timestamp").alias("_at"), F.col("amount").alias("_out"))
    asked = edges.select(
        F.col("dst").alias("account"), (micros("timestamp") + length).alias("_at"), F.lit(None).cast("double").alias("_out"),
        F.struct("transaction_id", "amount").alias("_in"),
    )
    both = out.withColumn("_in", F.lit(None).cast(asked.schema["_in"].dataType)).unionByName(asked)
    both = both.withColumn("_when", F.timestamp_micros("_at"))
    total = {"_outflow": Rolling(F.col("_out").try_cast(MONEY), length, "decimal(30,6)")}
    answered = rolling_totals(both, "account", total, cfg, ts="_when").where(F.col("_in").isNotNull())
    passed = answered.select(
        "account", F.col("_in.transaction_id").alias("transaction_id"), F.col("_in.amount").alias("amount_in"),
        F.col("_outflow").cast("double").alias("amount_out"),
    )
    return passed.where(F.col("amount_out") >= cfg.mule_ratio * F.col("amount_in"))


def dormant_activation(
    transactions: DataFrame, key: str = "account_id", min_amount: float = 0.0, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """First activity after ``dormant_days`` of silence, or any on an account marked dormant."""
    rows = transactions.withColumn("_us", micros("timestamp"))
    before = with_previous(rows, key, ["_us", "transaction_id"], ["_us"], "_before", cfg)
    idle = (F.col("_us") - F.col("_before._us")) / F.lit(float(DAY))
    woke = idle > cfg.dormant_days
    if "account_status" in transactions.columns:
        woke = woke | (F.col("account_status") == "Dormant")
    return before.withColumn("idle_days", idle).where(woke & (F.col("amount") >= min_amount)).drop("_us", "_before")


def balance_reconciliation(transactions: DataFrame, tolerance: float = 0.01, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Rows whose balance is negative or does not follow from the balance before."""
    rows = transactions.withColumn("_us", micros("timestamp"))
    before = with_previous(rows, "account_id", ["_us", "transaction_id"], ["balance_after"], "_before", cfg)
    signed = F.when(F.col("transaction_type") == "Credit", F.col("amount")).otherwise(-F.col("amount"))
    off = F.col("balance_after") - F.col("_before.balance_after") - signed
    # half a unit of the last written place is lost in either balance, so compare rounded
    broken = F.round(F.abs(off), 6) > tolerance
    return (
        before.withColumn("balance_gap", off)
        .where(F.coalesce(broken, F.lit(False)) | (F.col("balance_after") < 0))
        .drop("_us", "_before")
    )


# --- flows over edges -------------------------------------------------------------------------------


def _keyed(edges: DataFrame) -> DataFrame:
    """Saved edges under short names, with ``e_row`` to tell copies apart."""
    keyed = edges.select(
        F.col("transaction_id").alias("e_id"), F.col("src").alias("e_src"), F.col("dst").alias("e_dst"),
        micros("timestamp").alias("e_us"), F.col("amount").cast("double").alias("e_amount"),
    )
    return materialise(keyed.withColumn("e_row", F.monotonically_increasing_id()))


class FlowBand:
    """Which edges may follow an edge: later within ``hours`` and sized ``low``..``high`` of it.

    With ``ordered=False`` the follower may also be earlier by up to ``hours``. A ratio of sizes needs positive amounts:
    edges without one (zero, negative, null) follow nothing and are followed by nothing.

    What may follow an edge is a box in time and logarithm of size, of one shape for all edges. Cells are no larger than that
    box, so a box covers of every cell that it meets a corner, a side or all.
    """

    def __init__(self, low: float, high: float, hours: float, ordered: bool = True):
        self.low, self.high, self.window, self.ordered = low, high, int(hours * HOUR), ordered
        # a little narrower than the box, so that no box lies inside one cell with room on both sides
        self.step = 0.999 * math.log(high / low) if high > low else 1.0

    def over(self, steps: int) -> FlowBand:
        """The band between the first and the last of two to ``steps + 1`` edges that follow each other."""
        low, high = min(self.low, self.low**steps), max(self.high, self.high**steps)
        return FlowBand(low * (1 - 1e-9), high * (1 + 1e-9), self.window * steps / HOUR, self.ordered)

    def cell(self, us: Column, amount: Column) -> tuple[Column, Column]:
        return F.floor(us / F.lit(self.window)), F.floor(F.log(amount) / F.lit(self.step))

    def times(self, us: Column, ahead: bool) -> tuple[Column, Column]:
        """First and last time of what may follow (``ahead``) or come before."""
        if not self.ordered:
            return us - self.window, us + self.window
        return (us + 1, us + self.window) if ahead else (us - self.window, us - 1)

    def sizes(self, amount: Column, ahead: bool) -> tuple[Column, Column]:
        """Bounds of their sizes, a margin wider: they only choose cells, the exact ratio is tested later."""
        low, high = (amount * self.low, amount * self.high) if ahead else (amount / self.high, amount / self.low)
        return low * (1 - 1e-9), high * (1 + 1e-9)

    def fits(self, earlier: Column, later: Column) -> Column:
        ratio = later / earlier
        return (ratio >= self.low) & (ratio <= self.high)

    def reach(self, rows: DataFrame, p: str, ahead: bool = True) -> DataFrame:
        """One row for each cell that may hold a follower (or a predecessor) of edge ``p``."""
        us, amount = F.col(f"{p}_us"), F.col(f"{p}_amount")
        (first, last), (low, high) = self.times(us, ahead), self.sizes(amount, ahead)
        t0, a0 = self.cell(first, low)
        t1, a1 = self.cell(last, high)
        return rows.where(amount > 0).withColumns({"_last": t1, "_tc": F.explode(F.sequence(t0, t1))}).withColumn("_ac", F.explode(F.sequence(a0, a1)))

    def located(self, rows: DataFrame, p: str) -> DataFrame:
        t, a = self.cell(F.col(f"{p}_us"), F.col(f"{p}_amount"))
        return rows.where(F.col(f"{p}_amount") > 0).withColumns({"_tc": t, "_ac": a})

    def spread(self, rows: DataFrame, ahead: bool) -> DataFrame:
        """Rows in their cells: points (without ``e_row``) twice in their own, edges that ask once in each that their box meets.

        On side 0 a cell is read forwards in time, on side 1 backwards; ``_at`` is the place in that order.
        """
        us, amount, ask = F.col("e_us"), F.col("e_amount"), F.col("e_row").isNotNull()
        (first, last), (low, high) = self.times(us, ahead), self.sizes(amount, ahead)
        t0, a0 = self.cell(first, low)
        t1, a1 = self.cell(last, high)
        t, a = self.cell(us, amount)
        split = rows.withColumn("_tc", F.explode(F.when(ask, F.sequence(t0, t1)).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))))
        split = split.withColumn("_ac", F.explode(F.when(ask, F.sequence(a0, a1)).otherwise(F.array(a))))
        split = split.withColumn("_side", F.when(ask, (F.col("_tc") < t1).cast("int")).otherwise(F.col("_tc").cast("int")))
        back = F.col("_side") == 1
        at = F.when(ask, F.when(back, -first).otherwise(last)).otherwise(F.when(back, -us).otherwise(us))
        return split.withColumns({"_tc": F.when(ask, F.col("_tc")).otherwise(t), "_at": at, "_ask": ask, "_amount": F.when(~ask, amount)})

    def follows(self, first: str, second: str) -> Column:
        gap = F.col(f"{second}_us") - F.col(f"{first}_us")
        near = (gap > 0) & (gap <= self.window) if self.ordered else (F.abs(gap) <= self.window)
        return near & self.fits(F.col(f"{first}_amount"), F.col(f"{second}_amount")) & (F.col(f"{first}_id") != F.col(f"{second}_id"))


CELL = ["_account", "_tc", "_ac", "_side"]
BLOCK = ["_account", "_bt", "_bs"]
ORDER = ("_at", "_ask")
#: Narrow rows of a sweep that a task spreads over cells, about.
DEALT_ROWS = 400_000
#: Paths are named when they are whole if so many edges stand against one that is left for them.
LATE_IDS = 4


class Blocks(NamedTuple):
    """Hot accounts cut into blocks of 2^``_width`` by 2^``_width`` cells (``table``); ``full``: others have a cell that holds too many rows for a task."""

    table: DataFrame
    small: bool
    full: bool


#: Blocks grow to at most 2^WIDEST cells a side.
WIDEST = 10


def _shifted(cell: Column) -> Column:
    return F.call_function("shiftright", cell, F.col("_width"))


def _blocks(edges: DataFrame, band: FlowBand, cfg: EngineConfig, hot: HotKeys) -> Blocks:
    """For each hot account the widest blocks of cells that hold no more rows than a task may have, from counts by cell."""
    most = max(cfg.hot_key_rows, cfg.task_rows)
    ends = edges.select(F.explode(F.array("e_src", "e_dst")).alias("_account"), "e_us", "e_amount").join(hot.hinted(), "_account", "left_semi")
    cells = materialise(band.located(ends, "e").groupBy("_account", "_tc", "_ac").agg(F.count(F.lit(1)).alias("_rows")))
    tried = cells.withColumn("_width", F.explode(F.sequence(F.lit(0), F.lit(WIDEST))))
    sizes = tried.groupBy("_account", "_width", _shifted(F.col("_tc")).alias("_bt"), _shifted(F.col("_ac")).alias("_bs")).agg(F.sum("_rows").alias("_rows"))
    fullest = materialise(sizes.groupBy("_account", "_width").agg(F.max("_rows").alias("_rows")))
    widths = fullest.where(F.col("_rows") <= most).groupBy("_account").agg(F.max("_width").alias("_width"))
    return Blocks(widths, hot.small, fullest.where(F.col("_rows") > most).where("_width = 0").limit(1).count() > 0)


def _dealt_by_block(rows: DataFrame, band: FlowBand, ahead: bool, blocks: Blocks) -> DataFrame:
    """Rows with the blocks (``_bt``, ``_bs``) that need them: an edge that asks is in its own, a point in all from which it may be asked for."""
    us, amount, ask = F.col("e_us"), F.col("e_amount"), F.col("e_row").isNotNull()
    (first, last), (low, high) = band.times(us, not ahead), band.sizes(amount, not ahead)
    (t0, a0), (t1, a1), (t, a) = band.cell(first, low), band.cell(last, high), band.cell(us, amount)

    def places(own: Column, start: Column, end: Column) -> Column:
        return F.explode(F.when(ask, F.array(_shifted(own))).otherwise(F.sequence(_shifted(start), _shifted(end))))

    placed = rows.join(F.broadcast(blocks.table) if blocks.small else blocks.table, "_account")
    return placed.withColumn("_bt", places(t, t0, t1)).withColumn("_bs", places(a, a0, a1)).drop("_width")


def _pieces(rows: DataFrame) -> list[int]:
    """The number of tasks that narrow rows need if one is not enough; left to Spark, they would be joined by compressed bytes and grow in the cells."""
    pieces = -(-rows.count() // DEALT_ROWS)
    return [max(pieces, rows.sparkSession.sparkContext.defaultParallelism)] if pieces > 1 else []


def _answered(rows: DataFrame, band: FlowBand, ahead: bool, unit: list[str]) -> DataFrame:
    """Asking edges that have a partner, from rows that are dealt by ``unit`` (accounts or their blocks) and spread over cells where they lie."""
    seen = running_extremes(band.spread(rows, ahead), [*unit, *CELL[1:]], ORDER, "_amount")
    # an edge asks in one unit only: where that has dealt the rows, nothing is shuffled
    return _fitting(seen, band, ahead, [*unit, *[c for c in rows.columns if c not in unit]]).drop(*unit[1:])


def _fitting(seen: DataFrame, band: FlowBand, ahead: bool, columns: list[str]) -> DataFrame:
    own = F.col("e_amount")
    fits = [band.fits(own, F.col(c)) if ahead else band.fits(F.col(c), own) for c in ("_most", "_least")]
    return seen.where("_ask").where(fits[0] | fits[1]).select(*columns).distinct()


def _swept_by_heat(rows: DataFrame, band: FlowBand, cfg: EngineConfig, heat: Heat, ways: dict[bool, Callable[[DataFrame], DataFrame]], blocks: Blocks | None) -> DataFrame:
    """Sweeps of one dealing of ``rows``, in each direction (``ahead``) of ``ways``, which say what asks and what is a point there.

    Rows of ordinary accounts are dealt by account, once for all directions. Hot accounts are dealt by blocks of their cells.
    Those with a cell that is too full for that are dealt by cell, and such cells are cut into slices.
    """
    parts = _pieces(rows)

    def both(step: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        found = [step(way, ahead).withColumn("_ahead", F.lit(ahead)) for ahead, way in ways.items()]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def ordinary(cold: DataFrame) -> DataFrame:
        dealt = cold.repartition(*parts, "_account")
        return both(lambda way, ahead: _answered(way(dealt), band, ahead, ["_account"]))

    def by_block(way, ahead: bool, hot: DataFrame, cut: Blocks) -> DataFrame:
        dealt = _dealt_by_block(way(hot), band, ahead, cut).repartition(*parts, *BLOCK)
        return _answered(dealt, band, ahead, BLOCK)

    def by_cell(way, ahead: bool, hot: DataFrame) -> DataFrame:
        asked = way(hot)
        cells = band.spread(asked, ahead).withColumn("_cell", F.struct("_account", "_tc", "_ac"))
        seen = by_heat(
            cells, "_cell", cfg, lambda cold: running_extremes(cold.drop("_cell"), CELL, ORDER, "_amount"),
            lambda full, _: running_extremes(with_slices(full.drop("_cell"), CELL, "_at", cfg), CELL, ORDER, "_amount", sliced=True), keep_null=False,
            heat=Heat(*find_hot_keys(cells, "_cell", cfg)),
        )
        return _fitting(seen, band, ahead, asked.columns)

    def skewed(hot: DataFrame, keys: HotKeys) -> DataFrame:
        found = both(lambda way, ahead: by_block(way, ahead, hot, blocks))
        if not blocks.full:
            return found
        rest = hot.join(F.broadcast(blocks.table) if blocks.small else blocks.table, "_account", "left_anti")
        return found.unionByName(both(lambda way, ahead: by_cell(way, ahead, rest)))

    return by_heat(rows, "_account", cfg, ordinary, skewed, keep_null=False, heat=heat)


def _linked(
    edges: DataFrame, others: DataFrame, band: FlowBand, mine: str, theirs: str, ahead: bool, cfg: EngineConfig, heat: Heat, blocks: Blocks | None = None
) -> DataFrame:
    """Those of ``edges`` that have, at account ``mine``, one of ``others`` (their account ``theirs``) later or earlier within the band.

    In a cell the box of an edge is open towards the cell's border, so the edge has a partner there if the largest or the
    smallest of the others on its side fits: a running extreme in order of time, read forwards for the last cell and backwards
    for those before. Every edge adds two rows and asks in at most six cells (nine without order), so the rows are linear in
    the edges, however many meet at one account. Pairs are never formed.

    Rows are dealt by account or, for hot accounts, by block, and spread over cells where they lie, so narrow rows are shuffled: two an edge,
    and a hot account's points once more for each block beside their own that may ask for them.
    """
    kept = [F.col(c).alias("_account") if c == mine else F.col(c) for c in edges.columns]
    points = others.where(F.col("e_amount") > 0).select(F.col(theirs).alias("_account"), "e_us", "e_amount")
    rows = points.unionByName(edges.where(F.col("e_amount") > 0).select(*kept), allowMissingColumns=True)
    found = _swept_by_heat(rows, band, cfg, heat, {ahead: lambda dealt: dealt}, blocks)
    return found.drop("_ahead").withColumnRenamed("_account", mine)


class Flows:
    """Saved edges, the band and the hot accounts: what every search over flows needs."""

    def __init__(self, edges: DataFrame, band: FlowBand, cfg: EngineConfig):
        self.base, self.band, self.cfg = _keyed(edges), band, cfg
        ends = self.base.select(F.explode(F.array("e_src", "e_dst")).alias("_account"))
        self.heat = Heat(find_hot_keys(ends, "_account", cfg)[0], False)
        # without order, an edge from an account to itself could be taken for its own partner
        self.alone = not band.ordered and band.low <= 1.0 <= band.high
        # what sweeps carry; ids only where they are compared
        self.narrow = self.base if self.alone else self.base.drop("e_id")
        self.blocks = self.cut(self.narrow, band)

    def cut(self, edges: DataFrame, band: FlowBand) -> Blocks | None:
        """Blocks of the hot accounts, if there are any, for ``edges`` and cells of ``band``."""
        return _blocks(edges, band, self.cfg, self.heat.hot) if self.heat.hot else None

    def whole(self, marks: DataFrame) -> DataFrame:
        """The saved edges with the columns of ``marks`` (e_row, ...); few marks go to the edges, which stay where they are."""
        saved = materialise(marks)
        few = saved.limit(self.cfg.broadcast_rows + 1).count() <= self.cfg.broadcast_rows
        return self.base.join(F.broadcast(saved) if few else saved, "e_row")

    def linked(self, edges: DataFrame, others: DataFrame, ahead: bool) -> DataFrame:
        """Edges that are continued by one of ``others`` (``ahead``) or continue one; saved."""
        mine, theirs = ("e_dst", "e_src") if ahead else ("e_src", "e_dst")
        loops = F.coalesce(F.col("e_src") == F.col("e_dst"), F.lit(False))
        plain = edges.where(~loops) if self.alone else edges
        found = _linked(plain, others, self.band, mine, theirs, ahead, self.cfg, self.heat, self.blocks)
        if self.alone:
            reach = self.band.reach(edges.where(loops), "e", ahead)
            partners = self.band.located(_rename(others, "e", "o"), "o")
            match = (F.col(mine) == F.col(theirs.replace("e_", "o_"))) & (self.band.follows("e", "o") if ahead else self.band.follows("o", "e"))
            same = [reach[c] == partners[c] for c in ("_tc", "_ac")]
            found = found.unionByName(reach.join(partners, match & same[0] & same[1], "left_semi").select(*found.columns).dropDuplicates(["e_row"]))
        return materialise(found)

    def first(self) -> dict[bool, DataFrame]:
        """The edges that are continued (True) and those that continue one (False), both from one dealing of the edges by their two accounts.

        At its receiver an edge asks for later payments and is what they ask for, at its payer the other way round.
        """
        ends = [F.struct(F.col(here).alias("_account"), F.col(there).alias("_other"), F.lit(out).alias("_out")) for here, there, out in (("e_dst", "e_src", False), ("e_src", "e_dst", True))]
        rows = self.narrow.where(F.col("e_amount") > 0).select("e_us", "e_amount", "e_row", F.inline(F.array(*ends)))

        def way(ahead: bool) -> Callable[[DataFrame], DataFrame]:
            asks = F.col("_out") != F.lit(ahead)
            return lambda dealt: dealt.select("_account", "e_us", "e_amount", *[F.when(asks, F.col(c)).alias(c) for c in ("e_row", "_other")])

        found = materialise(_swept_by_heat(rows, self.band, self.cfg, self.heat, {ahead: way(ahead) for ahead in (True, False)}, self.blocks))
        names = {True: ("_other", "_account"), False: ("_account", "_other")}
        columns = lambda ahead: ["e_us", "e_amount", "e_row", *[F.col(c).alias(n) for c, n in zip(names[ahead], ("e_src", "e_dst"))]]
        return {ahead: found.where(F.col("_ahead") == F.lit(ahead)).select(*columns(ahead)) for ahead in names}

    def levels(self, steps: int, ahead: bool, first: DataFrame | None = None) -> list[DataFrame]:
        """Edges with at least 0, 1, ..., ``steps`` edges one after another behind (``ahead``) or before them; ``first``: the second of them, if known."""
        out = [self.narrow] if first is None else [self.narrow, first]
        for _ in range(steps + 1 - len(out)):
            out.append(self.linked(out[-1], out[-1], ahead))
        return out

    def marks(self, steps: int, least: int, narrow: bool = True) -> DataFrame:
        """(e_row, _before, _behind): how many edges, up to ``steps``, lead to an edge and go on from it, where they are ``least`` together.

        Without ``narrow`` with the columns that sweeps carry: one of the two numbers is half of ``least`` or more, so the edges of that
        level bring them and all others come as a number only.
        """
        sides = {"_before": False, "_behind": True}
        first = {} if self.alone else self.first()
        kinds = {} if narrow else {c: t for c, t in self.narrow.dtypes if c != "e_row"}
        marks = None
        for name, ahead in sides.items():
            for i, level in enumerate(self.levels(steps, ahead, first.get(ahead))[1:], 1):
                carried = [F.col(c) if i == -(-least // 2) else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
                part = level.select("e_row", *carried, *[F.lit(i if c == name else 0).alias(c) for c in sides])
                marks = part if marks is None else marks.unionByName(part)
        found = marks.groupBy("e_row").agg(*[F.max(c).alias(c) for c in [*kinds, *sides]])
        return found.where(F.col("_before") + F.col("_behind") >= least)

    def named(self, paths: DataFrame, column: str) -> DataFrame:
        """Paths with the ids of their edges for the ``e_row`` in the array ``column``; few edges go to the saved ones."""
        saved = materialise(paths.withColumn("_path", F.monotonically_increasing_id()))
        rows = saved.select("_path", F.posexplode(column).alias("_place", "e_row"))
        names = materialise(self.whole(rows.select("e_row").distinct()).select("e_row", "e_id"))
        few = names.limit(self.cfg.broadcast_rows + 1).count() <= self.cfg.broadcast_rows
        ids = rows.join(F.broadcast(names) if few else names, "e_row").groupBy("_path").agg(F.array_sort(F.collect_list(F.struct("_place", "e_id"))).alias("_ids"))
        return saved.join(ids, "_path").withColumn(column, F.transform("_ids", lambda x: x["e_id"])).drop("_path", "_ids")


def _rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.select(*[F.col(c).alias(new + c[len(old):]) if c.startswith(f"{old}_") else F.col(c) for c in df.columns])


def _as_edges(rows: DataFrame, **more: Column) -> DataFrame:
    return rows.select(
        F.col("e_id").alias("transaction_id"), F.col("e_src").alias("src"), F.col("e_dst").alias("dst"),
        F.timestamp_micros("e_us").alias("timestamp"), F.col("e_amount").alias("amount"), *[c.alias(n) for n, c in more.items()],
    )


def layering_chains(
    edges: DataFrame, cfg: EngineConfig = EngineConfig(), ordered: bool = True
) -> DataFrame:
    """Edges that end a chain of at least ``layering_hops`` hops, each 92–99 % of the one before.

    The number of rounds is the fixed number of hops; every round is one sweep over cells (see ``_linked``). An edge that
    continues an edge with i hops before it has i + 1, so each round asks only those that the one before has kept.
    """
    flows = Flows(edges, FlowBand(*cfg.hop_ratio, cfg.hop_hours, ordered), cfg)
    return _as_edges(flows.whole(flows.levels(cfg.layering_hops - 1, ahead=False)[-1].select("e_row"))).withColumn("hops", F.lit(cfg.layering_hops))


def layering_members(edges: DataFrame, cfg: EngineConfig = EngineConfig(), ordered: bool = True) -> DataFrame:
    """Every edge of a chain of at least ``layering_hops`` hops, with ``is_first`` and ``is_last`` for its ends.

    An edge belongs to such a chain if the hops that lead to it and those that go on from it are enough together; both are
    found level by level. An edge may be the first of one and the last of another chain. No chain is ever spelled out, so a
    hub's many chains cost no more than its edges.
    """
    flows = Flows(edges, FlowBand(*cfg.hop_ratio, cfg.hop_hours, ordered), cfg)
    last = cfg.layering_hops - 1
    if last == 0:
        return _as_edges(flows.base).withColumns({"hops": F.lit(1), "is_first": F.lit(True), "is_last": F.lit(True)})
    found = flows.whole(flows.marks(last, last))
    return _as_edges(found, hops=F.lit(cfg.layering_hops), is_first=F.col("_behind") >= last, is_last=F.col("_before") >= last)


def circular_flows(
    edges: DataFrame, nodes: int = 3, ratio: tuple[float, float] = (0.85, 1.0), hours: float = 48.0,
    ordered: bool = True, up_to: int | None = None, cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """Cycles of ``nodes`` (to ``up_to``, if given) distinct accounts that return to their origin, one row per cycle.

    All lengths share one pruning: how many edges can lead to an edge and go on from it (found by sweeps), and whether any
    edge returns to the origin of a first edge in time. Halves of cycles are then built from what is left, forwards from first
    and backwards from last edges, and meet on origin and middle account, so only halves of one cycle's ends are paired.
    """
    most = up_to or nodes
    flows = Flows(edges.where(F.col("src") != F.col("dst")), FlowBand(*ratio, hours, ordered), cfg)
    core, wide = materialise(flows.marks(most - 1, nodes - 1, narrow=False)), flows.band.over(most - 1)
    # where few edges are left, paths are fewer still and are given ids when they are whole
    late = not flows.alone and core.count() * LATE_IDS < flows.base.count()
    if not late and not flows.alone:
        core = materialise(flows.whole(core.select("e_row", "_before", "_behind")))
    key = "e_row" if late else "e_id"
    blocks = flows.cut(core, wide)
    starts = _linked(core.where(F.col("_behind") >= nodes - 1), core.where(F.col("_before") >= nodes - 1), wide, "e_src", "e_dst", True, cfg, flows.heat, blocks)
    ends = _linked(core.where(F.col("_before") >= nodes - 1), core.where(F.col("_behind") >= nodes - 1), wide, "e_dst", "e_src", False, cfg, flows.heat, blocks)

    one = lambda rows: rows.select(
        F.array(key).alias("ids"), F.array("e_src").alias("accounts"), F.col("e_src").alias("from"), F.col("e_dst").alias("to"),
        *[F.col(key if c == "id" else f"e_{c}").alias(f"{side}_{c}") for side in ("l", "r") for c in ("id", "us", "amount")], "_before", "_behind",
    )
    fore, back = [materialise(one(starts))], [materialise(one(ends))]
    for i in range(1, (most + 1) // 2):
        step = one(core.where((F.col("_before") >= i) & (F.col("_behind") >= max(nodes - 1 - i, 0))))
        fore.append(materialise(_met(fore[-1], step, flows.band)))
    for i in range(1, most // 2):
        step = one(core.where((F.col("_behind") >= i) & (F.col("_before") >= max(nodes - 1 - i, 0))))
        back.append(materialise(_met(step, back[-1], flows.band)))
    found = None
    for k in range(nodes, most + 1):
        h = (k + 1) // 2
        left = fore[h - 1].where(F.col("_behind") >= k - h)
        part = _met(left, back[k - h - 1].where(F.col("_before") >= h), flows.band, closed=True)
        found = part if found is None else found.unionByName(part)
    if late:
        # edges of one id do not follow each other, nor do those without one
        found = flows.named(found, "ids").where("forall(sequence(0, size(ids) - 2), i -> ids[i] != ids[i + 1])")
    cycles = found.select(
        F.col("ids").alias("transactions"), "accounts", F.col("l_amount").alias("first_amount"), F.col("r_amount").alias("last_amount"),
    )
    if ordered:
        return cycles
    return cycles.withColumn("_set", F.array_sort("transactions")).dropDuplicates(["_set"]).drop("_set")


def _met(first: DataFrame, second: DataFrame, band: FlowBand, closed: bool = False) -> DataFrame:
    """Paths of ``first`` that go on with one of ``second`` and touch no account twice; ``closed``: and return to their origin.

    In a path l_* is its first edge, r_* its last; ``_before`` is the first edge's label, ``_behind`` the last one's.
    """
    left = band.reach(first.select(*[F.col(c).alias(f"x_{c}") for c in first.columns]).withColumns({f"a_{c}": F.col(f"x_r_{c}") for c in ("id", "us", "amount")}), "a")
    right = band.located(second.select(*[F.col(c).alias(f"y_{c}") for c in second.columns]).withColumns({f"b_{c}": F.col(f"y_l_{c}") for c in ("id", "us", "amount")}), "b")
    meet = (left["_tc"] == right["_tc"]) & (left["_ac"] == right["_ac"]) & (F.col("x_to") == F.col("y_from")) & band.follows("a", "b")
    meet = meet & ~F.arrays_overlap("x_accounts", "y_accounts")
    meet = meet & ((F.col("y_to") == F.col("x_from")) if closed else ~F.array_contains("x_accounts", F.col("y_to")))
    return left.join(right, meet).select(
        F.concat("x_ids", "y_ids").alias("ids"), F.concat("x_accounts", "y_accounts").alias("accounts"), F.col("x_from").alias("from"), F.col("y_to").alias("to"),
        *[F.col(f"x_l_{c}").alias(f"l_{c}") for c in ("id", "us", "amount")], *[F.col(f"y_r_{c}").alias(f"r_{c}") for c in ("id", "us", "amount")],
        F.col("x__before").alias("_before"), F.col("y__behind").alias("_behind"),
    )


# --- predicates and simple joins ----------------------------------------------------------------------


def round_amounts(transactions: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    return transactions.where(F.col("amount").isin(*cfg.round_amounts))


def high_risk_geography(transactions: DataFrame, country_risk: DataFrame) -> DataFrame:
    """Counterparty country on the grey or black list."""
    listed = country_risk.where(F.col("fatf_status").isin("Grey", "Black")).select(
        F.col("country_code").alias("counterparty_country"), F.col("fatf_status").alias("listed_as")
    )
    return transactions.join(listed, "counterparty_country")


def cross_border_unusual(transactions: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """First payment of a customer to a foreign country.

    The first transaction per pair is an aggregate, so no customer's history is sorted in one task.
    """
    country = F.col("counterparty_country")
    home = F.col("location_country") if "location_country" in transactions.columns else F.lit(cfg.home_country)
    rows = transactions.where(country.isNotNull() & (country != home))
    rank = F.struct("timestamp", "transaction_id")
    first = transactions.where(country.isNotNull()).groupBy("customer_id", "counterparty_country").agg(
        F.min(rank).alias("_first")
    ).select(F.col("customer_id").alias("_customer"), F.col("_first.transaction_id").alias("_first_id"))
    return rows.join(
        first, (F.col("customer_id") == F.col("_customer")) & (F.col("transaction_id") == F.col("_first_id")), "left_semi"
    )


def trade_based(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """Multiples of 10,000 paid to trade merchants."""
    trade = merchants.where(F.col("category").isin(*TRADE_CATEGORIES)).select("merchant_id")
    rows = transactions.where((F.col("amount") > 0) & (F.col("amount") % 10_000 == 0))
    return rows.join(trade, "merchant_id", "left_semi")


def shell_pass_through(
    transactions: DataFrame, min_amount: float = 200_000.0, segments: tuple[str, ...] = ("Corporate", "Business")
) -> DataFrame:
    """Accounts of companies with transfers of at least ``min_amount`` and nothing else."""
    rows = transactions
    if "profile_segment" in transactions.columns:
        rows = rows.where(F.col("profile_segment").isin(*segments))
    large = (F.col("transaction_type") == "Transfer") & (F.col("amount") >= min_amount)
    grouped = rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("txns"), F.count_if(large).alias("large_transfers"), F.sum("amount").alias("volume")
    )
    return grouped.where((F.col("txns") > 0) & (F.col("txns") == F.col("large_transfers")))


def relationship_based(edges: DataFrame, accounts: DataFrame, relationships: DataFrame) -> DataFrame:
    """Transfers between accounts of two related customers, in either direction."""
    owner = accounts.select("account_id", "customer_id")
    src = owner.select(F.col("account_id").alias("src"), F.col("customer_id").alias("src_customer"))
    dst = owner.select(F.col("account_id").alias("dst"), F.col("customer_id").alias("dst_customer"))
    a, b = F.col("customer_id_1"), F.col("customer_id_2")
    ends = F.array(
        F.struct(a.alias("src_customer"), b.alias("dst_customer")), F.struct(b.alias("src_customer"), a.alias("dst_customer"))
    )
    related = relationships.select(F.inline(ends)).distinct()
    owned = edges.join(src, "src").join(dst, "dst")
    return owned.join(related, ["src_customer", "dst_customer"], "left_semi")


def integration(
    transactions: DataFrame, min_amount: float = 300_000.0, layered: DataFrame | None = None
) -> DataFrame:
    """Large online debits to a merchant; with ``layered`` only of customers who ended a chain before."""
    rows = transactions.where(
        (F.col("transaction_type") == "Debit") & (F.col("channel") == "Online")
        & F.col("merchant_id").isNotNull() & (F.col("amount") >= min_amount)
    )
    if layered is None:
        return rows
    since = layered.groupBy("customer_id").agg(F.min("timestamp").alias("_since"))
    return rows.join(since, "customer_id").where(F.col("timestamp") > F.col("_since")).drop("_since")


def shared_devices(transactions: DataFrame) -> DataFrame:
    """Rows whose device is used by two or more customers, with the number of customers."""
    shared = (
        transactions.where(F.col("device_id").isNotNull()).groupBy("device_id")
        .agg(F.countDistinct("customer_id").alias("device_customers"))
        .where(F.col("device_customers") >= 2)
    )
    return transactions.join(shared, "device_id")


def ring_members(transactions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Transactions of fraud-ring members with ring and role."""
    rings = memberships.select("customer_id", "fraud_ring_id", "role")
    return transactions.join(rings, "customer_id")


def scenario_evaluation(labelled: DataFrame, flagged: dict[str, DataFrame]) -> DataFrame:
    """(scenario, labelled, flagged, hits, precision, recall) against the scenario tags.

    ``flagged`` maps a scenario tag to a frame with the transaction ids a search returned.
    """
    marks = None
    for tag, found in flagged.items():
        part = found.select("transaction_id").distinct().withColumn("scenario", F.lit(tag))
        marks = part if marks is None else marks.unionByName(part)
    truth = labelled.where(F.col("aml_scenario_tag").isNotNull()).select(
        "transaction_id", F.col("aml_scenario_tag").alias("scenario"), F.lit(1).alias("is_labelled")
    )
    both = truth.join(marks.withColumn("is_flagged", F.lit(1)), ["transaction_id", "scenario"], "full")
    hits = F.count_if(F.col("is_labelled").isNotNull() & F.col("is_flagged").isNotNull())
    return both.groupBy("scenario").agg(
        F.count("is_labelled").alias("labelled"), F.count("is_flagged").alias("flagged"), hits.alias("hits"),
        F.round(hits / F.nullif(F.count("is_flagged"), F.lit(0)), 4).alias("precision"),
        F.round(hits / F.nullif(F.count("is_labelled"), F.lit(0)), 4).alias("recall"),
    )
