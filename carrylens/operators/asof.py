"""As-of joins, interest accrual and state at many pins.

``asof_join`` gives each row the last row of another table at or before it.
A plain window partitioned by the key would hold a hot key (one reserve has
most events) in one task.  Here both sides are cut into slices of the order
axis; a slice starts with what stood at its beginning, which comes from one
summary row per key and slice, so the windows over events are partitioned by
(key, slice) and the window over slices runs on the summary only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import exact, scale


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    at: str,
    take: Sequence[str],
    slice_of: Callable[[Column], Column],
    tie: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``left`` with the ``take`` columns of the last row of
    ``right`` that has equal ``by`` columns and ``right.at <= left.at``; NULL
    where there is none.  Of right rows with one ``at`` the greatest by
    ``tie`` counts (without ``tie``, the greatest by the taken columns).
    ``slice_of`` maps ``at`` to its slice and must not decrease with it."""
    by, take = list(by), list(take)
    known = F.col(at).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    state = F.struct(*take)
    last = F.max(F.struct(*[F.col(c) for c in tie], state.alias("_s")))["_s"] if tie else F.max(state)
    r = right.filter(known).groupBy(*by, at).agg(last.alias("_s")).withColumn("_slice", slice_of(F.col(at)))
    lft = left.withColumn("_slice", F.when(known, slice_of(F.col(at))))
    # one summary row per key and slice: the state at its end, carried to the next ones
    ends = r.groupBy(*by, "_slice").agg(F.max(F.struct(F.col(at).alias("_at"), "_s"))["_s"].alias("_s"))
    asked = lft.filter("_slice is not null").select(*by, "_slice").distinct()
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (asked.join(ends, [*by, "_slice"], "full_outer")
               .select(*by, "_slice", F.last("_s", ignorenulls=True).over(before).alias("_s")).filter("_s is not null"))
    shape = [c for c in left.columns]
    rows = lft.select(*shape, "_slice", F.lit(None).cast(r.schema["_s"].dataType).alias("_s"), F.lit(2).alias("_kind"))
    for side, kind in ((r, 1), (carried, 0)):
        have = set(side.columns)
        rows = rows.unionByName(side.select(
            *[F.col(c) if c in have else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in shape], "_slice", "_s", F.lit(kind).alias("_kind")))
    upto = Window.partitionBy(*by, "_slice").orderBy(F.col(at).asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_s", F.last("_s", ignorenulls=True).over(upto)).filter("_kind = 2")
    return seen.select(*shape, *[F.when(F.col("_slice").isNotNull(), F.col("_s")[c]).alias(c) for c in take])


# ------------------------------------------------------------ interest accrual
def debt_events(borrow: DataFrame, repay: DataFrame, liquidation: DataFrame, reserves: Sequence[str]) -> DataFrame:
    """Signed debt changes with their time: (reserve, user_addr, amount, evt_block_time)."""
    ts = F.col("evt_block_time").cast("timestamp_ntz").alias("evt_block_time")
    b = borrow.filter(F.col("reserve").isin(*reserves)).select("reserve", F.col("on_behalf_of").alias("user_addr"), exact("amount").alias("amount"), ts)
    r = repay.filter(F.col("reserve").isin(*reserves)).select("reserve", F.col("user").alias("user_addr"), (-exact("amount")).alias("amount"), ts)
    q = liquidation.filter(F.col("debt_asset").isin(*reserves)).select(
        F.col("debt_asset").alias("reserve"), F.col("user").alias("user_addr"), (-exact("debt_to_cover")).alias("amount"), ts)
    return b.unionByName(r).unionByName(q)


def with_index(events: DataFrame, updates: DataFrame, index: str, initial: float = 1.0) -> DataFrame:
    """Events with the reserve's index at their time: that of the last update
    at or before them, ``initial`` before the first one."""
    u = updates.select("reserve", F.col("evt_block_time").cast("timestamp_ntz").alias("evt_block_time"), "evt_block_number", "evt_index", index)
    month = lambda c: F.date_trunc("month", c)
    j = asof_join(events, u, ["reserve"], "evt_block_time", [index], month, tie=("evt_block_number", "evt_index"))
    return j.withColumn(index, F.coalesce(F.col(index), F.lit(float(initial))))


def accrued_debt(events: DataFrame, updates: DataFrame, unit: float, index: str = "variable_borrow_index", initial: float = 1.0) -> DataFrame:
    """Principal and accrued debt per reserve and user.

    An event of ``amount`` at index ``i`` changes the scaled balance by
    ``round(amount / i)`` raw units; the debt now is scaled balance times the
    reserve's last index.  Principal is the plain net of the amounts, so the
    difference is the interest that event netting leaves out (T5).  Sums are
    exact integers; the events move once, after a partial aggregation."""
    scaled = F.round(F.col("amount").cast("double") / F.col(index)).cast("decimal(38,0)")
    g = with_index(events, updates, index, initial).groupBy("reserve", "user_addr").agg(
        F.sum("amount").alias("principal_raw"), F.sum(scaled).alias("scaled_raw"), F.count(F.lit(1)).alias("n_events"))
    # one row per reserve
    last = updates.groupBy("reserve").agg(F.max(F.struct("evt_block_time", "evt_block_number", "evt_index", F.col(index).alias("now")))["now"].alias("index_now"))
    j = g.join(last, "reserve", "left").withColumn("index_now", F.coalesce("index_now", F.lit(float(initial))))
    now = scale("scaled_raw", unit) * F.col("index_now")
    principal = scale("principal_raw", unit)
    return j.select("reserve", "user_addr", "n_events", principal.alias("principal_debt"), scale("scaled_raw", unit).alias("scaled_debt"),
                    now.alias("accrued_debt"), (now - principal).alias("interest"))


# ----------------------------------------------------------------- many pins
def states_at_pins(states: DataFrame, keys: Sequence[str], pins: DataFrame, block: str = "block_number", index: str | None = None) -> DataFrame:
    """The state of every key at every pin of ``pins(pin)``, from one pass over
    the history (SRC-9): the latest row with ``block <= pin`` by (block, index);
    keys without one are left out at that pin.

    Pins are a parameter table.  Each state belongs to the first pin at or
    after it, so the partial aggregation keeps one row per key and pin however
    long a key's history is, and a key's few rows are then carried forward."""
    keys = list(keys)
    cols = [c for c in states.columns if c not in keys]
    at = F.broadcast(pins.agg(F.sort_array(F.collect_set(F.col("pin").cast("bigint"))).alias("_pins")))
    order = F.struct(F.col(block), *([F.col(index)] if index else []))
    x = states.crossJoin(at).withColumn("_until", F.try_element_at(F.filter("_pins", lambda p: p >= F.col(block)), F.lit(1))).filter("_until is not null")
    per = x.groupBy(*keys, "_until").agg(F.max_by(F.struct(*cols), order).alias("_state"))
    history = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_until", "_state"))).alias("_history"))
    at_pin = history.crossJoin(at).select(*keys, "_history", F.explode("_pins").alias("pin"))
    last = F.try_element_at(F.filter("_history", lambda h: h["_until"] <= F.col("pin")), F.lit(-1))
    found = at_pin.withColumn("_last", last).filter("_last is not null")
    return found.select("pin", *keys, *[F.col("_last._state")[c].alias(c) for c in cols])
