"""Calendar labels, range labels and end-of-pipeline text formatting."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import col_


def period_of(df: DataFrame, day: str, periods: DataFrame, label: str = "period") -> DataFrame:
    """``df`` with the label of the period that holds ``day`` (PF-13): periods
    are rows (label, since, until), half-open, with a NULL border for an open
    end.  Where periods overlap, the one that begins last counts (then the
    greatest label); a day in a hole has NULL.  Periods are a parameter table,
    sent to every task once as an ordered array, so no row is multiplied."""
    all_ = F.broadcast(periods.agg(F.sort_array(F.collect_list(F.struct("since", "label", "until"))).alias("_periods")))
    holds = F.filter("_periods", lambda p: (p["since"].isNull() | (p["since"] <= F.col(day))) & (p["until"].isNull() | (F.col(day) < p["until"])))
    return df.crossJoin(all_).withColumn(label, F.try_element_at(holds, F.lit(-1))["label"]).drop("_periods")


def year_label(day: str | Column) -> Column:
    return F.year(col_(day)).cast("string")


def quarter_label(day: str | Column) -> Column:
    """``2026-Q1`` (SC-2)."""
    d = col_(day)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_label(day: str | Column) -> Column:
    """``2026-02`` (SC-3)."""
    return F.date_format(col_(day), "yyyy-MM")


def period_label(day: str | Column, cuts: Sequence[tuple[date, str]], last: str) -> Column:
    """First label whose cut date is after ``day``; ``last`` when none is (PF-13).
    ``cuts`` must be ascending."""
    d = col_(day)
    out = None
    for cut, label in cuts:
        cond = d < F.lit(cut)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(last)) if out is not None else F.lit(last)


def pct_text(c: str | Column, places: int = 2) -> Column:
    """``0.7425`` -> ``74.25%``; the value is rounded first so the text does not
    depend on the formatter's tie rule."""
    return F.format_string(f"%.{places}f%%", F.round(col_(c) * 100, places))


def money_m_text(c: str | Column, places: int = 2) -> Column:
    """``6125625.0`` -> ``$6.13M``."""
    return F.format_string(f"$%.{places}fM", F.round(col_(c) / 1e6, places))
