"""Date helpers: inclusive windows, settlement periods, calendars."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.money import col


@dataclass(frozen=True)
class Window:
    """Closed range of days."""

    date_from: date
    date_to: date

    @property
    def days(self) -> int:
        return (self.date_to - self.date_from).days + 1

    def previous(self) -> "Window":
        """The same number of days, ending the day before this window."""
        return Window(self.date_from - timedelta(days=self.days), self.date_from - timedelta(days=1))

    def covers(self, moment: Column | str) -> Column:
        """From midnight of the first day up to, not including, midnight after the last."""
        after = self.date_to + timedelta(days=1)
        return (col(moment) >= F.lit(self.date_from).cast("timestamp")) & (
            col(moment) < F.lit(after).cast("timestamp")
        )


def calendar(spark: SparkSession, window: Window) -> DataFrame:
    """One row per day; bounded by the asked window."""
    return spark.range(window.days).select(F.date_add(F.lit(window.date_from), F.col("id").cast("int")).alias("day"))


def iso_weekday(moment: Column | str) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(col(moment)) + 1


def month_start(moment: Column | str) -> Column:
    return F.trunc(col(moment).cast("date"), "month")


# The settlement frequencies stored on an agent.
FREQUENCIES = ("monthly", "biweekly", "quaterly", "semi", "annual")


def period_start(day: Column | str, frequency: Column | str) -> Column:
    """First day of the settlement period that holds ``day``."""
    d, f = col(day), col(frequency)
    first = F.trunc(d, "month")
    half_year = F.when(F.month(d) > 6, F.add_months(F.trunc(d, "year"), 6)).otherwise(F.trunc(d, "year"))
    return (
        F.when(f == "monthly", first)
        .when(f == "biweekly", F.when(F.dayofmonth(d) >= 16, F.date_add(first, 15)).otherwise(first))
        .when(f == "quaterly", F.trunc(d, "quarter"))
        .when(f == "semi", half_year)
        .when(f == "annual", F.trunc(d, "year"))
    )


def period_end(start: Column | str, frequency: Column | str) -> Column:
    """Last day of the period that begins on ``start``.

    The second half-month closes one day before the month does; its last day still belongs to
    the same period because lines are grouped by period start.
    """
    s, f = col(start), col(frequency)
    return (
        F.when(f == "biweekly", F.when(F.dayofmonth(s) == 1, F.date_add(s, 14)).otherwise(F.date_sub(F.last_day(s), 1)))
        .when(f == "monthly", F.last_day(s))
        .when(f == "quaterly", F.date_sub(F.add_months(s, 3), 1))
        .when(f == "semi", F.date_sub(F.add_months(s, 6), 1))
        .when(f == "annual", F.date_sub(F.add_months(s, 12), 1))
    )
