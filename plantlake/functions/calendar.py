"""Calendar buckets: an integer bucket number per timestamp and the label of each number."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# fixed values: seconds per unit of a plain step
STEP_SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400}
# fixed values: older spellings of the same rules
SPELLINGS = {"S": "s", "T": "min", "H": "h", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE", "W": "W-SUN", "AS": "YS"}
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
DAY = 86400
# rules whose buckets are named by their start; the others are named by their last day
STARTS = ("MS", "QS", "YS", "B")
# 1970-01-01 was a Thursday
EPOCH_WEEKDAY = 3


@dataclass(frozen=True)
class Rule:
    """``unit`` repeated ``n`` times."""

    n: int
    unit: str

    @property
    def plain(self) -> bool:
        return self.unit in STEP_SECONDS

    @property
    def seconds(self) -> int:
        return self.n * STEP_SECONDS[self.unit]

    @property
    def anchored(self) -> bool:
        """True when the buckets depend on where the series starts."""
        return DAY % self.seconds != 0 if self.plain else self.n > 1

    def unit_no(self, ts: Column) -> Column:
        """Whole units since the epoch: seconds for plain steps, working days / weeks / months / quarters / years else."""
        ts = ts.cast("timestamp")
        months = F.year(ts) * 12 + F.month(ts) - 1
        days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
        if self.plain:
            no = F.unix_seconds(ts)
        elif self.unit == "B":
            # a weekend belongs to the Friday before it
            since = days + EPOCH_WEEKDAY
            no = F.floor(since / 7) * 5 + F.least(F.pmod(since, F.lit(7)), F.lit(4))
        elif self.unit.startswith("W-"):
            no = F.floor((days - self._week_end + 6) / 7)
        elif self.unit in ("ME", "MS"):
            no = months
        elif self.unit in ("QE", "QS"):
            no = F.floor(months / 3)
        else:
            no = F.year(ts)
        return no.cast("long")

    @property
    def _week_end(self) -> int:
        """Day number of the first end of a week."""
        return WEEKDAYS.index(self.unit[2:]) - EPOCH_WEEKDAY

    def origin(self, first_unit: Column) -> Column:
        """Start of the numbering, from the first unit of the series: its first midnight, or itself."""
        return (F.floor(first_unit / DAY) * DAY).cast("long") if self.plain else first_unit

    def bucket(self, unit: Column, origin: Column) -> Column:
        if self.plain:
            return F.floor((unit - origin) / self.seconds).cast("long")
        if self.unit in STARTS:
            return F.floor((unit - origin) / self.n).cast("long")
        # end-labelled buckets close on the right: the first one ends with the first unit
        return F.ceil((unit - origin) / self.n).cast("long")

    def label(self, bucket: Column, origin: Column) -> Column:
        if self.plain:
            return F.timestamp_seconds(origin + bucket * self.seconds)
        unit = origin + bucket * self.n
        epoch = F.lit("1970-01-01").cast("date")
        if self.unit == "B":
            day = F.date_add(epoch, (F.floor(unit / 5) * 7 + F.pmod(unit, F.lit(5)) - EPOCH_WEEKDAY).cast("int"))
        elif self.unit.startswith("W-"):
            day = F.date_add(epoch, (unit * 7 + self._week_end).cast("int"))
        elif self.unit == "MS":
            day = _month_start(unit)
        elif self.unit == "QS":
            day = _month_start(unit * 3)
        elif self.unit == "YS":
            day = F.make_date(unit.cast("int"), F.lit(1), F.lit(1))
        elif self.unit == "ME":
            day = F.last_day(_month_start(unit))
        elif self.unit == "QE":
            day = F.last_day(_month_start(unit * 3 + 2))
        else:
            day = F.make_date(unit.cast("int"), F.lit(12), F.lit(31))
        return day.cast("timestamp")


def _month_start(months: Column) -> Column:
    return F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))


def parse_rule(rule: str) -> Rule:
    found = re.fullmatch(r"(\d*)([A-Za-z]+(?:-[A-Z]+)?)", rule.strip())
    unit = SPELLINGS.get(found.group(2), found.group(2)) if found else None
    if unit not in (*STEP_SECONDS, *STARTS, "ME", "QE", "YE", *[f"W-{d}" for d in WEEKDAYS]):
        raise ValueError(f"unsupported rule {rule!r}: use <n> with s, min, h, D, B, W, W-MON to W-SUN, M, MS, Q, QS, Y or YS")
    n = int(found.group(1) or 1)
    if n < 1:
        raise ValueError(f"unsupported rule {rule!r}: the count must be positive")
    return Rule(n, unit)


def month_label(ts: Column, pattern: str = "yyyy_MM") -> Column:
    return F.date_format(ts, pattern)


def date_range_start(text: Column) -> Column:
    """First day of a ``date_range`` text: a day, a month (``yyyyMM`` or ``yyyy_MM``) or ``A_to_B``."""
    return _range_part(F.element_at(F.split(text, "_to_"), 1), last=False)


def date_range_end(text: Column) -> Column:
    return _range_part(F.element_at(F.split(text, "_to_"), -1), last=True)


def _range_part(part: Column, last: bool) -> Column:
    digits = F.regexp_replace(part, "[-_]", "")
    month = F.try_to_date(F.concat(digits, F.lit("01")), "yyyyMMdd")
    return F.when(F.length(digits) == 6, F.last_day(month) if last else month).when(
        F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd")
    )


def period_start(as_of: Column) -> Column:
    """First midnight of the month before the one of ``as_of``."""
    return F.add_months(F.trunc(as_of.cast("date"), "month"), -1).cast("timestamp")
