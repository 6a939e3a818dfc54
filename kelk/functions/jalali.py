"""The Jalali (solar Hijri) calendar as plain column arithmetic: no Python per row, no lookup table.

A year y is a leap year if y mod 33 is one of LEAP_REMAINDERS. Days are counted from 1400/01/01 (day 0, a Sunday).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kelk.functions.text import ascii_digits, plain_letters

#: Fixed values of the 33-year leap cycle.
LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)
MIN_YEAR, MAX_YEAR = 1200, 1600
EPOCH_YEAR = 1400
MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


CYCLE_YEARS = 33
CYCLE_DAYS = CYCLE_YEARS * 365 + len(LEAP_REMAINDERS)
#: Days from the start of a cycle to the start of each of its years.
_STARTS = [y * 365 + sum(r < y for r in LEAP_REMAINDERS) for y in range(CYCLE_YEARS)]
_EPOCH = EPOCH_YEAR // CYCLE_YEARS * CYCLE_DAYS + _STARTS[EPOCH_YEAR % CYCLE_YEARS]


def is_leap(year: Column) -> Column:
    return F.pmod(year, F.lit(CYCLE_YEARS)).isin(*LEAP_REMAINDERS)


def month_length(year: Column, month: Column) -> Column:
    return F.when(month <= 6, 31).when(month <= 11, 30).otherwise(F.when(is_leap(year), 30).otherwise(29))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """True or false, never null."""
    ok = year.between(MIN_YEAR, MAX_YEAR) & month.between(1, 12) & (day >= 1) & (day <= month_length(year, month))
    return F.coalesce(ok, F.lit(False))


def day_index(year: Column, month: Column, day: Column) -> Column:
    """Days since 1400/01/01, negative before it."""
    start = F.element_at(F.lit(_STARTS), F.pmod(year, F.lit(CYCLE_YEARS)).cast("int") + 1)
    months = F.when(month <= 7, (month - 1) * 31).otherwise(186 + (month - 7) * 30)
    return (F.floor(year / F.lit(CYCLE_YEARS)) * CYCLE_DAYS + start + months + day - 1 - _EPOCH).cast("bigint")


def weekday(day: Column) -> Column:
    """Name of the weekday of a day index."""
    return F.when(day.isNotNull(), F.element_at(F.lit(list(WEEKDAYS)), (F.pmod(F.lit(6) + day, F.lit(7)) + 1).cast("int")))


_NUMERIC = r"(?<![0-9])([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})(?![0-9])"
_NAMED = r"(?<![0-9])([0-9]{1,2})\s*(" + "|".join(MONTHS) + r")\s*([0-9]{4})(?![0-9])"
_CLOCK = r"(?<![0-9:])([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?(?![0-9:])"


def with_date(df: DataFrame, source: str, prefix: str, need_time: bool = True) -> DataFrame:
    """df with {prefix}year, month, day, hour, minute and {prefix}day_index of the date in the column source.

    Known spellings: Y/M/D or Y-M-D with the time after or before it, and 'D month-name Y'; any digits; blanks, commas,
    dashes or the word for 'hour' between the parts; seconds are dropped. All six are null if there is no date, or one that
    does not exist (month 13, 30 Esfand of a common year). With need_time that also holds for a missing time of day,
    otherwise it counts as 00:00. The steps are projections of their own, so that each pattern runs once a row.
    """
    text, y, m, d, h, i = (f"{prefix}{x}" for x in ("text", "year", "month", "day", "hour", "minute"))
    out = barrier(df, {text: plain_letters(ascii_digits(F.col(source)))})
    whole = lambda pattern, group: F.regexp_extract(text, pattern, group).try_cast("int")
    by_name = F.array_position(F.lit(list(MONTHS)), F.regexp_extract(text, _NAMED, 2)).cast("int")
    clock = {h: whole(_CLOCK, 1), i: whole(_CLOCK, 2)}
    if not need_time:
        clock = {c: F.when(F.col(text).contains(":"), x).otherwise(0) for c, x in clock.items()}
    date = {y: F.coalesce(whole(_NUMERIC, 1), whole(_NAMED, 3)), m: F.coalesce(whole(_NUMERIC, 2), by_name), d: F.coalesce(whole(_NUMERIC, 3), whole(_NAMED, 1))}
    out = barrier(out, date | clock).drop(text)
    out = barrier(out, {"_ok": valid_date(F.col(y), F.col(m), F.col(d)) & F.coalesce(F.col(h).between(0, 23) & F.col(i).between(0, 59), F.lit(False))})
    out = out.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in (y, m, d, h, i)} | {f"{prefix}day_index": F.when(F.col("_ok"), day_index(F.col(y), F.col(m), F.col(d)))})
    return out.drop("_ok")


def barrier(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns computed once a row: a projection would be merged with the next and repeat them at each use."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))).alias("_b")).select(*kept, "_b.*")


def minutes(prefix: str) -> Column:
    """Minutes since 1400/01/01 00:00 of what with_date found."""
    return F.col(f"{prefix}day_index") * 1440 + F.col(f"{prefix}hour") * 60 + F.col(f"{prefix}minute")


def with_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of minutes since 1400/01/01 00:00 as YYYY/MM/DD HH:MM in ASCII digits; columns maps new names to their sources."""
    for name, source in columns.items():
        value, rest = F.col(source), F.pmod(F.col(source), F.lit(1440))
        day = F.floor(value / F.lit(1440)) + _EPOCH
        df = barrier(df, {"_day": day, "_in": F.pmod(day, F.lit(CYCLE_DAYS)).cast("int")})
        df = barrier(df, {"_y": F.expr(f"size(filter(array({','.join(map(str, _STARTS))}), x -> x <= _in)) - 1")})
        df = barrier(df, {"_d": F.col("_in") - F.element_at(F.lit(_STARTS), F.col("_y") + 1)})
        month = F.when(F.col("_d") < 186, F.floor(F.col("_d") / F.lit(31)) + 1).otherwise(F.floor((F.col("_d") - 186) / F.lit(30)) + 7)
        day = F.when(F.col("_d") < 186, F.pmod("_d", F.lit(31))).otherwise(F.pmod(F.col("_d") - 186, F.lit(30))) + 1
        year = F.floor(F.col("_day") / F.lit(CYCLE_DAYS)) * CYCLE_YEARS + F.col("_y")
        text = F.format_string("%04d/%02d/%02d %02d:%02d", year, month, day, F.floor(rest / F.lit(60)), F.pmod(rest, F.lit(60)))
        df = df.withColumn(name, F.when(value.isNotNull(), text)).drop("_day", "_in", "_y", "_d")
    return df
