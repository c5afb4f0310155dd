"""Numbers: parsing scraped text, exact rounding, number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill import fixed_values as fv


def parse_rank_power(text: Column, data_type: str = "bigint") -> Column:
    """`1,234위` -> 1234; null where the rest is not a whole number."""
    bare = F.regexp_replace(text, f"[,{fv.RANK_SUFFIX}]", "")
    return bare.try_cast(data_type)


def parse_change_digits(text: Column) -> Column:
    """First run of digits, so `1,234` reads as 1; `-`, `new` and no digits read as 0."""
    digits = F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")
    return F.when(text.isin("-", "new"), F.lit(0)).otherwise(F.coalesce(digits, F.lit(0)))


def parse_change_plain(text: Column) -> Column:
    """`-` is 0, separators go, anything else must be a whole number (`new` gives null)."""
    return F.when(text == "-", F.lit(0)).otherwise(F.regexp_replace(text, ",", "").try_cast("int"))


def parse_change_isdigit(text: Column, change_type: Column) -> Column:
    """Digits only count when up or down; anything else is 0."""
    digits = F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    return F.when(change_type == "up", digits).when(change_type == "down", -digits).otherwise(F.lit(0))


def signed_change(amount: Column, change_type: Column, mode: str = "service") -> Column:
    """Negative for `down`. Otherwise unchanged (`service`) or made positive (`batch`)."""
    if mode == "service":
        return F.when(change_type == "down", -F.abs(amount)).otherwise(amount)
    return F.when(change_type == "down", -amount).otherwise(F.abs(amount))


def normalize_change(text: Column) -> Column:
    """A change given as text -> int; `new` in any case and `-` are 0."""
    return parse_change_digits(F.lower(text))


def normalize_change_type(change_type: Column) -> Column:
    return F.coalesce(change_type, F.lit("none"))


def divide_half_even(numerator: Column, denominator: Column) -> Column:
    """numerator/denominator rounded half-even to a whole number, without floating point.

    Works on decimals so that population x total cannot overflow; null when
    the denominator is 0.
    """
    top = numerator.cast("decimal(38,0)")
    bottom = F.when(denominator != 0, denominator).cast("decimal(19,0)")
    whole = F.call_function("div", top, bottom)
    rest = top % bottom
    up = (rest * 2 > bottom) | ((rest * 2 == bottom) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def percent_half_even(part: Column, total: Column) -> Column:
    """part/total in percent with two digits, exact half-even."""
    hundredths = divide_half_even(part.cast("decimal(19,0)") * 10000, total)
    return hundredths / F.lit(100.0)


def rescale_half_even(part: Column, part_sum: Column, total: Column) -> Column:
    """part's share of part_sum applied to total, whole persons half-even."""
    product = part.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    return divide_half_even(product, part_sum)


def thousands(value: Column, suffix: str = "") -> Column:
    """`1,234` with an optional suffix."""
    text = F.format_number(value, 0)
    return F.concat(text, F.lit(suffix)) if suffix else text


def abbrev_km(value: Column) -> Column:
    """1,500,000 -> `1.5M`, 12,345 -> `12K`, below 1000 the number itself."""
    tenths = divide_half_even(value, F.lit(100_000))
    millions = F.concat_ws(
        ".", F.call_function("div", tenths, F.lit(10)).cast("string"), (tenths % 10).cast("string")
    )
    kilo = divide_half_even(value, F.lit(1000)).cast("string")
    return (
        F.when(value >= 1_000_000, F.concat(millions, F.lit("M")))
        .when(value >= 1000, F.concat(kilo, F.lit("K")))
        .otherwise(value.cast("string"))
    )


def total_pages(count: Column, per_page: int = fv.ROWS_PER_PAGE) -> Column:
    return F.floor((count + (per_page - 1)) / per_page)


def positive_or_null(value: Column) -> Column:
    return F.when(value > 0, value)
