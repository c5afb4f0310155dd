"""Text: labels, extraction, keys, JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill import fixed_values as fv


def lookup(values: Mapping, key: Column, default=None) -> Column:
    """Keyed lookup in a fixed code list, with a default for unknown and null keys."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def change_type_of(css_classes: Column, mode: str = "service") -> Column:
    """up/down/none from a class attribute; `batch` knows only up and else down."""
    names = F.split(F.coalesce(css_classes, F.lit("")), r"\s+")
    up = F.array_contains(names, "up")
    if mode == "batch":
        return F.when(up, "up").otherwise("down")
    return F.when(up, "up").when(F.array_contains(names, "down"), "down").otherwise("none")


def clean_text(text: Column) -> Column:
    """Strip blanks, tabs and line ends on both sides."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ellipsize(text: Column, limit: int = 18, keep: int = 15) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def left_n(text: Column, n: int = 100) -> Column:
    return F.substring(text, 1, n)


RANK_RANGE_PATTERN = r"([0-9,]+)위\s*~\s*([0-9,]+)위"


def rank_range(text: Column) -> Column:
    """`1위 ~ 20위` -> (lo, hi); both null when the text is no range."""

    def bound(group: int) -> Column:
        digits = F.regexp_extract(text, RANK_RANGE_PATTERN, group)
        return F.regexp_replace(digits, ",", "").try_cast("bigint")

    return F.struct(bound(1).alias("lo"), bound(2).alias("hi"))


def id_from_call(text: Column) -> Column:
    """Digits between `(` and `,` of a call text; null when there are none."""
    digits = F.regexp_extract(text, r"\(([0-9]+),", 1)
    return F.when(digits != "", digits)


def absolute_url(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def compose_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[part.cast("string") for part in parts])


def blank_cells(html: Column) -> Column:
    return F.replace(html, F.lit("<td></td>"), F.lit("<td>&nbsp;</td>"))


def json_roundtrip(text: Column) -> Column:
    """Parsed and written again in one normal form; text that is not JSON comes back as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def json_path_default(text: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def status_symbol(status: Column) -> Column:
    return lookup(fv.STATUS_SYMBOLS, status, fv.UNKNOWN_STATUS_SYMBOL)


def ordered_fingerprint(titles: Column) -> Column:
    """md5 of an array of titles in their order, empty titles dropped."""
    return F.md5(F.array_join(F.filter(titles, lambda t: t != ""), "|"))
