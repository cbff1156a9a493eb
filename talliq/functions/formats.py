"""Formatters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, ties as the binary value falls, without thousands separators."""
    return F.replace(F.format_number(x.cast("double"), places), F.lit(","), F.lit(""))


def _whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def shorten_home(path: Column, home: str) -> Column:
    """Replaces the home folder at the start by ~; a plain prefix, so siblings whose names go on count too."""
    if not home:
        return path
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def thousands(n: Column) -> Column:
    """Groups of three digits parted by spaces."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def usd(x: Column) -> Column:
    """$0.00, four decimals below a cent, otherwise two; no thousands separator."""
    return (
        F.when(x == 0, F.lit("$0.00"))
        .when(F.abs(x) < 0.01, F.concat(F.lit("$"), fixed(x, 4)))
        .otherwise(F.concat(F.lit("$"), fixed(x, 2)))
    )


def bytes_human(n: Column) -> Column:
    """Megabytes with one decimal from 1 MB on, otherwise whole kilobytes."""
    whole = F.call_function("div", n.cast("long"), F.lit(1024).cast("long")).cast("string")
    return F.when(n >= 1 << 20, F.concat(fixed(n / F.lit(float(1 << 20)), 1), F.lit(" MB"))).otherwise(F.concat(whole, F.lit(" kB")))


def csv_field(text: Column) -> Column:
    """Quoted if it has a comma or a quote; quotes are doubled. A line break alone doesn't quote."""
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.contains(",") | text.contains('"'), doubled).otherwise(text)


def token_count(n: Column) -> Column:
    """1.2k, 12k, 250k, 1.0M, 15M, 383M."""
    k = n.cast("double") / 1000
    m = k / 1000
    return (
        F.when(m >= 100, F.concat(_whole(F.round(m)), F.lit("M")))
        .when(m >= 10, F.concat(fixed(m, 0), F.lit("M")))
        .when(m >= 1, F.concat(fixed(m, 1), F.lit("M")))
        .when(k >= 100, F.concat(_whole(F.round(k)), F.lit("k")))
        .when(k >= 10, F.concat(fixed(k, 0), F.lit("k")))
        .otherwise(F.concat(fixed(k, 1), F.lit("k")))
    )


def short_cost(x: Column) -> Column:
    return F.when(x < 0.01, fixed(x, 3)).otherwise(fixed(x, 2))


def middle_cut(text: Column, most: int) -> Column:
    """At most so many characters, the middle given up for one ellipsis; the head gets the odd one."""
    tail = (most - 1) // 2
    head = most - 1 - tail
    cut = F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def abbreviated_path(path: Column, home: str) -> Column:
    """~ for home, and of each folder but the last its first character, two for those that begin with a dot."""
    parts = F.split(shorten_home(path, home), "/", -1)
    last = F.size(parts) - 1

    def one(part: Column, i: Column) -> Column:
        return (
            F.when((i == last) | (part == "~"), part)
            .when(part.startswith(".") & (F.length(part) > 1), F.substring(part, 1, 2))
            .otherwise(F.substring(part, 1, 1))
        )

    return F.array_join(F.transform(parts, one), "/")


def without_parenthesis(text: Column) -> Column:
    """Cut before the first parenthesis, and then without white space at the end."""
    return F.when(text.contains("("), F.regexp_replace(F.substring_index(text, "(", 1), r"(?U)\s+$", "")).otherwise(text)


def window_size(n: Column) -> Column:
    return (
        F.when((n >= 1_000_000) & (n % 1_000_000 == 0), F.concat(_whole(n / 1_000_000), F.lit("M")))
        .when(n >= 1000, F.concat(_whole(F.floor(n / 1000)), F.lit("k")))
        .otherwise(_whole(n))
    )


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; null if whole isn't positive."""
    return F.when(whole > 0, part / whole * 100)
