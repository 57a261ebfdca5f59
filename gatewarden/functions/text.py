"""Column functions on texts, bytes and JSON."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import DIGITS, NEEDS, PLACEHOLDER, jvm, literal


def scan_and_replace(df: DataFrame, column: str, patterns, placeholder: str = PLACEHOLDER, when: Column | None = None, counts: str = "_n") -> DataFrame:
    """``column`` with each pattern replaced in turn, and the number of replacements in ``counts``.

    Each step is a column of its own: the next pattern reads what the one before has left.  Patterns of the rules
    themselves run once over a text, and only where it holds what every match needs; others, which may match
    nothing at all, are counted and replaced apart.
    """
    cur = F.col(column)
    df = df.select("*", F.lit(0).alias(counts)) if counts not in df.columns else df.withColumn(counts, F.lit(0))
    for p in patterns:
        j = jvm(p)
        if p in NEEDS:
            may = cur.rlike(DIGITS) if NEEDS[p] is None else cur.contains(NEEDS[p])
            df = df.select("*", F.when(may if when is None else when & may, F.split(cur, j, -1)).alias("_parts"))
            cut = F.size("_parts") > 1
            df = df.withColumns({counts: F.col(counts) + F.when(cut, F.size("_parts") - 1).otherwise(0), column: F.when(cut, F.array_join("_parts", placeholder)).otherwise(cur)}).drop("_parts")
            continue
        n = F.coalesce(F.regexp_count(cur, F.lit(j)), F.lit(0))
        new = F.regexp_replace(cur, j, literal(placeholder))
        if when is not None:
            n, new = F.when(when, n).otherwise(0), F.when(when, new).otherwise(cur)
        df = df.withColumns({counts: F.col(counts) + n, column: new})
    return df


def normalize_sse(text: Column) -> Column:
    """Payload lines of server-sent events: comments and blank lines go, ``data:`` loses prefix and one space."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"\s+\z", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~F.ltrim(x).startswith(":"))
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith("data:"), F.regexp_replace(x, "^data: ?", "")).otherwise(x)), "\n")


def line_of(text: Column, index: Column) -> Column:
    """1-based line of a 1-based character index."""
    return F.regexp_count(F.substring(text, F.lit(1), index - 1), F.lit("\n")) + 1


_LONE = re.compile("[\ud800-\udfff]")
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


def _number(x: float) -> str:
    """A number as the policies' runtime prints it: the shortest digits that read back, plain from 1e-6 up to 1e21."""
    if math.isinf(x) or math.isnan(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{point - 1:+d}"
    return "-" + out if x < 0 else out


def _string(s: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _entries(x: dict):
    """Entries in the runtime's order: whole numbers first, by value, then the other keys as they came."""
    index = sorted((k for k in x if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    return [(k, x[k]) for k in (*index, *(k for k in x if k not in set(index)))] if index else x.items()


def dump(x) -> str:
    """Compact JSON as the policies' runtime writes it; lone surrogates are escaped."""
    if isinstance(x, dict):
        return "{" + ",".join(_string(k) + ":" + dump(v) for k, v in _entries(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dump, x)) + "]"
    if isinstance(x, float):
        return _number(x)
    return _string(x) if isinstance(x, str) else json.dumps(x)


def _refuse(name: str):
    raise ValueError(name)


def compact(text: str | None) -> str | None:
    """Numbers are doubles there, and NaN is no JSON."""
    try:
        return None if text is None else dump(json.loads(text, parse_int=float, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


def canonical_json(c: Column) -> Column:
    """Compact JSON text, null where it does not parse; in Arrow batches, as key order must survive."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(compact)

    return run(c)
