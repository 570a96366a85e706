"""Numeric, null, ordering and whitespace rules shared by every operator.

The source system computes in IEEE doubles and rounds half toward plus
infinity; stored numerics round half away from zero.  Both modes are needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ECMAScript's \s sees it, as the inside of a Java character class.
WS = r"\s\x0B   -     　﻿"
WS_NOT_SPACE = WS.replace(r"\s", r"\t\n\f\r")
# ASCII word boundaries: Java's \b looks at Unicode letters.
WORD = "A-Za-z0-9_"
LEFT = f"(?<![{WORD}])"
RIGHT = f"(?![{WORD}])"
EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

# Trailing windows, in seconds.
WINDOW_SECONDS = {"1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(as_of) -> Column:
    """``as_of`` as a timestamp column; strings are UTC instants."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of).cast("timestamp")


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def ago(as_of, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(at(as_of)) - F.lit(int(seconds * 1_000_000)))


def js_round(x, digits: int = 0) -> Column:
    k = float(10**digits)
    return F.floor(col(x) * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(x)))


def nz(x) -> Column:
    """``x || 0``: null, NaN and zero all become zero."""
    x = col(x).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def let(x, body) -> Column:
    """``body(x)`` with ``x`` computed once.

    A long rule chain that mentions its input many times would otherwise copy
    the input expression into every branch.
    """
    return F.element_at(F.transform(F.array(col(x)), body), 1)


def ratio(num, den) -> Column:
    """Double division that yields null on a zero or null denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean(total, n) -> Column:
    """Mean from an exact (decimal or integer) sum, zero when there is nothing to average."""
    return F.coalesce(ratio(total, n), F.lit(0.0))


def js_trim(x) -> Column:
    return F.regexp_replace(col(x), f"^[{WS}]+|[{WS}]+$", "")


def squeeze(x) -> Column:
    """Collapse runs of whitespace and trim. Lone spaces, the usual case, are not matched at all."""
    return F.trim(F.regexp_replace(col(x), f"[{WS_NOT_SPACE}][{WS}]*| [{WS}]+", " "))


def exact(x, scale: int = 3, precision: int = 20) -> Column:
    """Fixed-point copy of a score so that sums do not depend on row order or partitioning."""
    return col(x).cast(f"decimal({precision},{scale})")
