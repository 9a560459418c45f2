"""Search queries: free text with ``key:value`` filters, turned into one predicate that Catalyst can push and order.

Parsing runs on the driver, as a query is a literal. A bad value is kept in ``rejected`` and filters nothing.
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.intent import aliases
from ..functions.names import extension

DAY = 86_400
MOST = (1 << 64) - 1
#: Size units, decimal and binary.
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}
#: Names of the kinds of rows.
TYPES = {"file": "file", "f": "file", "dir": "dir", "directory": "dir", "folder": "dir", "d": "dir", "hidden": "hidden", "system": "system"}


@dataclass
class Bounds:
    low: int | None = None
    high: int | None = None

    def narrow(self, low: int | None, high: int | None) -> None:
        """Repeated constraints intersect."""
        if low is not None:
            self.low = low if self.low is None else max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def any(self) -> bool:
        return self.low is not None or self.high is not None

    def test(self, value: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (value >= min(self.low, (1 << 63) - 1))
        if self.high is not None:
            out = out & (value <= min(self.high, (1 << 63) - 1))
        return out


@dataclass
class ParsedQuery:
    text: str = ""
    ext: str | None = None
    path: str | None = None
    kind: str | None = None
    app: str | None = None
    size: Bounds = field(default_factory=Bounds)
    date: Bounds = field(default_factory=Bounds)
    rejected: list[str] = field(default_factory=list)

    def needs_path(self) -> bool:
        return self.path is not None or self.app is not None

    def needs_attributes(self) -> bool:
        return self.size.any() or self.date.any()

    def filtered(self) -> bool:
        return self.needs_path() or self.needs_attributes() or self.ext is not None or self.kind is not None

    def predicate(self) -> Column:
        """Over name_norm, name, flags, and as needed path, attr_size and attr_modified; rows without attributes fail size
        and date filters."""
        tests = [F.lit(True)]
        if self.ext is not None:
            tests.append(F.coalesce(extension(F.col("name")) == self.ext, F.lit(False)))
        if self.kind is not None:
            bit = {"file": 1, "dir": 1, "hidden": 2, "system": 4}[self.kind]
            tests.append((F.col("flags").bitwiseAND(bit) != 0) == F.lit(self.kind != "file"))
        if self.path is not None:
            tests.append(F.contains(F.lower("path"), F.lit(self.path)))
        if self.app is not None:
            path, name = F.lower("path"), F.col("name_norm")
            fits = F.contains(path, F.lit(self.app)) | F.contains(name, F.lit(self.app))
            for alias in (aliases(self.app) or ("", []))[1]:
                fits = fits | (name == alias) | F.contains(path, F.lit(alias))
            tests.append(fits)
        if self.size.any():
            tests.append(F.col("attr_size").isNotNull() & self.size.test(F.col("attr_size")))
        if self.date.any():
            tests.append(F.col("attr_modified").isNotNull() & self.date.test(F.col("attr_modified")))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def words(query: str) -> list[str]:
    """Split at blanks; quotes group anywhere and vanish, an open one runs to the end."""
    found, current, quote = [], "", ""
    for c in query:
        if quote:
            if c == quote:
                quote = ""
            else:
                current += c
        elif c in "'\"":
            quote = c
        elif c.isspace():
            if current:
                found.append(current)
            current = ""
        else:
            current += c
    return found + [current] * bool(current)


def size_of(text: str) -> int | None:
    m = re.fullmatch(r"([0-9]*\.?[0-9]+|[0-9]+\.)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in UNITS:
        return None
    size = math.floor(float(m[1]) * UNITS[m[2]] + 0.5)
    return size if size <= MOST else None


def day_of(text: str) -> int | None:
    m = re.fullmatch(r"(-?[0-9]+)-([0-9]+)-([0-9]+)", text.strip())
    try:
        return (datetime.date(int(m[1]), int(m[2]), int(m[3])) - datetime.date(1970, 1, 1)).days * DAY if m else None
    except ValueError:
        return None


def size_bounds(value: str) -> tuple[int | None, int | None] | None:
    """``a..b`` (a side that can't be read is open), ``>=``, ``>``, ``<=``, ``<`` (never below 0) or one size."""
    if ".." in value:
        low, _, high = value.partition("..")
        return size_of(low), size_of(high)
    for sign, bounds in ((">=", lambda n: (n, None)), ("<=", lambda n: (None, n)), (">", lambda n: (min(n + 1, MOST), None)), ("<", lambda n: (None, max(n - 1, 0)))):
        if value.startswith(sign):
            n = size_of(value[len(sign) :])
            return None if n is None else bounds(n)
    n = size_of(value)
    return None if n is None else (n, n)


def date_bounds(value: str) -> tuple[int | None, int | None] | None:
    """Whole days in UTC: ``a..b`` inclusive, ``>`` from the next day, ``<=`` to the day's end, ``<`` to the day before."""
    end = DAY - 1
    if ".." in value:
        low, high = map(day_of, value.split("..", 1))
        return low, None if high is None else high + end
    for sign, bounds in ((">=", lambda d: (d, None)), ("<=", lambda d: (None, d + end)), (">", lambda d: (d + DAY, None)), ("<", lambda d: (None, d - 1))):
        if value.startswith(sign):
            d = day_of(value[len(sign) :])
            return None if d is None else bounds(d)
    d = day_of(value)
    return None if d is None else (d, d + end)


def parse(query: str) -> ParsedQuery:
    """Unknown keys are text; the last of repeated text filters wins, sizes and dates intersect."""
    out, free = ParsedQuery(), []
    for word in words(query):
        key, colon, value = word.partition(":")
        key = key.lower()
        good = True
        if not colon:
            free.append(word)
        elif key in ("ext", "extension"):
            value = value.strip().lstrip(".").lower()
            out.ext, good = (value, True) if value else (out.ext, False)
        elif key == "size":
            if good := (b := size_bounds(value)) is not None:
                out.size.narrow(*b)
        elif key in ("date", "modified", "mtime"):
            if good := (b := date_bounds(value)) is not None:
                out.date.narrow(*b)
        elif key in ("path", "in"):
            out.path, good = (value.lower(), True) if value else (out.path, False)
        elif key in ("type", "kind"):
            good = value.lower() in TYPES
            out.kind = TYPES[value.lower()] if good else out.kind
        elif key in ("app", "application"):
            out.app, good = (value.strip().lower(), True) if value.strip() else (out.app, False)
        else:
            free.append(word)
        if not good:
            out.rejected.append(word)
    out.text = " ".join(free)
    return out
