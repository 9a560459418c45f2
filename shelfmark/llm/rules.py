"""Quality rules as a short-circuit cascade.

What each measurement costs (seconds a text) and which rules reject which share of the texts are estimated on a sample of
bounded size by one Spark job. The cascade is then put together greedily: of the rules left, the next is the one with most
rejections per cost among the texts that the rules before it keep, where measurements that these have made already cost
nothing more. A text's first rejection ends its cascade. A verdict is the conjunction of all rules, so the order changes the
work and never a result.

Empty and null texts have no words and fail the base rules. Repeated rows are each judged by themselves; an empty table
gives no rows. Texts of any length are read whole. Bytes that are no UTF-8 count like others; of them, those from 0x80 to 0xBF
are no characters.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_LETTERED = re.compile(rb"[^\x20\x09-\x0DA-Za-z\x80-\xff]*+[A-Za-z\x80-\xff][^\x20\x09-\x0D]*+")


class Text:
    """One text with what the rules measure, each made when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that neither continue a code point nor separate words."""
        return len(self.data.translate(None, SPACES + bytes(range(0x80, 0xC0))))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more."""
        ids: dict[bytes, int] = {}
        w = [ids.setdefault(x, len(ids)) for x in self.words]
        if len(ids) == len(w):
            return 0
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        count, end = 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                count += i + 3 - max(end, i)
                end = i + 3
        return count

    @cached_property
    def n_lettered(self) -> int:
        """Words with an ASCII letter or a byte beyond ASCII."""
        return len(_LETTERED.findall(self.data))

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip().startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(x.rstrip().endswith(ELLIPSES) for x in self.lines)

    @cached_property
    def most_common(self) -> int:
        """How often the most common word stands."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def shouting(self) -> tuple[int, int]:
        """ASCII capitals and ASCII letters."""
        capitals = len(self.data) - len(self.data.translate(None, bytes(range(65, 91))))
        return capitals, capitals + len(self.data) - len(self.data.translate(None, bytes(range(97, 123))))


#: Line starts that mark a list, and line ends that break off.
BULLETS, ELLIPSES = (b"-", b"*", "•".encode()), (b"...", "…".encode())


@dataclass(frozen=True)
class Rule:
    """``needs``: the measurements of Text that it asks for, each after those that it is made from."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...]


#: The base: together they are ``base_failed``.
BASE = [
    Rule("few_words", lambda t: t.n_words < 50, ("words", "n_words")),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, ("words", "n_words", "n_repeat_words")),
]
#: Rejections in whole numbers, so that any engine decides alike.
RULES = [
    Rule("symbols_per_word", lambda t: t.n_symbols * 100 > 10 * t.n_words, ("words", "n_words", "n_symbols")),
    Rule("duplicate_lines", lambda t: t.n_dup_lines * 100 > 40 * max(len(t.lines), 1), ("lines", "n_dup_lines")),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 12 * t.n_words, ("words", "n_words", "word_chars")),
    Rule("capitals", lambda t: 2 * t.shouting[0] > t.shouting[1], ("shouting",)),
    Rule("words_with_letters", lambda t: 100 * t.n_lettered < 60 * t.n_words, ("words", "n_words", "n_lettered")),
    Rule("bullet_lines", lambda t: 100 * t.n_bullets > 90 * max(len(t.lines), 1), ("lines", "n_bullets")),
    Rule("broken_lines", lambda t: 100 * t.n_ellipses > 30 * max(len(t.lines), 1), ("lines", "n_ellipses")),
    Rule("most_common_word", lambda t: 100 * t.most_common > 50 * t.n_words, ("words", "n_words", "most_common")),
]


def base_failed(t: Text) -> bool:
    return any(r.rejects(t) for r in BASE)


@dataclass(frozen=True)
class Cascade:
    rules: tuple[Rule, ...]

    def rejected_by(self, t: Text) -> str | None:
        """The first rule that rejects; later ones are not asked."""
        return next((r.name for r in self.rules if r.rejects(t)), None)


@dataclass(frozen=True)
class Measured:
    """Texts by which rules reject them (bit k for the k-th rule), and seconds for each measurement over all of them."""

    patterns: dict[int, int]
    seconds: dict[str, float]


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000) -> Measured:
    """Over about ``sample_rows`` rows, chosen by a hash. The driver gets a row for each pattern of rejections and one for each
    measurement."""
    steps = list(dict.fromkeys(x for r in rules for x in r.needs))

    def costs(batch: pa.RecordBatch):
        views = [Text(x) for x in batch.column(1).to_pylist()]
        found = []
        for x in steps:
            began = time.perf_counter()
            for v in views:
                getattr(v, x)
            found.append((x, None, 0, time.perf_counter() - began))
        found += ((None, k, n, 0.0) for k, n in Counter(sum(r.rejects(v) << k for k, r in enumerate(rules)) for v in views).items())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["step", "pattern", "n", "seconds"])

    share = max(1, docs.count() // sample_rows)
    sample = texts(docs).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    per_batch = map_arrow(sample, costs, "step string, pattern long, n long, seconds double")
    rows = per_batch.groupBy("step", "pattern").agg(*(F.sum(c).alias(c) for c in ("n", "seconds"))).collect()
    return Measured({r.pattern: r.n for r in rows if r.step is None}, {r.step: r.seconds for r in rows if r.step is not None})


def ordered(rules: list[Rule], measured: Measured) -> Cascade:
    """The greedy cascade; where nothing was measured, rules stand as they were given."""
    left, order, made = dict(measured.patterns), [], set()
    rest = list(range(len(rules)))
    while rest:
        remain = sum(left.values())

        def rate(k: int) -> float:
            rejected = sum(n for p, n in left.items() if p >> k & 1)  # noqa: B023
            return rejected / (1e-9 + sum(measured.seconds.get(x, 0.0) for x in rules[k].needs if x not in made) + 1e-7 * remain)  # noqa: B023

        best = max(rest, key=lambda k: (rate(k), -k))
        rest.remove(best)
        order.append(rules[best])
        made.update(rules[best].needs)
        left = {p: n for p, n in left.items() if not p >> best & 1}
    return Cascade(tuple(order))


def quality(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and rejected_by (null if kept). The counts are wanted of every
    text, so that only the rules beyond the base are a cascade here."""
    cascade = ordered(rules, measure(docs, rules, sample_rows))

    def judged(data: bytes) -> tuple:
        t = Text(data)
        counts = t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words
        failed = base_failed(t)
        by = "base" if failed else cascade.rejected_by(t)
        return *counts, failed, by is None, by

    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())]

    def run(batch: pa.RecordBatch):
        found = list(zip(*(judged(x.as_py()) for x in batch.column(1)), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, (_, k) in zip(found, kinds, strict=True))], ["doc_id", *(n for n, _ in kinds)])

    return map_arrow(texts(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all their columns and without a shuffle. No counts are asked for, so the
    base rules are part of the cascade."""
    every = [*BASE, *rules]
    cascade = ordered(every, measure(docs, every, sample_rows))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch):
        # As bytes, since a string column may hold what is no UTF-8.
        views = (Text(x.as_py() or b"") for x in batch.column(at).cast(pa.binary()))
        yield batch.filter(pa.array([cascade.rejected_by(t) is None for t in views], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
