"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a conversation are
rendered and consecutive outputs compared: what a prefix adds is its last turn's span; an output that does not start with
the one before shows a template that rewrites history, and spans are then null.

Rendering every prefix costs the square of a conversation's length. A template may declare (by an attribute ``local``) that
what a turn adds depends on so many turns before it only; then these are rendered with and without the turn, at every
length, and the pieces are held against a rendering of the whole. Where they differ, the declaration was wrong, and every
prefix is rendered after all. ``marked`` declares nothing; ``marked_local`` is the same template for conversations of very
many turns, as it writes each turn by itself.

Turns are sorted by (turn, role, text), nulls first; a null role or text counts as empty. Repeated rows are turns of their
own. Rows with a null conv_id are one conversation. Conversations are streamed from sorted partitions, one at a time; one with
very long texts is held whole by its task. An empty table gives no rows. Columns besides conv_id, turn, role and text are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Every ``<``, backslashes, ``|`` gets one more backslash: control strings can't be in the result."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """A role is one line: backslashes double and line feeds become a backslash and n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked(turns: Turns) -> str:
    """The default template: each turn between marks, its role on the first line."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def marked_local(turns: Turns) -> str:
    """``marked``, with the declaration that what a turn adds depends on no turn before it."""
    return marked(turns)


marked_local.local = 0


def parse_marked(output: str) -> Turns:
    """The turns of ``marked``'s output."""
    found = []
    for part in output.split(START)[1:]:
        role, _, rest = part.partition("\n")
        found.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return found


def spans(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int]] | None]:
    """The whole rendering and each turn's [start, end) in it; None if the template rewrites history."""
    before, found = template([]), []
    local = getattr(template, "local", None)
    if local is not None:
        pieces, at = [before], len(before)
        for k in range(len(turns)):
            near = turns[max(0, k - local) : k + 1]
            without, more = template(near[:-1]), template(near)
            if not more.startswith(without):
                break
            pieces.append(more[len(without) :])
            found.append((at, at + len(pieces[-1])))
            at = found[-1][1]
        else:
            if (output := template(turns)) == "".join(pieces):
                return output, found
        found = []
    for k in range(1, len(turns) + 1):
        output = template(turns[:k])
        if not output.startswith(before):
            return template(turns), None
        found.append((len(before), len(output)))
        before = output
    return before, found


def formatted(conversations: DataFrame, template: Template = marked, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, output, spans, trained, stable): each conversation's rendering, its turns' spans (null where prefixes do not stay
    as they were, and ``stable`` is false), and which turns are under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        out, held = [], 0
        for conv, group in groupby(rows, key=lambda r: r[0]):
            turns = [(role, text) for _, role, text in group]
            output, where = spans(turns, template)
            out.append((conv, output, None if where is None else [list(x) for x in where], [role in trained for role, _ in turns], where is not None))
            held += len(output)
            if held > 4_000_000:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, output string, spans array<array<long>>, trained array<boolean>, stable boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.bool_()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "output", "spans", "trained", "stable"])


def digests(rendered: DataFrame) -> DataFrame:
    """What ``marked``'s output holds, read back from it; the loss mask is the trained turns' texts inside their spans. Without
    spans there are only the conv_id and the output's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                output, every, loss, size, n = row["output"], hashlib.sha256(), hashlib.sha256(), 0, 0
                if row["spans"] is None:
                    found.append((row["conv_id"], None, None, None, None, len(output)))
                    continue
                for (a, b), learn in zip(row["spans"], row["trained"], strict=True):
                    for role, text in parse_marked(output[a:b]):
                        n += 1
                        every.update(f"{role}\n{text}\n".encode())
                        if learn:
                            size += len(text)
                            loss.update(text.encode())
                found.append((row["conv_id"], n, every.hexdigest(), size, loss.hexdigest(), len(output)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*found, strict=True) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
