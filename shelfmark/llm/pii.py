"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (their shape, length, digits, checksums, and the words around them) and which type
follows which, and a dynamic program over segments of at most ``LONGEST`` tokens jointly picks boundaries and types. Segments
with a digit or an at-sign can be entities, and so can those without, where a word such as "password" and a colon or equals
sign stand before; the program runs over the tokens near these, and text far from all of them is outside. The field is
trained once on the driver by the likelihood's gradient, over a fixed number of generated lines, and its few thousand
weights go to the tasks in the closure. ``train`` takes any other annotated lines.

Base spans always stay; a segment of the field counts where it overlaps none of them. Null and empty texts have no spans, and
an empty table gives no rows. Texts of any length are searched whole; repeated rows are treated alike, and other columns are
kept or left out, whatever their names.
Base patterns are matched in time linear in the text, however long its runs are. Offsets are code points, ends exclusive;
bytes that are no UTF-8 count as one character each run that a decoder replaces, and redaction leaves them as they are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import small_batches, texts

#: ``id``: account and social security numbers. Only the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "secret", "id"]
BASE = KINDS[:4]
LONGEST, NEAR = 12, 4
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words before a secret.
HINTS = frozenset(["token", "key", "secret", "password", "passwd", "pwd", "bearer", "apikey", "auth", "credential"])
_HOT = re.compile("[0-9@]")
_TRIGGER = re.compile("[0-9@]|(?<![^\\W_])(?i:" + "|".join(sorted(HINTS)) + ")(?![^\\W_])")
_TOKEN = re.compile(r"[^\W_]+|\S")


def trigger(text: str) -> re.Pattern:
    """What entities can be near in this text: the full pattern only where one of the words is somewhere in it, in any case."""
    folded = text.casefold()
    return _TRIGGER if any(h in folded for h in HINTS) else _HOT


def emails(text: str) -> Iterator[Span]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    found += (("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split("."))))
    found += (("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d))
    if "+" in text:
        found += (("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15)
    return found


# The field


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens within NEAR tokens of one with a digit or an at-sign."""
    pattern = trigger(text)
    lines_at, done = [m.start() for m in pattern.finditer(text)], 0
    k = 0
    while k < len(lines_at):
        # Text around a trigger, widened while other triggers are near.
        start = max(done, lines_at[k] - 80)
        end = lines_at[k] + 80
        while k + 1 < len(lines_at) and lines_at[k + 1] <= end:
            k += 1
            end = lines_at[k] + 80
        k += 1
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        end = min(end, len(text))
        done = end
        tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        hot = [i for i, (a, b) in enumerate(tokens) if pattern.search(text, a, b)]
        run: list[tuple[int, int]] = []
        last = -1
        for i in hot:
            low = max(last + 1, i - NEAR)
            if run and low > last + 1:
                yield run
                run = []
            high = min(len(tokens) - 1, i + NEAR)
            run += tokens[low : high + 1] if low > last else tokens[last + 1 : high + 1]
            last = max(last, high)
        if run:
            yield run


def shape(text: str) -> str:
    """Runs of letters, digits and mixed letters and digits as one sign each; spaces and punctuation as they are."""
    out = re.sub(r"[^\W_]+", lambda m: "9" if m[0].isdigit() else "a" if m[0].isalpha() else "x", text)
    return re.sub(r"\s+", " ", out)


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
    """(first token, last token, features) of every segment that may be an entity."""
    words = [text[a:b] for a, b in tokens]
    hot = [bool(_HOT.search(w)) for w in words]
    solid = [w[0].isalnum() for w in words]
    for i in range(len(tokens)):
        if not (solid[i] or words[i] in "+("):
            continue
        before = words[max(0, i - 4) : i]
        asked = any(w.lower() in HINTS for w in before) and ("=" in before or ":" in before)
        warm = False
        for j in range(i, min(i + LONGEST, len(tokens))):
            gap = tokens[j][0] - tokens[j - 1][1] if j > i else 0
            if gap > 1:
                break
            asked = asked and not gap
            warm = warm or hot[j]
            if (warm or asked) and solid[j]:
                yield i, j, segment_features(text[tokens[i][0] : tokens[j][1]], before, words[j + 1 : j + 2], tokens, i, j)


def iban(s: str) -> bool:
    """Whether an account number's check digits are right."""
    s = s.replace(" ", "").upper()
    if not (15 <= len(s) <= 34 and s.isascii() and s.isalnum() and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def segment_features(s: str, before: list[str], after: list[str], tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    digits = digits_of(s)
    plain = s.isalnum()
    hexadecimal = plain and all(c in "0123456789abcdefABCDEF" for c in s)
    apart = i == 0 or tokens[i - 1][1] < tokens[i][0]
    hint = "yes" if any(w.lower() in HINTS for w in before) else "no"
    given = "=" in before or ":" in before
    mixed_case = s.lower() != s and s.upper() != s and not s.istitle()
    return [
        "shape=" + shape(s)[:24],
        f"digits={min(len(digits), 20)}",
        f"length={min(len(s), 40) // 4}",
        f"at={s.count('@')}",
        f"plus={s[0] == '+'}",
        f"card={plain and 16 <= len(digits) <= 19 and len(digits) == len(s) and luhn(digits)}",
        f"ip={s.count('.') == 3 and all(x.isascii() and x.isdigit() and small(x) for x in s.split('.'))}",
        f"hex={hexadecimal and len(digits) < len(s)}:{min(len(s), 40) // 8}",
        f"letters={s.isalpha()}:{mixed_case}:{min(len(s), 24) // 4}",
        f"iban={iban(s)}",
        f"apart={apart}",
        "before=" + "".join(before[-1:]).lower()[:12],
        f"hint={hint}:{given}",
        "after=" + ("".join(after) if after and not after[0].isalnum() else "word" if after else "end"),
    ]


#: Weights by (kind, feature), and by ("", "kind>kind") for a type after another; "" is outside.
Weights = dict[tuple[str, str], float]
LABELS = ["", *KINDS]


def score(w: Weights, kind: str, feats: list[str]) -> float:
    return w.get((kind, "bias"), 0.0) + sum(w.get((kind, f), 0.0) for f in feats)


class Scores:
    """Weights by feature: one look-up gives a feature's weights for every kind."""

    def __init__(self, w: Weights):
        self.move = moves(w)
        self.bias = [w.get((k, "bias"), 0.0) for k in KINDS]
        self.rows = {f: tuple(w.get((k, f), 0.0) for k in KINDS) for kind, f in w if kind and f != "bias"}

    def of(self, feats: list[str]) -> list[float]:
        """What ``score`` gives for each kind."""
        rows = self.rows
        known = [rows[f] for f in feats if f in rows]
        return [b + sum(c) for b, c in zip(self.bias, zip(*known, strict=True), strict=True)] if known else self.bias


_SCORES: list[tuple[Weights, Scores]] = []


def scores(w: Weights) -> Scores:
    """The weights by feature, made once for weights that are used again and again."""
    if not _SCORES or _SCORES[0][0] is not w:
        _SCORES[:] = [(w, Scores(w))]
    return _SCORES[0][1]


def moves(w: Weights) -> list[list[float]]:
    """What each label (a row) adds before each other."""
    return [[w.get(("", f"{a}>{b}"), 0.0) for b in LABELS] for a in LABELS]


def decode(text: str, tokens: list[tuple[int, int]], w: Weights) -> list[Span]:
    """The best segmentation's entities. Segments come by their first token, where the best scores of what lies before are
    final, so nothing is kept of them but each end's best of every label."""
    every = scores(w)
    n, m, move = len(tokens), len(LABELS), every.move
    best = [[-math.inf] * m for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * m for _ in range(n + 1)]
    best[0][0] = 0.0
    enter: list[tuple[float, int]] = []
    at = -1

    def reach(upto: int) -> None:
        """Make ``upto`` the first token: close those before it as outside, and find what each label has before it."""
        nonlocal at, enter
        while at < upto:
            at += 1
            enter = [max((best[at][a] + move[a][b], a) for a in range(m)) for b in range(m)]
            if at < n and enter[0][0] > best[at + 1][0]:
                best[at + 1][0], back[at + 1][0] = enter[0][0], (at, enter[0][1])

    for i, j, feats in candidates(text, tokens):
        reach(i)
        for k, own in enumerate(every.of(feats), 1):
            s = enter[k][0] + own
            if s > best[j + 1][k]:
                best[j + 1][k], back[j + 1][k] = s, (i, enter[k][1])
    reach(n)
    found, j, k = [], n, max(range(m), key=lambda k: best[n][k])
    while j:
        i, before = back[j][k]
        if k:
            found.append((LABELS[k], tokens[i][0], tokens[j - 1][1]))
        j, k = i, before
    return found[::-1]


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def gradient(text: str, tokens: list[tuple[int, int]], gold: set[Span], w: Weights, step: float) -> None:
    """One likelihood step: what the annotated segmentation has goes up, what is expected of all goes down."""
    n, m, move = len(tokens), len(LABELS), moves(w)
    parts = [[(i, i, 0, 0.0, [])] for i in range(n)]  # by first token: last token, label, score, features
    for i, j, feats in candidates(text, tokens):
        parts[i] += ((i, j, k, score(w, kind, feats), feats) for k, kind in enumerate(KINDS, 1))
    into: list[list[list[float]]] = [[[] for _ in range(m)] for _ in range(n + 1)]
    into[0][0].append(0.0)
    enter = []
    ahead = []
    for i in range(n + 1):
        ahead.append([_log_sum(x) if x else -math.inf for x in into[i]])
        enter.append([_log_sum([ahead[i][a] + move[a][b] for a in range(m)]) for b in range(m)])
        for _, j, k, s, _ in parts[i] if i < n else ():
            into[j + 1][k].append(enter[i][k] + s)
    total = _log_sum(ahead[n])
    behind = [[-math.inf] * m for _ in range(n)] + [[0.0] * m]
    change: Weights = defaultdict(float)
    for i in range(n - 1, -1, -1):
        out: list[list[float]] = [[] for _ in range(m)]
        for _, j, k, s, feats in parts[i]:
            out[k].append(s + behind[j + 1][k])
            if k:
                right = (LABELS[k], tokens[i][0], tokens[j][1]) in gold
                gap = right - math.exp(min(0.0, enter[i][k] + s + behind[j + 1][k] - total))
                if abs(gap) > 1e-5:
                    for f in ("bias", *feats):
                        change[LABELS[k], f] += gap
        leave = [_log_sum(x) if x else -math.inf for x in out]
        behind[i] = [_log_sum([move[a][b] + leave[b] for b in range(m)]) for a in range(m)]
        for a in range(m):
            for b in range(m):
                expected = math.exp(min(0.0, ahead[i][a] + move[a][b] + leave[b] - total))
                if expected > 1e-5:
                    change["", f"{LABELS[a]}>{LABELS[b]}"] -= expected
    by_start = {(a, k): b for k, a, b in gold}
    at, before = 0, ""
    while at < n:
        found = next(((k, by_start[tokens[at][0], k]) for k in KINDS if (tokens[at][0], k) in by_start), None)
        label = found[0] if found else ""
        change["", f"{before}>{label}"] += 1
        end = found[1] if found else tokens[at][1]
        at += 1
        while at < n and tokens[at][1] <= end:
            at += 1
        before = label
    for key, x in change.items():
        w[key] = w.get(key, 0.0) + step * x


def examples(count: int, seed: int = 11) -> Iterator[tuple[str, set[Span]]]:
    """Generated lines: words, numbers that are nothing, and entities, with the entities' spans."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnorstuvé") for _ in range(r.randint(1, 9)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def card() -> str:
        body = r.choice("3456") + number(r.randint(14, 17))
        return next(body + d for d in "0123456789" if luhn(body + d))

    def account() -> str:
        country, body = r.choice(letters[26:]) + r.choice(letters[26:]), number(r.choice([11, 14, 16, 18]))
        check = next(f"{c:02}" for c in range(2, 99) if iban(f"{country}{c:02}{body}"))
        whole = country + check + body
        return r.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    def secret() -> str:
        return r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64]))), "".join(r.choice(letters) for _ in range(r.randint(10, 24))), "".join(r.choice(letters + "0123456789") for _ in range(r.randint(12, 40)))])

    makers = {
        "email": lambda: f"{word().replace('é', 'e')}.{number(2)}@{word().replace('é', 'e')}{r.choice(['', number(1)])}.{r.choice(['example.com', 'org', 'net'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(3)} {number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}"]),
        "secret": secret,
        "id": lambda: r.choice([f"{number(3)}-{number(2)}-{number(4)}", account(), account()]),
        "": lambda: r.choice([number(r.randint(1, 8)), f"version {r.randint(1, 9)}.{r.randint(0, 20)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-{number(2)}-{number(2)}", f"{word()}{number(2)}", f"{number(2)}:{number(2)}", f"{number(3)},{number(3)}", number(16)[:15] + word(), f"{number(1)},{number(3)},{number(3)}", "@" + word(), f"the {r.choice(sorted(HINTS))} {word()}", f"{r.choice(sorted(HINTS))}: {word()[:6]} {word()}"]),
    }
    for _ in range(count):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 6))) + " "
            kind = r.choice([*KINDS, "", "", ""])
            value = makers[kind]()
            wrap = ("", "")
            if kind == "secret":
                wrap = r.choice([('token = "', '"'), ("api_key: ", ""), ("secret=", ""), ('"password": "', '"'), ("password: ", "")])
            elif r.random() < 0.2:
                wrap = r.choice([("(", ")"), ('"', '"'), ("", "###"), ("", ".")])
            text += wrap[0]
            if kind:
                gold.add((kind, len(text), len(text) + len(value)))
            text += value + wrap[1] + " "
        yield text + word(), gold


def train(lines: Iterator[tuple[str, set[Span]]], epochs: int = 4) -> Weights:
    w: Weights = {(k, "bias"): -2.0 for k in KINDS}
    data = [(t, tokens, gold) for t, gold in lines for tokens in islands(t)]
    for epoch in range(epochs):
        for t, tokens, gold in data:
            gradient(t, tokens, gold, w, 0.3 / (1 + epoch))
    return {k: round(v, 6) for k, v in w.items() if abs(v) > 0.02}


_MODEL: list[Weights] = []


def model(lines: int = 500) -> Weights:
    """The default weights, trained once in a process."""
    if not _MODEL:
        _MODEL.append(train(examples(lines)))
    return _MODEL[0]


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's, both by kind and start."""
    if not trigger(text).search(text):
        return [], []
    base = base_spans(text)
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):  # merged, so that ends rise too
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for tokens in islands(text):
        for kind, a, b in decode(text, tokens, w):
            before = bisect_left(starts, b)  # intervals that start before the segment's end
            if before == 0 or ends[before - 1] <= a:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, w: Weights | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every document."""
    weights = w or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1):
                base, every = all_spans(data.as_py().decode("utf-8", "replace"), weights)
                out.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, w: Weights | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans become one, named by
    the first. A column n_chars, where there is one, follows the text. Null texts stay null."""
    weights = w or model()

    def clean(text: str) -> str:
        parts, at = [], 0
        for kind, a, b in sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join(parts) + text[at:] if parts else text

    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                columns, kind = batch.columns, batch.column(at).type
                # As bytes, since a string column may hold what is no UTF-8.
                text = [None if x is None else clean(x.decode("utf-8", "surrogateescape")) for x in columns[at].cast(pa.binary()).to_pylist()]
                columns[at] = pa.array([None if t is None else t.encode("utf-8", "surrogateescape") for t in text], pa.binary()).cast(pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).view(kind)
                if size is not None:
                    kept = columns[size].to_pylist()
                    columns[size] = pa.array([n if t is None else len(t) for t, n in zip(text, kept, strict=True)], columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)
