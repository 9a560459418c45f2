import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import base, groups, near, rlz, substring_sa, windows

from . import cases


def sha(data):
    return hashlib.sha256(data).hexdigest()


def corpus(seed, count=60):
    """Texts that share pieces of all lengths around the limits, whole copies, edited copies, and runs of one byte."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    pool = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)]
    out = []
    for i in range(count):
        parts = [r.choice(pool) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 50))) for _ in range(r.randint(0, 6))]
        out.append(" ".join(parts))
        if i % 9 == 0 and i:
            out.append(r.choice(out))
        if i % 11 == 0:
            out.append("z" * r.randint(40, 130))
        if i % 5 == 0 and out[-1]:
            w = out[-1].split()
            w[r.randrange(len(w))] = "edit" if w else ""
            out.append(" ".join(w))
    return [*out, None, ""]


def bytes_left(rows):
    seen, out = {}, {}
    for d, t in sorted(rows):
        x, gone = (t or "").encode(), set()
        for i in range(len(x) - 49):
            if seen.setdefault(x[i : i + 50], d) < d:
                gone.update(range(i, i + 50))
        runs = sum(i - 1 not in gone for i in gone)
        out[d] = len(x), len(gone), runs, sha(bytes(b for i, b in enumerate(x) if i not in gone))
    return out


def words_left(rows):
    docs = {d: (t or "").encode().split() for d, t in rows}
    count = Counter(tuple(w[i : i + 35]) for w in docs.values() for i in range(len(w) - 34))
    out = {}
    for d, w in docs.items():
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out[d] = len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed, monkeypatch):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in substring_sa.deduplicated(docs).collect()} == bytes_left(rows)
    assert {r.doc_id: tuple(r)[1:] for r in rlz.deduplicated(docs).collect()} == words_left(rows)


def test_awkward_rows(spark):
    want = [(d, t) for d, t in cases.texts().items()]
    assert {r.doc_id: tuple(r)[1:] for r in substring_sa.deduplicated(cases.frame(spark)).collect()} == bytes_left(want)
    assert {r.doc_id: tuple(r)[1:] for r in rlz.deduplicated(cases.frame(spark)).collect()} == words_left(want)
    assert substring_sa.deduplicated(cases.empty(spark)).count() == 0 and rlz.deduplicated(cases.empty(spark)).count() == 0


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "p" * 60), (2, "a" + "p" * 60 + "b")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in substring_sa.deduplicated(docs, keep_text=True).collect()} == {1: b"p" * 60, 2: b"ab"}


@pytest.mark.parametrize("kind", [substring_sa.BYTES, rlz.WORDS])
def test_sampled_positions_lose_no_window(monkeypatch, kind):
    """Every window lies in exactly one context of its document, whole, at the offset that its own content decides."""
    monkeypatch.setattr(windows, "PIECE", 500)
    r = random.Random(1)
    data = bytes(r.choices(b"abc ", k=6000))
    data = data[:3000] + data[100:900] + data[3000:]
    tokens = kind.tokens(data)
    parts = [x for share in range(windows.PASSES) for x in windows.records(kind, np.array([7]), np.array([9]), [tokens], share)]
    keys, got = windows.gathered(kind, parts)
    rows = windows.as_rows(kind, keys)
    w, seen, offsets = kind.window, Counter(), {}
    right, left = windows.sides(kind, keys)
    for x, at, n, m in zip(rows, got["at"].tolist(), right.tolist(), left.tolist(), strict=True):
        around = np.r_[x[w + 1 : w + 1 + m][::-1], x[:n]]
        for k in range(len(around) - w + 1):
            seen[at + k] += 1
            assert (around[k : k + w] == tokens[at + k : at + k + w]).all()
            assert offsets.setdefault(around[k : k + w].tobytes(), m - k) == m - k
    assert seen == Counter(range(len(tokens) - w + 1)) and set(got["doc"].tolist()) == {7} and set(got["tie"].tolist()) == {9}


def test_multikey_order_and_packets():
    r = np.random.default_rng(3)
    keys = r.integers(0, 3, (2000, 3)).astype(np.uint64)
    order, same = windows.multikey_order(keys)
    got = [tuple(x) for x in keys[order].tolist()]
    assert got == sorted(got) and same.tolist() == [False] + [a == b for a, b in zip(got, got[1:], strict=False)]
    assert windows.lower_bounds(keys[order], np.array([[0, 0, 0], [1, 2, 1], [9, 9, 9]], np.uint64)) == [0, sum(x < (1, 2, 1) for x in got), 2000]
    ids = np.zeros(2000, windows.IDS)
    for name, _ in windows.IDS:
        ids[name] = r.integers(0, 99, 2000)
    for rows in (r.integers(0, 256, (2000, 88)).astype(np.uint8), r.integers(0, 1 << 48, (2000, 9)).astype(np.uint64)):
        back, own = windows.unpack_rows(windows.pack_rows(rows, ids), rows.dtype == np.uint8)
        assert (back == rows).all() and (own == ids).all()


def contexts(kind, texts):
    parts = [x for d, t in enumerate(texts) for x in windows.records(kind, np.array([d]), np.array([0]), [kind.tokens(t)])]
    keys, ids, run, gone = windows.settled(kind, *windows.gathered(kind, parts))
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return windows.Contexts(kind, keys[starts], np.minimum.reduceat(ids["doc"], starts) if kind.earlier else gone[starts].astype(np.int64))


@pytest.mark.parametrize("kind", [substring_sa.BYTES, rlz.WORDS])
def test_common_prefixes_and_endings(kind):
    """Each context's bounds are the longest agreement with any other context, by brute force."""
    c = contexts(kind, [(t or "").encode() for t in corpus(4, 25)])
    common = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    n = len(c.n_right)
    assert n > 50 and [tuple(x) for x in c.right.tolist()] == sorted(tuple(x) for x in c.right.tolist())
    far = [max(common(c.right[i], c.right[j]) for j in range(n) if j != i) for i in range(n)]
    assert c.far.tolist() == np.minimum(far, c.n_right).tolist()
    for i in c.some:
        others = [j for j in range(n) if j != i and c.run[j] == c.run[i] and c.far[j] + c.n_left[j] >= kind.window]
        assert c.back[i] == min(c.n_left[i], max(common(c.left[i], c.left[j]) for j in others))


def test_factors_are_the_longest_at_each_place():
    """A left-to-right parse by brute force: the longest agreement with any other block at each place that no factor holds."""
    c = contexts(rlz.WORDS, [(t or "").encode() for t in corpus(6, 25)])
    alike = lambda u, v: next((k for k, (s, t) in enumerate(zip(u, v, strict=False)) if s != t), min(len(u), len(v)))
    right = [c.right[i, : c.n_right[i]].tolist() for i in range(len(c.n_right))]
    left = [c.left[i, : c.n_left[i]].tolist() for i in range(len(c.n_right))]
    want = {}
    for i in range(len(right)):
        others = [j for j in range(len(right)) if j != i and right[j][:4] == right[i][:4]]
        shared = {j: (alike(left[i], left[j]), alike(right[i], right[j])) for j in others}
        before = len(left[i])
        while before >= 0:
            longest = max((f for b, f in shared.values() if b >= before), default=0)
            if before + longest >= 35:
                want[i, before] = longest
                before = 35 - longest - 1
            else:
                before -= 1
    block, before, far, reference = rlz.factors(c)
    assert {(i, b): f for i, b, f in zip(block.tolist(), before.tolist(), far.tolist(), strict=True)} == want and len(want) > 20
    for i, b, f, j in zip(block, before, far, reference, strict=True):
        assert i != j and left[i][:b] == left[j][:b] and right[i][:f] == right[j][:f]


def test_without_the_parse_spans_are_lost(spark, monkeypatch):
    rows = list(enumerate(corpus(2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = words_left(rows)
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(rlz, "factors", lambda c: (none,) * 4)
    # In this process, range by range: tasks import the module anew.
    c = contexts(rlz.WORDS, [(t or "").encode() for _, t in rows])
    assert not len(rlz.parsed(c)[0])
    monkeypatch.undo()
    assert len(rlz.parsed(c)[0]) > 100
    kept = lambda kind: windows.Kind(kind.window, kind.gram, kind.earlier, kind.tokens, kind.grams, lambda c: (none, none), kind.bytewise)
    monkeypatch.setattr(rlz, "WORDS", kept(rlz.WORDS))
    got = {x.doc_id: tuple(x)[1:] for x in rlz.deduplicated(docs).collect()}
    assert sum(want[d][1] > got[d][1] for d in want) > 10 and all(want[d][1] >= got[d][1] for d in want)


@pytest.mark.parametrize("period", [1, 3, 70])
def test_a_long_periodic_text_is_few_records(spark, period):
    """Ten million bytes of a short period are a handful of records to sort and to send, and lose what they should."""
    unit = "".join(chr(97 + (i * 7) % 26) for i in range(period))
    long = (unit * (10_000_000 // period + 1))[:10_000_000]
    rows = [(0, unit * 90), (1, long), (2, "x" + long[:5000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: tuple(x)[1:] for x in substring_sa.deduplicated(docs).collect()}
    whole = sha(b"")
    if period * 90 >= 50 + period:
        assert got[0][1:3] == (0, 0) and got[1] == (len(long), len(long), 1, whole) and got[2] == (5001, 5000, 1, sha(b"x"))
    text = long[:2_000_000].encode()
    kept = 0
    for keys, ids in windows.records(substring_sa.BYTES, np.array([1]), np.array([0]), [np.frombuffer(text, np.uint8)]):
        keys, ids, number, gone = windows.settled(substring_sa.BYTES, keys, ids)
        kept += len(windows.collapsed(substring_sa.BYTES, number, ids, ~gone)[0])
    assert kept <= (period if period <= 50 else len(text)) * (len(text) // windows.PIECE + 2)


@pytest.mark.parametrize("ranges", [60])
def test_runs_that_fill_ranges_are_cut_without_loss(spark, monkeypatch, ranges):
    """One passage in every document, with other neighbours: its k-grams fill ranges, and repeats lie across their borders."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for d in range(90):
        a, z = sorted(r.sample(range(61), 2))
        rows.append((d, " ".join([word() for _ in range(r.randint(0, 9))] + passage[a:z] + [word() for _ in range(r.randint(0, 9))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(windows, "RANGE_BYTES", sum(len(t) for _, t in rows) // ranges + 1)
    monkeypatch.setattr(windows, "PER_BORDER", 400)
    assert {x.doc_id: tuple(x)[1:] for x in substring_sa.deduplicated(docs).collect()} == bytes_left(rows)
    assert {x.doc_id: tuple(x)[1:] for x in rlz.deduplicated(docs).collect()} == words_left(rows)


# Near duplicates


def alike(docs, size=4, percent=80):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def copies(seed, count=150):
    """A group of edited copies of one text, some of them too far apart to be linked directly, and unrelated texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(999)}" for _ in range(150)]
    rows = []
    for i in range(count):
        w = list(base) if i % 4 else [f"v{r.randrange(9999)}" for _ in range(60)]
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, rows[1][1]), (1003, rows[1][1].upper()), (1004, "few words"), (1005, "few  WORDS")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, seed):
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(docs, 4, 80).collect()} == alike(rows)


@pytest.mark.parametrize("limit", ["rows", "shingles", "full"])
def test_blocks_of_full_buckets_lose_nothing(spark, monkeypatch, limit):
    rows = copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if limit == "rows":
        monkeypatch.setattr(near.linked, "__defaults__", (8,))
    elif limit == "shingles":
        monkeypatch.setattr(near, "BLOCK_SHINGLES", 900)
    else:
        monkeypatch.setattr(near, "FULL", 100_000)  # every bucket counts as full
    assert {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(docs, 4, 80).collect()} == alike(rows)


def test_near_awkward_rows(spark):
    want = alike(list(cases.texts().items()))
    assert {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(cases.frame(spark), 4, 80).collect()} == want
    docs = cases.frame(spark)
    kept = near.keep_first(docs, 4, 80)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in want.items() if v[2])
    assert near.near_duplicates(cases.empty(spark)).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(0)
    for n in (3, 40, 3000, 40_000):
        pool = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = pool[: n + n // 2], pool[n // 2 :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near.superminhash(a) == near.superminhash(b)).mean() - true) < 0.2
        assert (near.superminhash(a) == near.superminhash(a[::-1])).all()


def test_superminhash_stops_early_without_change():
    """The plain form: every level of every element."""
    def plain(elements, slots):
        least = [1 << 63] * slots
        for e in elements:
            order = list(range(slots))
            for level in range(slots):
                x = int(near.mixed(np.array([e + (level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0])
                k = level + ((x & 0xFFFFFFFF) * (slots - level) >> 32)
                order[level], order[k] = order[k], order[level]
                least[order[level]] = min(least[order[level]], (level << 32) + (x >> 32))
        return least

    for n in (1, 7, 60):
        elements = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        assert near.superminhash(elements, 24).tolist() == plain([int(e) for e in elements], 24)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(500, k) for k in range(501, 700)]
    parent = {}
    for a, b in edges:
        a, b = groups.find(parent, a), groups.find(parent, b)
        parent[max(a, b)] = min(a, b)
    want = {x: groups.find(parent, x) for x in list(parent) if groups.find(parent, x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.child: r.parent for r in groups.components(df).collect()} == want
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes(monkeypatch):
    """Equal words hash alike wherever they stand, and others do not; chunks may cut words."""
    r = random.Random(5)
    for size in (7, 1 << 18):
        monkeypatch.setattr(base, "CHUNK", size)
        seen = {}
        for _ in range(300):
            data = bytes(r.choice(b"ab\xc3 \n\x0b\x1f") for _ in range(r.randint(0, 60)))
            hashes = base.word_hashes(data).tolist()
            assert len(hashes) == len(data.split())
            for word, h in zip(data.split(), hashes, strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
