import random
import re
from collections import Counter

import numpy as np

from shelfmark.llm import classifier, rules

from . import cases


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    got = {r.doc_id: tuple(r)[1:7] for r in rules.quality(cases.frame(spark)).collect()}
    assert got == {d: brute(t) for d, t in cases.texts().items()}
    assert rules.quality(cases.empty(spark)).count() == 0


def test_verdicts(spark):
    clean = cases.CLEAN
    docs = spark.createDataFrame([(1, clean), (2, " ".join(f"{w}###" for w in clean.split())), (3, clean.upper()), (4, "short")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in rules.quality(docs).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [r.doc_id for r in rules.keep_good(docs).collect()] == [1]


def test_order_never_changes_verdicts():
    t = [rules.Text((cases.CLEAN + x).encode()) for x in ("", " # " * 90, "A" * 900)]
    forward, backward = rules.Cascade(tuple(rules.RULES)), rules.Cascade(tuple(reversed(rules.RULES)))
    assert [forward.rejected_by(x) is None for x in t] == [backward.rejected_by(x) is None for x in t] == [True, False, False]


def test_cascade_is_greedy_by_rejections_per_cost():
    """Rule a rejects most, b costs least; c shares a's measurement, so that it costs nothing more once a has run."""
    make = lambda n, *needs: rules.Rule(n, lambda t: False, needs)
    several = [make("a", "words"), make("b", "lines"), make("c", "words", "n_words"), make("d", "shouting")]
    seen = rules.Measured({0b0001: 50, 0b0010: 20, 0b0101: 10, 0b0100: 5, 0b1000: 1, 0: 14}, {"words": 10.0, "lines": 1.0, "n_words": 0.1, "shouting": 0.5})
    assert [r.name for r in rules.ordered(several, seen).rules] == ["b", "a", "c", "d"]
    assert [r.name for r in rules.ordered(several, rules.Measured({}, {})).rules] == ["a", "b", "c", "d"]


def test_measured_patterns(spark):
    docs = spark.createDataFrame([(i, cases.CLEAN.upper() if i % 4 == 0 else cases.CLEAN) for i in range(40)], "doc_id long, text string")
    seen = rules.measure(docs, rules.RULES)
    k = [r.name for r in rules.RULES].index("capitals")
    assert seen.patterns == {0: 30, 1 << k: 10} and set(seen.seconds) == {x for r in rules.RULES for x in r.needs}


def test_more_rules_by_brute_force():
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice(["a ", "1 ", "é", "- ", "...", "… ", "\n", "• ", "* ", "ab ", "\x0b"]) for _ in range(r.randint(0, 25)))
        t, w = rules.Text(text.encode()), words(text)
        lines = [x for x in text.split("\n") if words(x)]
        assert t.n_lettered == sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
        assert t.n_bullets == sum(words(x)[0][0] in "-*•" for x in lines)
        assert t.n_ellipses == sum(words(x)[-1].endswith(("...", "…")) for x in lines)
        assert t.most_common == max(Counter(w).values(), default=0)


def test_stage_keeps_columns(spark):
    docs = cases.frame(spark)
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 13}
    assert rules.keep_good(cases.empty(spark)).count() == 0


def test_classifier_learns_and_scores_everything(spark):
    r = np.random.default_rng(0)
    word = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    good = [" ".join(["the", "of", "and"][k % 3] + " " + word(5) for k in range(80)) for _ in range(60)]
    bad = [" ".join(word(4) + "###" for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in classifier.scored(docs, classifier.fit(docs, labels)).collect()}
    assert len(got) == 122 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    held = [x for x in got.values() if x.held_out and x.doc_id < 120]
    assert len(held) > 20 and all(x.predicted == (x.doc_id < 60) for x in held)
    assert got[900].score == got[901].score


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.scored(cases.frame(spark), classifier.fit(cases.frame(spark), labels)).collect()} == {0.5}
    assert classifier.scored(cases.empty(spark), classifier.fit(cases.empty(spark), labels)).count() == 0


def test_training_is_follow_the_regularised_leader():
    """Weights against a plain form: one coordinate at a time, dictionaries, the same order of examples."""
    r = np.random.default_rng(4)
    examples, labels = [], []
    for _ in range(30):
        at = np.unique(r.integers(0, 40, 8))
        examples.append((at, r.random(len(at)) * 3))
        labels.append(int(r.integers(0, 2)))
    got, bias = classifier.train(examples, labels, epochs=3, seed=5)
    z, n, b, bn = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= classifier.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * classifier.L1) / ((classifier.BETA + n[i] ** 0.5) / classifier.ALPHA + classifier.L2)

    order = np.random.default_rng(5)
    for _ in range(3):
        for k in order.permutation(len(labels)):
            at, value = examples[k]
            w = {int(i): weight(int(i)) for i in at}
            p = 1 / (1 + np.exp(-(sum(w[int(i)] * v for i, v in zip(at, value, strict=True)) + b)))
            for i, v in zip(at.tolist(), value.tolist(), strict=True):
                g = (p - labels[k]) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / classifier.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bn += (p - labels[k]) ** 2
            b -= 0.1 * (p - labels[k]) / (1 + bn**0.5)
    assert np.allclose([got[i] for i in range(40)], [weight(i) for i in range(40)]) and abs(b - bias) < 1e-12 and not got[40:].any()


def test_a_document_labelled_twice_counts_twice(spark):
    docs = spark.createDataFrame([(1, "good words"), (1, "other words"), (2, "bad ###")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    w, bias = classifier.fit(docs, labels)
    assert np.abs(w).sum() > 0 and {r.doc_id for r in classifier.scored(docs, (w, bias)).collect()} == {1, 2}
