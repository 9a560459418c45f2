import math
import os
from collections import Counter

import corpus_pipeline
import pytest

from shelfmark.llm import mixing, near, pieces, pii, rules
from shelfmark.llm.queries import oracle_sql, piece_model, queries

from . import cases


def sources(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i < 3000 else "small" if i < 3300 else None if i < 3350 else "none") for i in range(3400)]
    return spark.createDataFrame([(d, "" if s == "none" else t, s) for d, t, s in rows], "doc_id long, text string, source string")


def test_weights_meet_entropy_and_budget(spark):
    docs = sources(spark)
    tokens = mixing.counted(docs)
    plan = {r.source: r for r in mixing.plan(tokens).collect()}
    total = sum(r.tokens for r in plan.values())
    weights = [r.weight for r in plan.values() if r.weight]
    entropy = -sum(w * math.log(w) for w in weights)
    assert abs(sum(weights) - 1) < 1e-9 and entropy <= 0.9 * math.log(3) + 1e-6 and plan["none"].weight == 0
    repeats = max(r.weight * total / r.tokens for r in plan.values() if r.tokens)
    assert repeats <= 4 + 1e-6 and (entropy > 0.9 * math.log(3) - 1e-4 or repeats > 4 - 1e-3)
    taken = mixing.mixture(docs).collect()
    got = Counter()
    for r in taken:
        got[r.source] += r.n_tokens
    for s, r in plan.items():
        assert r.goal - 7 * 2 < got[s] <= r.goal or r.goal == 0
    whole = {s: r.passes for s, r in plan.items()}
    assert all(n in (whole[s], whole[s] + 1) for (_, s), n in Counter((r.doc_id, r.source) for r in taken).items())


def test_permutations_differ_by_pass(spark):
    taken = mixing.mixture(sources(spark)).filter("source = 'small'").collect()
    order = lambda p: [r.block for r in sorted((r for r in taken if r["pass"] == p), key=lambda r: r.block_key)]
    assert order(0) != order(1) and set(order(0)) == set(order(1))


def test_mixed_rows_agree_with_the_mixture(spark):
    docs = sources(spark)
    want = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want


def test_mixing_awkward_rows(spark):
    docs = cases.frame(spark, cases.rows()[4:7])
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixture(docs).count() > 0
    assert mixing.mixture(cases.empty(spark)).count() == 0 and mixing.mixed_rows(cases.empty(spark)).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mixture(silent).count() == 0


def test_native_plan(spark):
    plan = mixing.mixture(sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    cascade = rules.Cascade(tuple(rules.RULES))
    good = {d for d, t in texts.items() if not rules.base_failed(v := rules.Text((t or "").encode())) and cascade.rejected_by(v) is None}
    stage = docs.filter(docs.doc_id.isin(*good))
    kept = {r.doc_id for r in near.near_duplicates(stage).filter("kept").collect()}
    clean = spark.createDataFrame([(d, pii_text(texts[d]), s) for d, s in ((r.doc_id, r.source) for r in docs.collect()) if d in kept], "doc_id long, text string, source string")
    want = Counter(r.doc_id for r in mixing.mixture(clean).collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == want
    table = pieces.ChunkTable(piece_model())
    for r in rows[:50]:
        assert list(r.ids) == table.model.encode(pii_text(texts[r.doc_id]), add_eos=True)


def pii_text(text):
    parts, at = [], 0
    for kind, a, b in sorted(pii.all_spans(text, pii.model())[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def test_stages_on_awkward_rows(spark, tmp_path):
    for docs in (cases.frame(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, str(tmp_path))
            assert docs_out.columns == docs.columns, name
            docs = docs_out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in queries()}
    assert names == {f"op{k}" for k in range(1, 11)} and set(oracle_sql()) <= set(queries())
