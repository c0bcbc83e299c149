"""The corpus pipeline: every stage against a plain version of its decision on
its own input, and the edge cases of all stages together."""

from collections import defaultdict

import pytest

import corpus_pipeline
from genderlens.llm import packing, quality, toxicity
from genderlens.llm.common import cut, table
from tests.conftest import SF001
from tests.llm.test_model_ops import plain_pack
from tests.llm.test_text_ops import plain_fingerprint, plain_groups, plain_removal


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of every stage and the last output, as written tables."""
    out = [table(spark, SF001, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF001)))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(inputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "simhash near-dedup",
                                                      "suffix-array dedup", "best-fit packing"]
    assert all(df.columns == inputs[0].columns for df in inputs[1:-1])
    sizes = [df.count() for df in inputs[:-1]]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0


def test_classifier_stages_follow_the_scores(spark, inputs):
    labels = table(spark, SF001, "labels")
    for operator, stage, wanted in ((toxicity.classify, 0, 0), (quality.classify, 1, 1)):
        scores = {r.doc_id: r.predicted for r in operator(inputs[stage], labels).collect()}
        kept = by_id(inputs[stage + 1])
        assert set(kept) == {i for i, p in scores.items() if p == wanted}
        before = by_id(inputs[stage])
        assert all(kept[i] == before[i] for i in kept)


def test_classifier_stages_leave_clean_documents_alone(spark, inputs):
    labels = {r.doc_id: r for r in table(spark, SF001, "labels").collect()}
    clean = [i for i in by_id(inputs[0]) if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    kept = by_id(inputs[2])
    assert sum(i in kept for i in clean) > 0.95 * len(clean)


def test_simhash_stage_keeps_the_smallest_of_each_group(inputs):
    before = by_id(inputs[2])
    groups = plain_groups(list(before), [plain_fingerprint(r.text) for r in before.values()], 4)
    assert set(by_id(inputs[3])) == set(groups.values())


def test_suffix_stage_removes_what_repeats(inputs):
    before, after = by_id(inputs[3]), by_id(inputs[4])
    assert set(before) == set(after)
    want = plain_removal(sorted((i, r.text) for i, r in before.items()))
    for i, r in after.items():
        raw, gone = want[i][0], want[i][1]
        # a run may begin or end inside a character, whose pieces go too
        assert raw - gone - 6 * want[i][2] <= len(r.text.encode()) <= raw - gone
        assert r.n_chars == len(r.text)
        if not gone:
            assert r.text == before[i].text


def test_packing_stage_is_best_fit(inputs):
    docs, got = by_id(inputs[4]), inputs[5].collect()
    flat = {i: " ".join(w.decode() for w in r.text.lower().encode().split()) for i, r in docs.items()}
    names: dict[str, int] = {}
    rows = [(i, r.source, names.setdefault(flat[i], len(names)) if flat[i] else None, len(r.text.encode().split())) for i, r in docs.items()]
    want = plain_pack(rows, packing.CAPACITY)
    assert {(p.doc_id, p.piece): (p.n_words, p.bin) for p in got} == want


def test_run_equals_its_stages(spark, inputs):
    got = corpus_pipeline.run(spark, SF001).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, inputs[-1].collect()))


def test_stages_take_odd_rows_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 10),
            (5, "word " * 30_000, "en", "a", 150_000), (6, "é" * 300 + " x", "fr", None, 302), (7, "é" * 300 + " y", "fr", None, 302)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF001)
            found = out.collect()
            if name != "best-fit packing":
                assert out.columns == docs.columns
            assert docs.count() or not found
        sums = defaultdict(int)
        for p in found:
            sums[p.doc_id] += p.n_words
        if docs.count():
            assert sums[5] == 30_000
