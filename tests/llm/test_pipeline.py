"""The pipeline stage by stage against plain versions, on a whole small table."""

from collections import Counter

import sentencepiece
from docs import ROWS, empty, frame
from test_fuzzy_lines import expected
from test_pareto_mix import plain_mix
from test_simhash_golay import components, plain_fingerprint

import corpus_pipeline
from quern.llm import cotrain_quality, entry, piece_fst, simhash_golay


def test_entry_names():
    names = entry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_against_plain_versions(spark, sf_dir):
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, held = docs.collect(), []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"test-{at}")
        if at < 4:
            assert docs.columns == first.columns, name
        after = docs.collect()
        held.append((before, after))
        before = after
    (raw, good), (_, lines), (_, apart), (_, mix), (_, encoded) = held
    model = cotrain_quality.fit(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: r.score for r in cotrain_quality.score(first, model).collect()}
    assert {r.doc_id for r in good} == {r.doc_id for r in raw if score[r.doc_id] >= 0.5}
    want = expected([(r.doc_id, r.text) for r in good])
    assert len(lines) == len(good) and len({(r.doc_id, r.text) for r in lines} & want) >= 0.98 * len(good)
    ids = sorted(r.doc_id for r in lines)
    text = {r.doc_id: r.text for r in lines}
    group = components([plain_fingerprint(text[i]) for i in ids], simhash_golay.WIDE)
    assert sorted(r.doc_id for r in apart) == sorted(min(i for i, g in zip(ids, group) if g == c) for c in set(group))
    assert Counter((r.doc_id, r.text) for r in mix) == +plain_mix(apart)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_model())
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == Counter((r.doc_id, tuple(library.encode(r.text))) for r in mix)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in again) == Counter((r.doc_id, tuple(r.ids)) for r in encoded)


def test_stages_on_odd_rows(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        odd, none = frame(spark), empty(spark)
        out = stage(spark, odd, sf_dir)
        assert stage(spark, none, sf_dir).count() == 0, name
        if name != "piece encoding":
            assert out.columns == odd.columns
        n = out.count()
        assert 0 < n <= 3 * len(ROWS), name
        assert n == len(ROWS) or name in ("quality classifier", "SimHash near-dedup", "mixing")
