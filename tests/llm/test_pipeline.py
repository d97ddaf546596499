from collections import defaultdict

import numpy as np

import corpus_pipeline as pipeline
from tests.llm.test_simhash import brute as simhash_code
from tests.llm.test_simhash import closure
from tideframe.llm import decontaminate, pieces, quality, secrets


def plain(spark, sf):
    """The stages one after the other on plain rows; the classifier's model is fitted by Spark."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    _, model = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    stats = np.array([quality.statistics((d.text or "").encode()) for d in docs.values()])
    texts = {i: docs[i].text for i, s in zip(docs, model.scores(stats)) if s >= 0.5}
    codes = {i: simhash_code(t) for i, t in texts.items()}
    distinct = sorted(set(codes.values()))
    group = closure([(a, b) for a in distinct for b in distinct if (a ^ b).bit_count() <= 3])
    least = {}
    for i in sorted(texts):
        least.setdefault(group[codes[i]], i)
    texts = {i: texts[i] for i in least.values()}
    items = [decontaminate.split_item(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shingled = [[decontaminate.shingles(decontaminate.words(x)) for x in item] for item in items]

    def leaks(text):
        tokens, held = decontaminate.words(text), {}
        return any(all(decontaminate.overlap(part, tokens, held) >= 0.8 for part in item) for item in shingled)

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    owners = defaultdict(set)
    for i, t in texts.items():
        for _, _, _, v in secrets.candidates(t or ""):
            owners[v].add(docs[i].source)
    out = {}
    for i, t in texts.items():
        found = [(k, s, e, v) for k, s, e, v in secrets.candidates(t or "") if k < 3 or len(owners[v]) == 1]
        marks = [{"start": s, "end": e, "verdict": "example" if len(owners[v]) >= 3 else "live"} for k, s, e, v in found]
        out[i] = secrets._masked(t, marks) if marks else t
    return docs, out


def test_pipeline_against_plain_version(spark, sf):
    wide = sf.replace("0.001", "0.01")
    docs, want = plain(spark, wide)
    vocab = pieces.vocabulary(pieces.MODEL)
    rows = {r.doc_id: r for r in pipeline.run(spark, wide).collect()}
    assert set(rows) == set(want) and 500 < len(want) < len(docs)
    for i, text in want.items():
        assert rows[i].pieces == vocab.model.encode(text or "")
        assert 1 <= len(rows[i].samples) <= pipeline.SAMPLES
        assert all(vocab.decode(s.ids) == (text or "").replace("▁", " ") for s in rows[i].samples)
    assert any("<secret>" in (t or "") for t in want.values())


def test_stages_keep_columns_and_take_edge_rows(spark, tmp_path, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A plain sentence.", "en", "s", 17), (3, "A plain sentence.", "en", "s", 17), (None, "Another one here now.", "en", None, 21)]
    for name, part in (("some", rows), ("none", [])):
        folder = tmp_path / name
        docs = spark.createDataFrame(part, schema)
        docs.write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(folder / f"{t}.parquet"))
        for n, (_, stage) in enumerate(pipeline.STAGES, 1):
            out = stage(spark, docs, str(folder))
            kept = out.collect()
            assert n == len(pipeline.STAGES) or out.columns == docs.columns
            docs = spark.createDataFrame(kept, out.schema)
        assert len(kept) == (3 if part else 0)  # empty texts are one group


def test_names_of_the_stages():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]


def test_last_stage_samples_as_op1(spark, sf):
    docs = spark.createDataFrame([(1, "A plain sentence of several words.", "en", "s", 34), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in pipeline.token_ids(spark, docs, sf).collect()}
    assert len(rows[1].samples) == pieces.K and all(r.decodes for r in rows.values())
