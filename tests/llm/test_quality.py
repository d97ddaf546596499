import numpy as np

from tideframe.llm import quality

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "One plain sentence here."), (4, "One plain sentence here."), (None, "x" * 50_000), (5, "word " * 20_000), (6, "| | | !!")]


def test_held_out_accuracy(spark, sf):
    wide = sf.replace("0.001", "0.01")
    marks = spark.read.parquet(f"{wide}/labels.parquet")
    out = quality.op10_quality(spark, wide)
    assert out.count() == spark.read.parquet(f"{wide}/documents.parquet").count()
    held = out.where("held_out").join(marks, "doc_id").collect()
    right = {q: np.mean([r.predicted == q for r in held if r.quality == q]) for q in (0, 1)}
    assert len(held) > 100 and right[0] > 0.9 and right[1] > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)


def test_scores_are_gaussian_log_density_differences(spark):
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = {0: rng.normal(size=(60, d)) @ rng.normal(size=(d, d)), 1: rng.normal(size=(200, d)) + 1}
    rows = [(k, [float(v) for v in r]) for k in x for r in x[k]]
    model = quality.fit(spark.createDataFrame([*rows, (None, [0.0] * d), (7, [0.0] * d)], "label int, stats array<double>"), "stats", "label", 0.1, 0.05)
    both = np.vstack([x[0], x[1]])
    z = {k: (v - both.mean(axis=0)) / both.std(axis=0) for k, v in x.items()}
    own = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = (60 * own[0] + 200 * own[1]) / 260
    log = []
    for k in (0, 1):
        c = 0.9 * own[k] + 0.1 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / d * np.eye(d) + 1e-9 * np.eye(d)
        gap = np.vstack([z[0], z[1]]) - z[k].mean(axis=0)
        log.append(-0.5 * np.einsum("ij,ij->i", gap @ np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1] + np.log((len(z[k]) + 1) / 262))
    assert np.allclose(model.scores(both), 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), atol=1e-8)


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 0.5) for r in EDGE], "doc_id long, text string, _stats double")
    labels = spark.createDataFrame([(4, 1), (4, None), (6, 0), (None, 0)], "doc_id long, quality int")
    out, _ = quality.judge(docs, labels)
    assert out.count() == len(EDGE) and all(0 <= r.score <= 1 for r in out.collect())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(EDGE)
    none, _ = quality.judge(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.judge(docs.limit(0), labels)[0].count() == 0
    only, _ = quality.judge(docs, labels.where("quality = 1"))
    assert all(0 <= r.score <= 1 for r in only.collect())
