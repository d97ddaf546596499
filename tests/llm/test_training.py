import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import training

W = training.tokenizer(training.RANKS)
ROWS = [(1, None), (2, ""), (3, "One text."), (3, "One text."), (None, "no id"), (4, "long words " * 3_000), (5, "é🙂漢\n\n  x\t"), (6, "y" * 20_000), (7, "²½Ⅷ 12 don't")]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3_000), st.integers(0, 2**70))
def test_permutation(total, key):
    assert sorted(training.permute(np.arange(total), total, key)) == list(range(total))


def test_permutation_mixes():
    n = 100_000
    out = training.permute(np.arange(n), n, 5)
    assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.02 and abs(np.corrcoef(out[:-1], out[1:])[0, 1]) < 0.02
    assert (out != training.permute(np.arange(n), n, 6)).mean() > 0.99


def test_words_encode_like_the_library(spark, sf):
    for _, t in ROWS:
        assert W.encode(t).tolist() == W.bpe.encode_ordinary(t or "") + [W.end]
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect():
        assert W.encode(r.text).tolist() == W.bpe.encode_ordinary(r.text) + [W.end]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0_'sat²1.,é漢\u0301"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_any_text_encodes_like_the_library(text):
    assert W.encode(text).tolist() == W.bpe.encode_ordinary(text) + [W.end]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \n\0\x85\xa0\u2003\u3000'sa1.,é漢"), max_size=12)), max_size=6), st.integers(0, 3))
def test_many_texts_encode_like_each_alone(texts, first):
    ids, sizes = W.encode_all(pa.array(texts, pa.string())[first:])
    want = [W.bpe.encode_ordinary(t or "") for t in texts[first:]]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_a_stretch_is_encoded_once_for_all_texts(monkeypatch):
    words, calls = training.Tokenizer(training.RANKS), []
    for name in ("encode_ordinary", "encode_to_numpy"):
        plain = getattr(type(words.bpe), name)
        monkeypatch.setattr(type(words.bpe), name, lambda bpe, text, _plain=plain, **how: calls.append(text) or _plain(bpe, text, **how))
    texts = [f"Qanonly hedly{mark} edthion{mark}\nthonre qanonly" for mark in ".,;:!?)" * 30]
    words.encode_all(pa.array(texts, pa.string()))
    out = [words.encode(t) for t in texts]
    assert len(calls) == 1 and calls[0].count("hedly") == 1 == calls[0].count("edthion")
    monkeypatch.undo()
    assert all(o.tolist() == words.bpe.encode_ordinary(t) + [words.end] for o, t in zip(out, texts, strict=True))


@pytest.mark.parametrize("remembered", [0, 3])
def test_words_beyond_those_remembered_are_encoded_again(monkeypatch, remembered):
    monkeypatch.setattr(training, "REMEMBERED", remembered)
    words = training.Tokenizer(training.RANKS)
    for t in ["a b", "c d e f", "a b", None, "c d e f g"]:
        assert words.encode(t).tolist() == words.bpe.encode_ordinary(t or "") + [words.end]
        assert len(words.known) <= remembered


def back(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.key), r.piece)):
        out.setdefault(r.key, []).append(np.frombuffer(r.ids, "<u2"))
    return out


@pytest.mark.parametrize("length,shard_bytes", [(16, 2_000), (256, 1 << 20)])
def test_round_trip_and_resumed_reads(spark, tmp_path, length, shard_bytes):
    docs = spark.createDataFrame([(t, i) for i, t in ROWS], "text string, doc_id long").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    layout = training.write(docs, str(tmp_path / "out"), length=length, shard_bytes=shard_bytes)
    rows = training.read(spark, layout).collect()
    assert sorted(r.slot for r in rows) == list(range(layout.total)) and (layout.shards > 3) == (length == 16)
    assert all(r.size == len(r.ids) // 2 <= length for r in rows)
    for key, parts in back(rows).items():
        texts = [t for i, t in ROWS if i == key]
        if len(texts) == 1:
            assert W.decode(np.concatenate(parts)) == (texts[0] or "")
            assert sum(map(len, parts)) == len(W.encode(texts[0]))
    assert sum(r.key == 3 for r in rows) == 2 * -(-len(W.encode("One text.")) // length)
    some = training.read(spark, layout, 3, 9).collect()
    want = {r.slot: r for r in rows if 3 <= r.slot < 9}
    assert {r.slot: r for r in some} == want
    sizes = sorted(p.stat().st_size for p in (tmp_path / "out" / "shards").glob("part-*"))
    assert sum(sizes) == layout.total * layout.stride and all(s == layout.per_shard * layout.stride for s in sizes[1:])


def test_empty_table(spark, tmp_path):
    layout = training.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"))
    assert layout.total == 0 and training.read(spark, layout).count() == 0


def test_query(spark, sf):
    rows = training.op5_training_order(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len(rows) == sum(-(-len(W.encode(d.text)) // 256) for d in docs)
    assert sum(r.n_tokens for r in rows) == sum(len(W.encode(d.text)) for d in docs)
    assert len({(r.shard, r.byte_offset) for r in rows}) == len(rows)
