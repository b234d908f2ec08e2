import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpus_rows import SF_CHECK, edge, nothing, some_labels  # noqa: F401
from pulsegrid.llm import quality, registry, toxicity
from pulsegrid.llm import words as W


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels")}


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_quality_on_held_out_rows(spark, tables):
    out = {r.doc_id: r for r in registry.QUERIES["op10_quality"](spark, SF_CHECK).collect()}
    assert len(out) == tables["documents"].count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in out.items())
    held = [(out[r.doc_id].score, r.quality) for r in tables["labels"].collect() if out[r.doc_id].held_out]
    score, label = (np.array(x) for x in zip(*held, strict=True))
    assert auc(score, label) > 0.95 and np.mean((score >= 0.5) == (label == 1)) > 0.9


def test_quality_learns_nothing_from_held_out_labels(spark, tables):
    small = tables["documents"].limit(300)
    flipped = tables["labels"].withColumn("quality", quality.F.when(quality.remainder() == 2, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.score(small, x).collect()) for x in (tables["labels"], flipped))
    assert np.allclose([x[1] for x in a], [x[1] for x in b])


def test_word_vectors_count_every_document(spark, edge):
    rows = [r.text for r in edge.collect()]
    want = quality._neighbours(*quality.tokens(W.Texts(pa.array(rows))))
    assert (quality.corpus_vectors(edge) == want).all()


def test_toxicity_on_rows_outside_the_sample(spark, tables):
    rows = tables["documents"].join(tables["labels"], "doc_id").orderBy("doc_id").collect()
    text, label = pa.array([r.text for r in rows]), np.array([r.toxic for r in rows])
    train = np.arange(len(rows)) % 3 != 0
    chain = toxicity.train(text.filter(pa.array(train)), label[train], np.arange(train.sum()) % 4)
    p = chain.probabilities(text.filter(pa.array(~train)))[:, -1]
    assert auc(p, label[~train]) > 0.9
    assert np.mean(p[label[~train] == 0] < toxicity.THRESHOLD) > 0.97


def test_toxicity_by_language_on_rows_outside_the_sample():
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id", join_type="inner").sort_by("doc_id")
    text, lang, label = rows.column("text").combine_chunks(), np.array(rows.column("lang").to_pylist()), np.array(rows.column("toxic").to_pylist())
    train = np.arange(len(label)) % 3 != 0
    chain = toxicity.train(text.filter(pa.array(train)), label[train], np.arange(train.sum()) % 4)
    p, lang, label = chain.probabilities(text.filter(pa.array(~train))), lang[~train], label[~train]
    for own in (lang == x for x in ("en", "de", "fr", "es")):
        called, toxic = p[own] >= toxicity.THRESHOLD, label[own] == 1
        assert called[toxic, -1].mean() >= 0.7 and toxic[called[:, -1]].mean() >= 0.75
        # every category hands something on in every language
        assert (called[toxic, :-1].mean(axis=0) > 0.4).all() and (called[~toxic, :-1].mean(axis=0) < 0.05).all()


def test_toxicity_of_planted_documents(spark, tables):
    docs = tables["documents"]
    clean = "the report of the town hall was read and then the people went home to eat in peace"
    planted = spark.createDataFrame([(-1, clean + " you stupid idiot you are a pathetic moron and worthless scum " + clean), (-2, clean), (-3, None), (-4, "")], "doc_id long, text string")
    chain = toxicity.fit_chain(docs, tables["labels"])
    out = {r.doc_id: r for r in toxicity.score(planted, chain).collect()}
    assert out[-1].toxic and not any(out[i].toxic for i in (-2, -3, -4))
    assert {r.doc_id for r in toxicity.without_toxic(planted, chain).collect()} == {-2, -3, -4}


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    texts, label = [], []
    for _ in range(600):
        bad = rng.random() < 0.3
        texts.append(" ".join(rng.choice(["calm", "field", "river", "tree"], 12)) + (" " + " ".join(rng.choice(["idiot", "scum", "vile"], 2)) if bad else ""))
        label.append(int(bad))
    chain = toxicity.train(pa.array(texts), np.array(label), np.arange(600) % 4)
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2, 3] and np.abs(chain.models[-1].earlier).max() > 0.1
    assert ((chain.probabilities(pa.array(texts))[:, -1] >= 0.5) == np.array(label)).all()


def test_edge_rows(edge, nothing, some_labels):
    chain = toxicity.fit_chain(edge, some_labels)
    for out in (toxicity.score(edge, chain), quality.score(edge, some_labels)):
        rows = out.collect()
        assert sorted((r.doc_id for r in rows), key=str) == sorted((r.doc_id for r in edge.collect()), key=str)
        assert all(x is not None for r in rows for x in tuple(r)[1:])
    assert toxicity.without_toxic(edge, chain).schema == edge.schema
    none = some_labels.limit(0)
    assert toxicity.fit_chain(edge, none) is None and not any(r.toxic for r in toxicity.score(edge, None).collect())
    assert toxicity.without_toxic(edge, None).count() == edge.count()
    assert all(r.score == 0.5 for r in quality.score(edge, none).collect())
    assert quality.score(nothing, some_labels).count() == 0 == toxicity.score(nothing, None).count()


def test_texts_of_the_sample_stay_on_executors(spark, tables, monkeypatch):
    frame = type(tables["documents"])
    seen, collect = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (seen.append(self.columns), collect(self))[1])
    chain = toxicity.fit_chain(tables["documents"], tables["labels"])
    quality.score(tables["documents"].limit(100), tables["labels"])
    assert seen and not any("text" in columns for columns in seen)
    # the same chain as from texts in memory
    rows = collect(toxicity.sample(tables["documents"], tables["labels"], "toxic").orderBy("order_"))
    text = pa.array([r.text for r in rows])
    local = toxicity.train(text, np.array([r.label for r in rows]), np.array([r.fold for r in rows]))
    assert (chain.used == local.used).all() and np.allclose(chain.probabilities(text), local.probabilities(text))


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)] + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    assert sorted(r.text for r in toxicity.sample(docs, labels, "toxic", 5).collect()) == [f"text {i}" for i in range(5)]
