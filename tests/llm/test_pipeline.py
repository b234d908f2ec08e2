import pyarrow as pa
import pytest
from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from test_ngram_join import brute as brute_components
from test_private_data import base
from test_tokens import MODEL, encoded

import __spark_entry__ as entry
import corpus_pipeline
from pulsegrid.llm import decontaminate as D
from pulsegrid.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "private_data", "sentencepiece"]
    assert all(s.schema == stages[0].schema for s in stages[:-1])


def test_toxicity(spark, stages):
    chain = toxicity.fit_chain(stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    rows = stages[0].collect()
    p = chain.probabilities(pa.array([r.text for r in rows]))[:, -1]
    assert ids(stages[1]) == {r.doc_id for r, x in zip(rows, p, strict=True) if x < toxicity.THRESHOLD}
    assert len(ids(stages[1])) > 0.8 * len(rows)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == {d for d, _, c in brute_components(rows, 5, 80) if d == c or c is None}


def test_decontamination(spark, stages):
    items = [D.normal(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    gone = ids(stages[2]) - ids(stages[3])
    for r in stages[2].collect():
        text = D.normal(r.text)
        exact = any(i in text for i in items)
        assert not exact or r.doc_id in gone
        if r.doc_id in gone:
            assert any(D.search(i, text)[0] <= int(len(i) * D.BUDGET) for i in items)


def test_private_data(stages):
    assert ids(stages[4]) == ids(stages[3])
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not base(r.text) and (r.text == before[r.doc_id] or any(c in before[r.doc_id] for c in "0123456789@"))


def test_tokens_and_run(spark, stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = encoded(library, [(r.doc_id, r.text) for r in stages[4].collect()])
    assert sorted((tuple(r) for r in stages[5].collect()), key=str) == want
    assert sorted((tuple(r) for r in entry.queries()["pipeline"](spark, SF_SMALL).collect()), key=str) == want


def test_edge_rows_and_nothing(spark, edge, nothing):
    for docs in (edge.drop("component_id", "key", "base_"), nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns or name == "sentencepiece"
            docs = out.cache()
        assert (docs.count() == 0) == (out is docs and docs.isEmpty())
