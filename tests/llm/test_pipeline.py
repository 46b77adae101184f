"""The stages of the corpus pipeline against plain versions of them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_text_operators import brute_classes, brute_dedup, brute_overlap, plain_words  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillspark.llm import toxicity  # noqa: E402
from quillspark.llm.common import cut  # noqa: E402


def rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The input of each stage, and the last output."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], sf), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "mixing"]
    assert all(d.columns == stages[0].columns for d in stages[1:5])
    assert 0 < stages[5].count() < stages[0].count()


def test_toxicity_drops_what_is_predicted(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.toxicity(stages[0], labels).where("predicted = 1").collect()}
    assert bad and rows(stages[1].orderBy("doc_id")) == [x for x in rows(stages[0].orderBy("doc_id")) if x[0] not in bad]


def test_one_document_of_each_class_stays(stages):
    data = rows(stages[1])
    classes, _ = brute_classes(data)
    assert {x[0] for x in rows(stages[2])} == {i for i, root, _ in classes if root == i}


def test_repeated_words_go(stages):
    data = rows(stages[2])
    want = {k[0]: v for k, v in brute_dedup(data, 20).items()}
    got = {x[0]: x for x in rows(stages[3])}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    before = {x[0]: x for x in data}
    for i, x in got.items():
        n, gone, _ = want[i]
        assert len(plain_words(x[1])) == n - gone and (gone or x == before[i]) and x[4] == len(x[1])


def test_contaminated_documents_go(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for (i, _), v in brute_overlap(rows(stages[3]), items).items() if v[4]}
    assert hit and {x[0] for x in rows(stages[4])} == {x[0] for x in rows(stages[3])} - hit


def test_mix_of_what_is_left(spark, sf, stages):
    out = stages[5].collect()
    sizes = {x[0]: len(plain_words(x[1])) for x in rows(stages[4])}
    assert {r["doc_id"]: r["size"] for r in out} == sizes
    assert abs(sum(r["taken"] for r in out) - 1.5 * sum(sizes.values())) <= len({r["source"] for r in out})
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, out))


def test_workers_give_back_memory(spark, sf, monkeypatch):
    """Workers stay for the next stages, so all that read texts or sets give back what they held."""
    docs, run = spark.read.parquet(f"{sf}/documents.parquet"), []
    kinds = [(type(docs), "mapInArrow"), (type(docs.groupBy("doc_id")), "applyInPandas")]
    for kind, name in kinds:
        monkeypatch.setattr(kind, name, lambda self, f, *a, g=getattr(kind, name): run.append(f) or g(self, f, *a))
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, sf)
    assert {"least", "count", "features", "sign", "deal", "compare", "shingle", "verify", "collect", "decide", "gather", "emit", "subtree", "strip"} <= {f.__name__ for f in run}
    assert not [f.__qualname__ for f in run if "trim" not in f.__code__.co_names and f.__name__ != "choose"]  # counts of a bounded sample
