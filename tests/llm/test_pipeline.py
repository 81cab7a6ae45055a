"""Each stage of the pipeline against brute force on its own input."""

import collections

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as c
from tidemark.llm import toxicity
from tidemark.llm.common import materialise

from .test_ngram_join import brute
from .test_spans import private_spans

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, f in c.STAGES:
        out.append(materialise(f(spark, out[-1], DIR), f"test-{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scored = toxicity.score(stages[0], toxicity.fit(stages[0], labels))
    assert set(texts(stages[1])) == {r.doc_id for r in scored.where("predicted = 0").select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean & set(texts(stages[1]))) > 0.97 * len(clean)


def test_near_duplicates(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == {i for i, (_, comp) in brute(list(before.items())).items() if i == comp}
    assert all(after[i] == before[i] for i in after)


def test_private(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    found = {i: private_spans(t) for i, t in before.items()}
    assert any(found.values())
    for i, t in after.items():
        assert not private_spans(t)
        if not found[i]:
            assert t == before[i]


def test_mixed(stages):
    before, after = stages[3].collect(), stages[4].collect()
    assert collections.Counter(before) == collections.Counter(after)
    # Until the first source is used up, each has its share, give or take less than one block of 16.
    counts = collections.Counter(r.source for r in before)
    total = sum(n**0.5 for n in counts.values())
    for k in range(16, int(min(counts.values()) ** 0.5 * total) + 1, 16):
        own = collections.Counter(r.source for r in after[:k])
        assert all(abs(own[s] - k * n**0.5 / total) < 16 for s, n in counts.items())


def test_tokens(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before = texts(stages[4])
    rows = {r.doc_id: r for r in stages[5].collect()}
    assert set(rows) == set(before)
    for i, t in before.items():
        assert list(rows[i].ids) == lib.encode(t, add_bos=True, add_eos=True) and rows[i].n_tokens == len(rows[i].ids)


def odd(spark):
    """Documents with nulls in every column, empty and repeated rows, a very long text, ties and more columns."""
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    text = "please write to ann@corp.example or call about the harbour plan today"
    rows = [(1, text), (2, text), (2, text), (2, "another text of the second id"), (None, text), (3, None), (4, ""), (5, "lorem ipsum dolor " * 60_000), (6, "six words that stand here alone"), (7, "six words that stand here alone")]
    full = [{f.name: None for f in schema} | {"doc_id": i, "text": t, "_mark": "m", "row": "r"} for i, t in rows]
    more = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", _mark string, row string"
    return spark.createDataFrame([tuple(r.values()) for r in full], more)


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_stages_take_odd_and_empty_tables(spark, name, stage):
    docs = odd(spark)
    out = stage(spark, docs, DIR)
    got = out.collect()
    if name != "sentencepiece":
        assert out.columns == docs.columns and all(r._mark == "m" and r.row == "r" for r in got)
    ids = collections.Counter(r.doc_id for r in got)
    if name == "ngram_join":
        assert ids == {1: 1, None: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    else:
        assert ids == {1: 1, 2: 3, None: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    if name == "pii":
        assert not any("ann@" in (r.text or "") for r in got)
    assert stage(spark, docs.limit(0), DIR).count() == 0


def test_of_rows_that_repeat_an_id_the_same_stays(spark):
    rows = [(1, f"text number {i} of some words here {i}", i) for i in range(30)]
    kept = {c.near_duplicates(spark, spark.createDataFrame(x, "doc_id long, text string, n int").repartition(k), DIR).first() for k, x in ((1, rows), (3, rows[::-1]), (5, rows))}
    assert len(kept) == 1
