"""Each stage on nulls, repeated rows, ties, empty tables and clashing names, against a plain version."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import plain_line_dedup, prose

EXTRA = "gone long, text_hash long, n_removed long, text_key string, hit_id long, hit_key string, id long, t long, class long, component long, score double, row long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def make(spark, rows):
    extra = (1, 2, 3, "k", 5, "h", 7, 8, 9, 10, 0.5, 12)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in rows], SCHEMA)


ITEM = prose(30, 900)


def rows():
    base = prose(120, 901)
    near = base.split()
    near[60] = "changed"
    toxic = [(i, prose(40, i) + (" vilest " if i % 3 == 0 else " ") + prose(5, i + 5000)) for i in range(1000, 1120)]
    return [
        (1, base), (1, base), (1, prose(60, 902)), (2, " ".join(near)), (3, None), (None, prose(50, 903)), (None, None), (4, ""), (5, " \n "),
        (6, "first line of the text\nsecond line, another one"), (7, "second line, another one\nthird line is its own"), (8, prose(20, 904) + " " + ITEM + " x"),
        (9, prose(12_000, 905)), (10, "second line, another one"), *toxic,
    ]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows() if i and i >= 1000] + [(None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x y"), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def texts(df):
    return sorted((str(r.doc_id), r.text) if r.text is not None else (str(r.doc_id), "\0") for r in df.collect())


def key(pairs):
    return sorted((str(i), "\0" if t is None else t) for i, t in pairs)


def test_toxicity_stage(spark, folder):
    out = corpus_pipeline.reject_toxic(spark, make(spark, rows()), folder)
    assert out.columns == corpus_pipeline.COLUMNS
    assert texts(out) == key((i, t) for i, t in rows() if not (i and i >= 1000 and i % 3 == 0))


def test_line_dedup_stage(spark, folder):
    given = [r for r in rows() if not (r[0] and r[0] >= 1000)]
    out = corpus_pipeline.dedup_lines(spark, make(spark, given), folder)
    assert out.columns == corpus_pipeline.COLUMNS
    # equal rows are one document, so the plain version sees each once
    order = sorted(dict.fromkeys(given), key=lambda r: (r[0] is not None, r[0] or 0))
    got = texts(out)
    kept, _, _ = plain_line_dedup(order)
    whole = [(i, k) for (i, t), k in zip(order, kept) if k == t or k.strip()]
    # which of the texts under one id comes first is a matter of their hash
    assert [x for x in sorted(set(got)) if x[0] != "1"] == [x for x in key(whole) if x[0] != "1"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_dedup_stage(spark, folder):
    given = [r for r in rows() if not (r[0] and r[0] >= 1000)]
    out = corpus_pipeline.near_dedup(spark, make(spark, given), folder)
    assert out.columns == corpus_pipeline.COLUMNS
    want = list(given)
    want.remove(given[0])  # one of two equal rows
    want.remove(given[3])  # the near copy
    assert texts(out) == key(want)


def test_decontamination_stage(spark, folder):
    out = corpus_pipeline.decontaminate(spark, make(spark, rows()), folder)
    assert out.columns == corpus_pipeline.COLUMNS and texts(out) == key(r for r in rows() if r[0] != 8)


def test_packing_stage(spark, folder):
    out = corpus_pipeline.pack(spark, make(spark, rows()), folder).collect()
    assert sorted({str(r.doc_id) for r in out}) == sorted({str(i) for i, _ in rows()})
    assert sum(r.piece == 0 for r in out) == len(rows())


def test_stages_of_an_empty_table(spark, folder):
    docs = make(spark, rows()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        assert docs.count() == 0


def test_pipeline_stages_in_order(spark, sf):
    names = ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() <= before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.select("doc_id").distinct().count() == docs.count() > before * 0.5
