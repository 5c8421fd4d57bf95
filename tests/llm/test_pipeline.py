"""The whole pipeline against plain versions of its stages."""

import hashlib
import random

import plain
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from evalspark.llm import cleaning
from evalspark.llm.bpe import read_ranks

SF_DIR = "/root/testdata/sf0.001"


def plain_pipeline(documents, benchmark):
    """doc_id -> text after the four filtering stages."""
    judged = zip(*cleaning.judge([t for _, t in documents], cleaning.Rules()))
    names = list(cleaning.FIELDS)
    docs = []
    for (key, text), row in zip(documents, judged):
        verdict = dict(zip(names, row))
        assert verdict["base_failed"] == plain.base_counts(text)[5]
        if verdict["kept"]:
            docs.append((key, verdict["cleaned"]))
    after = []
    for (key, old), (_, new) in zip(docs, plain.drop_recurring(docs)):
        if new == old or new.strip():
            after.append((key, new))
    component = plain.near_components(after)
    after = [(k, t) for k, t in after if component[k] == k]
    words = lambda t: [w.strip(".,") for w in t.lower().split()]
    windows = lambda t: {tuple(words(t)[i : i + 8]) for i in range(len(words(t)) - 7)}
    asked = [windows(t) for t in benchmark]
    clean = []
    for key, text in after:
        own = windows(text)
        if not any(a and len(a & own) >= min(6, -(-len(a) // 2)) for a in asked):
            clean.append((key, text))
    return dict(clean)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given documents with planted copies, near copies, leaks, null and empty texts."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rng = random.Random(17)
    rows = [tuple(r) for r in given.collect()]
    items = [r.text for r in benchmark.collect()]
    clean = [r for r in rows if 60 < len((r[1] or "").split()) < 400][:40]
    extra = []
    for i, (_, text, lang, source, _) in enumerate(clean):
        words = text.split(" ")
        words[rng.randrange(len(words))] = "qxzw."
        planted = [text, " ".join(words), f"{text}\n{items[i % len(items)]}"][i % 3]
        extra.append((900_000 + i, planted, lang, source, len(planted)))
    extra += [(910_000, None, "en", "s", 0), (910_001, "", "en", "s", 0)]
    both = spark.createDataFrame(rows + extra, given.schema)
    both.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder, [r[:2] for r in rows + extra], items


def test_stages(spark, tables, tmp_path):
    folder, documents, items = tables
    expected = plain_pipeline(documents, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.dtypes == columns, name
            assert docs.where("n_chars != length(text)").isEmpty()
            last = {r.doc_id: r.text for r in docs.collect()}
    assert last == expected
    ranks = dict(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    found = {r.doc_id: r for r in docs.collect()}
    assert found.keys() == expected.keys()
    for key, text in expected.items():
        assert found[key].ids == library.encode_ordinary(text)
        assert found[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not any(900_000 <= k < 900_040 for k in expected)  # every planted copy and leak is gone


def test_lines_outlive_their_copies(spark):
    shared = ["one line that three documents have in full", "another line that they have in common", "short one"]
    rows = [
        (1, "\n".join([*shared, "only the first says this"])),
        (2, "\n".join([*shared, "kept for the third", "a sentence of its own in the second"])),
        (3, "\n".join(["kept for the third", shared[0]])),
        (4, "\n".join(shared)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {1: rows[0][1], 2: "kept for the third\na sentence of its own in the second"}


def test_run(spark, tables):
    folder, documents, items = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == plain_pipeline(documents, items).keys()


def test_extra_columns_come_along(spark, tmp_path):
    text = "\n".join(f"{a} river {b} stone {c} window {a}{b} harbour." for a, b, c in zip("abcdefgh" * 3, "ijklmnopqrstuvwx", "yzabcdefghijklmn"))
    rows = [(1, text, "n", "d"), (2, text, "n", "d"), (3, None, "n", "d"), (None, "", "n", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string, doc string")
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        found = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert [r.doc_id for r in found.collect()] == ([1] if some is docs else [])
