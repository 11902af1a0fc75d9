"""The corpus pipeline: stages in order, their decisions, the columns; queries registered."""

import corpus_pipeline
import pytest
from conftest import SF_SMALL

from loomstat.llm.common import Scratch
from loomstat.llm.minhash_join import near_duplicates
from loomstat.llm.mixing import mixture
from loomstat.llm.queries import ORACLES, QUERIES

pytest.importorskip("public_tokenizers")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", "en", "src0", 5)], docs.schema)
    scratch = Scratch(spark, "test")
    docs = scratch.pin(docs.unionByName(odd))
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.pin(stage(spark, docs, SF_SMALL))
        kept.append(docs.count())
        if name == "language_id":
            assert kept[-1] == before.count() - 2
        elif name == "near_dedup":
            assert kept[-1] == near_duplicates(before).where("first").count() == near_duplicates(before).select("component_id").distinct().count()
            assert near_duplicates(docs).where("NOT kept").count() == 0
        elif name == "secret_scan":
            assert kept[-1] == before.count() and docs.where(r"regexp_like(text, 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}')").count() == 0
        elif name == "source_mix":
            assert kept[-1] == mixture(before).where("size > 0").groupBy().sum("copies").first()[0]
        if name != "packing":
            assert docs.columns == names
    pieces = docs.selectExpr("count(distinct doc_id) d", "sum(length) n").first()
    assert pieces["d"] == before.select("doc_id").distinct().count()
    assert docs.where("start = 0").selectExpr("sum(doc_tokens) n").first()["n"] == pieces["n"]


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, "", "en", None, 0)]])
def test_stages_on_empty_and_null_rows(spark, rows):
    scratch = Scratch(spark, "test-empty")
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _rid string, size int")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_dedup" and rows:  # a later stage's own input, not only what the first one leaves
            docs = spark.createDataFrame([(*r, "x", None) for r in rows], docs.schema)
        docs = scratch.pin(stage(spark, docs, SF_SMALL))
        assert docs.columns == names or name == "packing"
    assert docs.count() == 0  # nothing has words to mix


def test_each_stage_keeps_clashing_columns(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(i, f"{text} {i}" if i % 4 else text, "en", f"s{i % 2}", 60, "r", 1, 2, "c", True) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, h int, copies int, hash string, kept boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString() and 0 < out.count() <= 48, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).select("doc_id").distinct().count() == 24
