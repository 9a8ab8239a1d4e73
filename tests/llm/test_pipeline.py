"""The corpus pipeline, stage by stage, on the smallest table."""

import collections

import corpus_pipeline
from mosaiq.llm import bpe, jaccard, mixing
from mosaiq.llm.common import read, stored
from mosaiq.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "encoding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF))
        seen[name] = (before, docs)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
    before, after = seen["language"]
    assert after.count() == before.where(r"text rlike '\\p{L}'").count()  # nothing here is like no language
    before, after = seen["lines"]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["near_duplicates"]
    kept = {r.doc_id for r in jaccard.similar_documents(before).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["mixing"]
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_odd_documents_pass_all_stages(spark, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = stored(stage(spark, docs, SF))
    assert docs.count() > 0


def test_rows_are_told_apart_without_ids(spark, frame):
    long_text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long_text), (None, long_text + " more"), (None, "a clean row that resembles nothing else at all"), (1, "another clean row with the id of a copied one"),
            (2, "two equal rows of one id and one text"), (2, "two equal rows of one id and one text"), (None, "no ids in this group of rows"), (None, "no ids in this group of rows")]
    docs = stored(frame([(k, t, "en", "a") for k, t in rows]).select(*corpus_pipeline.COLUMNS).repartition(3))
    left = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    order = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=order) == sorted([rows[0], *rows[2:5], rows[6]], key=order)
    many = stored(frame([(None, f"text {k} of some words " * (1 + k % 3), "en", "abc"[k % 3]) for k in range(300)]).select(*corpus_pipeline.COLUMNS))
    want = collections.Counter()
    for r in mixing.mix_sources(many, carry=("text",)).collect():
        want[r.text] += r.copies
    got = collections.Counter(r.text for r in corpus_pipeline.mixing_stage(spark, many, SF).collect())
    assert got == +want and sum(got.values()) > 0


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline") == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert bpe.FOLD_BYTES > 0
