import hashlib
from collections import Counter

import public_tokenizers
import pytest
from odd_rows import ODD
from test_simhash_dedup import ascii_lower, roots, slow_fingerprint

import __spark_entry__
import corpus_pipeline
from vertexloom.functions.shared import materialize, shared_dir
from vertexloom.llm import bpe, exact_dedup, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        left = Counter(r.doc_id for r in after)
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
            assert left == Counter(r.doc_id for r in before if r.doc_id not in gone)
        elif name == "exact_dedup":
            assert left == Counter(r.doc_id for r in exact_dedup.exact_duplicates(docs).collect() if r.kept)
        elif name == "simhash_near_dedup":
            assert left == Counter({r.component_id for r in simhash.near_duplicates(docs).collect()})
        else:
            assert left == +Counter({r.doc_id: r.copies for r in mixing.mixing_plan(docs).collect()})
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    ran = corpus_pipeline.run(spark, SF)
    digest = lambda df: Counter(hashlib.sha256(str((r.doc_id, r.ids)).encode()).hexdigest() for r in df.collect())
    assert digest(ran) == digest(last)


@pytest.mark.parametrize("n", range(1, 11))
def test_a_query_for_each_operator(n):
    assert [q for q in __spark_entry__.queries() if q.startswith(f"op{n}_")]


def test_sources_of_the_registry():
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def folder(spark, path, rows):
    """A folder of documents with more columns than usual, of names that the stages use themselves, and labels."""
    docs = spark.createDataFrame([(r[0], r[1], "en", r[3] if len(r) > 3 else "s", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS size", "'x' AS fp", "'y' AS digest", "3 AS _row", "4 AS _file", "'z' AS score", "true AS kept", "5 AS ordinal", "6 AS d", "7 AS _path")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_through_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, ties and repeated rows, with clashing names; toxicity has nothing to learn from and rejects none."""
    sf = folder(spark, tmp_path, [*ODD, *((50 + i, f"one two three {'four ' * i}", "en", "s" if i % 3 else None) for i in range(40))])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.schema.names == docs.schema.names
        before, after = docs.collect(), out.collect()
        if name == "toxicity":
            assert Counter(map(str, before)) == Counter(map(str, after))
        elif name == "exact_dedup":
            greatest = {}
            for r in before:
                greatest[ascii_lower(r.text)] = max(greatest.get(ascii_lower(r.text), -1), -1 if r.doc_id is None else r.doc_id)
            assert Counter((ascii_lower(r.text), -1 if r.doc_id is None else r.doc_id) for r in after) == Counter(greatest.items())
        elif name == "simhash_near_dedup":
            fps = {(r.doc_id, r.text): slow_fingerprint(r.text) for r in before}
            linked = roots(set(fps.values()), [(a, b) for a in fps.values() for b in fps.values() if (a ^ b).bit_count() <= 3])
            assert Counter(linked[fps[r.doc_id, r.text]] for r in after) == Counter(set(linked.values()))
        else:
            assert all(n <= 2 for n in Counter(map(str, after)).values())
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert set(last.columns) == {*docs.columns, "ids"}
    assert all(bpe.decode_ids(MULTI, r.ids) == (r.text or "").encode() for r in last.collect())
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_an_empty_table_through_every_stage(spark, tmp_path):
    sf = folder(spark, tmp_path, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_run_leaves_one_table(spark, tmp_path):
    """Of all that the stages write only what the last one reads is left."""
    import os

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and next(iter(left)).startswith("mixing-")
