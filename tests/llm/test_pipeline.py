import os
from collections import Counter

import pytest

import corpus_pipeline
from studyloom.llm import toxicity
from studyloom.llm.common import table
from workload.check import checker, compare

from studyloom.llm.queries import CHECKS, QUERIES
from llm.test_minhash import brute as near_brute
from llm.test_substring_dedup import brute as cut_brute
from llm.test_decontaminate import brute as leak_brute

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_queries_agree_with_their_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), checker(FOLDER), CHECKS[name])[0] == ""


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@needs_data
def test_run_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scored = toxicity.severity(docs, toxicity.train(docs, table(spark, FOLDER, "labels")))
    left = [(r.doc_id, rows[r.doc_id].text) for r in scored.collect() if r.p_toxic < corpus_pipeline.TOXIC]
    left = [(d, t) for (d, t), (_, _, c) in zip(left, near_brute(left, 5, 80)) if c == d]
    cut = {d: (n, t) for d, _, n, t in cut_brute(left, 35)}
    kept = [(d, t if not cut[d][0] else cut[d][1]) for d, t in left]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    leaks = {d for d, *_ in leak_brute(kept, items, 5, 80)}
    want = {d: " ".join((t or "").encode().decode().split(" ")) for d, t in kept if d not in leaks}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert (r.text or "").encode().split() == want[r.doc_id].encode().split()
        assert r.rate >= 1 and r.n_chars == (len(r.text) if cut[r.doc_id][0] else rows[r.doc_id].n_chars)
    copies = Counter(r.doc_id for r in got)
    assert all(int(r.rate) <= copies[r.doc_id] <= int(r.rate) + 1 for r in got)
    assert {(r.doc_id, r.copy) for r in got} == {(d, k + 1) for d, n in copies.items() for k in range(n)}


def test_stages_stand_odd_tables(spark, documents, awkward, tmp_path):
    folder = f"{tmp_path}/sf0"
    docs = documents([*enumerate(awkward), (None, None), (None, "x"), (0, None), (3, "one"), (90, "you awfulword")])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {None, *range(len(awkward)), 90}
    assert out.columns == [*corpus_pipeline.COLUMNS, "domain", "rate", "copy"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0).drop("hash"), folder)
        assert empty.columns == corpus_pipeline.COLUMNS and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0).drop("hash"), folder).count() == 0


@pytest.fixture
def folder(spark, tmp_path, prose):
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 7))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def left_by(stage, spark, docs, folder):
    return Counter((r.doc_id, r.text) for r in stage(spark, docs.drop("hash"), folder).collect())


def test_verdicts_hold_for_rows_without_an_id_and_of_repeated_ids(spark, documents, folder, prose):
    bad, good = "you awfulword", "you kindword"
    taught = [(100 + i, bad if i % 2 else good) for i in range(60)]
    rows = [(None, bad), (None, good), (5, bad), (5, good)]
    kept = left_by(corpus_pipeline.drop_toxic, spark, documents(taught + rows), folder)
    assert kept == Counter([r for r in taught + rows if r[1] == good])
    leak, plain = prose(20, 8) + " " + prose(30, 7), prose(40, 9)
    rows = [(None, leak), (None, plain), (5, leak), (5, plain), (None, None)]
    assert left_by(corpus_pipeline.drop_leaks, spark, documents(rows), folder) == Counter([(None, plain), (5, plain), (None, None)])


def test_one_row_of_each_group_stays_whatever_the_ids(spark, documents, folder, prose):
    a, b, c, d = (prose(60, 20 + n) for n in range(4))
    rows = [(5, a), (5, b), (3, b + " tail"), (None, b), (None, c), (None, c), (None, c + " tail"), (8, d), (8, d + " tail"), (8, d), (2, ""), (None, None)]
    kept = left_by(corpus_pipeline.near_dedup, spark, documents(rows), folder)
    assert max(kept.values()) == 1
    assert {r for r in kept if r[1] not in (c, c + " tail", d, d + " tail")} == {(5, a), (3, b + " tail"), (2, ""), (None, None)}
    assert sum(i is None and t in (c, c + " tail") for i, t in kept) == 1 and sum(i == 8 for i, _ in kept) == 1
