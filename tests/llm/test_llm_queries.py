"""The registered queries against their SQL, and the pipeline against its stages' definitions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loglens.llm import queries
from loglens.llm.oracles import ORACLES
from tests.compare import difference, duck
from tests.llm.test_duplicates import brute_lines, brute_near
from tests.llm.test_filters import brute_scan

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, SMALL) is None


def test_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 14))


def test_pipeline(spark, documents):
    docs = documents
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == documents.columns
        held[name] = docs = out.cache()
    rows = {name: [tuple(r) for r in df.select("doc_id", "source", "text").collect()] for name, df in held.items()}
    first, second, third, fourth = rows.values()

    want = list(brute_lines([(i, s, t) for i, s, t in first]))
    assert sorted(second) == sorted((i, s, t) for i, s, _, t in want)

    near = brute_near([(i, t) for i, _, t in second])
    assert sorted(i for i, _, _ in third) == sorted({c for _, _, c in near})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [r[0] for r in brute_scan([(i, t) for i, _, t in third], items) if not r[5]]
    assert sorted(i for i, _, _ in fourth) == sorted(clean)

    mixed = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(clean)


def test_stages_with_odd_rows(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd.columns
            docs = docs.cache()
        total = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).agg(F.sum("taken"), F.sum("size")).first()
        assert (total[0] or 0) <= 2 * (total[1] or 0)
