import pytest

import corpus_pipeline
from gridlume.llm.queries import ORACLES, QUERIES
from oracle import DATA, assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), connect(), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, DATA)
    table = {"op1": 50, "op10": 16}.get(name.split("_")[0], spark.read.parquet(f"{DATA}/documents.parquet").count())
    assert rows.count() == table


def test_stages_are_the_pipeline():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
