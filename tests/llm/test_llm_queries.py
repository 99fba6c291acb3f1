import pytest
from compare import differences, duck

import __spark_entry__
from dwelltail import llm


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_matches_sql(spark, small, name):
    assert differences(spark, duck(small), name, llm.QUERIES[name], llm.ORACLES[name], small) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
