import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture
def docs(spark):
    """``docs(rows, ...)``: a documents table of ``(doc_id, text)``, with an extra column."""
    def make(rows, id_type="long"):
        data = [(i, t, "x") for i, t in rows]
        return spark.createDataFrame(data, f"doc_id {id_type}, text string, score string")
    return make
