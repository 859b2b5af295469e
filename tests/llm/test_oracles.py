"""The queries of the subpackage that SQL can express, against their SQL."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle

from tracelens.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.duck(SF), registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""
