from __future__ import annotations

import pytest

import llm.edge as edge


@pytest.fixture(scope="session")
def edges(spark):
    return edge.docs(spark)


@pytest.fixture(scope="session")
def none(spark):
    return edge.empty(spark)
