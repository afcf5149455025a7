import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import reference  # noqa: E402

from siftstone.session import shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    shared_dir(spark)
    return spark.createDataFrame(reference.awkward(), reference.DOCS)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
