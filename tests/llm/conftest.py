import uuid

import pytest
from edge_cases import DOCS, edge_rows


@pytest.fixture(scope="session")
def scratch(tmp_path_factory):
    """A function that writes a DataFrame and gives its path."""

    def write(df, files: int = 2) -> str:
        path = str(tmp_path_factory.mktemp("llm") / uuid.uuid4().hex)
        df.repartition(files).write.parquet(path)
        return path

    return write


@pytest.fixture(scope="session")
def edge(spark, scratch):
    """The edge documents as a file-backed table with columns of names that the
    operators use themselves."""
    df = spark.createDataFrame(edge_rows(), DOCS)
    for name in ("size", "label", "node", "ids", "votes", "kept", "shard", "__text", "__text2", "__file", "__row", "__id", "__size", "__h", "__c0"):
        df = df.selectExpr("*", f"n_chars AS `{name}`")
    return spark.read.parquet(scratch(df))


@pytest.fixture(scope="session")
def empty(spark, scratch):
    return spark.read.schema(DOCS).parquet(scratch(spark.createDataFrame([], DOCS), 1))
