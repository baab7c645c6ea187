"""Every registered query gives the same answer on a folder of part files as on
one file."""

import os

import pytest

from scorecraft.plans import catalog
from scorecraft.session import prepare_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("folders"))
    for name in os.listdir(SMALL):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{SMALL}/{name}").repartition(3).write.parquet(f"{out}/{name}")
    return out


def rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_same_answer_on_a_folder(spark, folders, name):
    prepare_session(spark)
    assert rows(catalog.REGISTRY[name](spark, folders)) == rows(catalog.REGISTRY[name](spark, SMALL))
