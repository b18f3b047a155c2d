from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    def make(rows, extra=()):
        """Documents (doc_id, text) with columns named like results, if asked for."""
        names = ["doc_id", "text", *extra]
        schema = ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names)
        return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)

    return make
