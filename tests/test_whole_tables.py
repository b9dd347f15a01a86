"""Registered queries without SQL take in every row of their table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.plans import registry

registry.load()
SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no tables")


def files(spark, name):
    return {r[0] for r in registry.QUERIES[name](spark, str(SMALL)).select("file").distinct().collect()}


def test_all_signals_are_normalized(spark):
    wanted = {r[0] for r in registry.table(spark, str(SMALL), "embeddings").select("vec_id").collect()}
    assert files(spark, "m16_pcen") == wanted


def test_all_signals_of_known_labels_are_training_samples(spark):
    known = registry.table(spark, str(SMALL), "embeddings").where(F.col("label") != 9)
    assert files(spark, "x5_training_samples") == {r[0] for r in known.select("vec_id").collect()}
