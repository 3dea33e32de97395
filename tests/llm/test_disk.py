"""Disk that chains of queries take."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filigree.llm import common


def shuffled(spark) -> int:
    """Bytes of shuffle files that this machine holds."""
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data"))


@pytest.mark.parametrize("step", ["cut", "written"])
def test_a_chain_of_queries_gives_back_the_shuffle_files_of_the_finished_ones(spark, monkeypatch, step):
    monkeypatch.setattr(common, "RELEASE_S", 0.0, raising=False)
    rows = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.xxhash64("id").alias("x"))
    before = shuffled(spark)
    made = common.cut(rows.repartition(8, "k")) if step == "cut" else common.written(rows.repartition(8, "k"), "rows")
    end = time.monotonic() + 10
    while shuffled(spark) > before + 100_000 and time.monotonic() < end:
        common.cut(spark.range(10).toDF("k"))
    assert shuffled(spark) <= before + 100_000
    assert made.count() == 200_000
