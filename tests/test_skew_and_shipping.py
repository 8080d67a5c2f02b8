"""Balanced joins with hot and null keys, scratch tables, and the package on workers that lack it."""

import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.operators import skew
from linkloom.sources.lineage import Scratch
from linkloom.sources.shipping import ship


@pytest.mark.parametrize(("hot_rows", "how"), [(10, "left"), (300, "inner"), (10**9, "left")])
def test_hot_and_null_keys(spark, hot_rows, how):
    left = spark.range(1000).select(
        F.col("id").alias("i"), F.when(F.col("id") < 400, 1).when(F.col("id") < 700, None).otherwise(F.col("id")).alias("k")
    )
    right = spark.createDataFrame([(1, "one"), (800, "x"), (None, "never")], "k long, v string")
    got = skew.skew_join(left, right, ["k"], ["i"], how, hot_rows, 8)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_null_and_hot_rows_are_spread(spark, monkeypatch):
    """Salts of the rows just before the join, seen through a join that keeps them."""
    salts = {}
    plain = type(spark.range(1)).join

    def watched(self, other, on=None, how=None):
        if isinstance(on, list) and "_salt" in on:
            salts["n"] = [tuple(r) for r in self.groupBy("k").agg(F.countDistinct("_salt")).collect()]
        return plain(self, other, on, how)

    monkeypatch.setattr(type(spark.range(1)), "join", watched)
    left = spark.range(900).select(F.col("id").alias("i"), F.when(F.col("id") < 300, 1).when(F.col("id") > 400, None).otherwise(F.col("id")).alias("k"))
    skew.skew_join(left, spark.createDataFrame([(1, "v")], "k long, v string"), ["k"], ["i"], "left", 100, 8).count()
    counts = dict(salts["n"])
    assert counts[1] == counts[None] == 8 and counts[350] == 1


def test_number_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 4)
    left = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("i"))
    right = spark.range(100).select(F.col("id").alias("k"))
    assert skew.skew_join(left, right, ["k"], ["i"], "inner", 1, 8).count() == 1000


def test_scratch_goes_when_the_job_ends(spark):
    with Scratch(spark) as scratch:
        rows = scratch.keep(spark.range(10))
        folder = Path(rows.inputFiles()[0].removeprefix("file://")).parent.parent
        assert rows.count() == 10 and folder.exists()
    assert not folder.exists()


def test_archive_imports_alone(spark, tmp_path):
    archive = ship(spark)
    names = zipfile.ZipFile(archive).namelist()
    assert "linkloom/__init__.py" in names and "linkloom/functions/analysis.py" in names
    code = f"import sys; sys.path.insert(0, {archive!r}); import linkloom.functions.analysis as a; print(a.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert archive in out.stdout
