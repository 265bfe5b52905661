"""Ties, hot values and scratch tables."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotweave.operators.features import one_hot
from plotweave.operators.ranks import exact_median, numbered
from plotweave.session import cut, scratch_scope, shared_dir


def test_median_with_one_value_on_half_of_all_rows(spark):
    random = np.random.default_rng(2)
    frame = pd.DataFrame({"g": random.choice(["a", "b", "c"], 4000, p=[0.9, 0.09, 0.01]), "v": np.where(random.random(4000) < 0.5, 7.0, random.normal(7, 3, 4000).round(2))})
    frame = pd.concat([frame, pd.DataFrame({"g": ["one", "two", "two", "none"], "v": [3.0, 1.0, 2.0, None]})])
    got = {r["g"]: r["median"] for r in exact_median(spark.createDataFrame(frame.astype({"v": object}).where(frame.notna(), None).values.tolist(), "g string, v double"), "g", "v").collect()}
    want = frame.dropna().groupby("g")["v"].median().to_dict()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_positions_are_dense(spark):
    rows = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "at")
    assert [(r["k"], r["at"]) for r in rows.orderBy("at").collect()] == [(i, i) for i in range(1000)]


def test_scratch_tables_go_with_their_scope(spark):
    before = set(os.listdir(shared_dir(spark)))
    with scratch_scope(spark):
        kept = cut(spark.range(5)).agg(F.sum("id")).first()[0]
        assert len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert kept == 10 and set(os.listdir(shared_dir(spark))) == before


def test_one_hot_of_a_large_vocabulary(spark):
    values = [f"v{i:05d}" for i in range(3000)]
    got = spark.createDataFrame([("v00000",), ("v02999",), ("other",), (None,)], "c string").select(one_hot(F.col("c"), values).alias("h")).collect()
    assert [int(np.argmax(r["h"])) if sum(r["h"]) else None for r in got] == [0, 2999, None, None]
    assert all(len(r["h"]) == 3000 and sum(r["h"]) <= 1 for r in got)


def test_shuffles_follow_the_stored_tables(spark, tmp_path):
    from plotweave.session import size_shuffles

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        (tmp_path / "small.parquet").write_bytes(b"x")
        size_shuffles(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        with open(tmp_path / "large.parquet", "wb") as f:
            f.truncate(400 << 20)
        size_shuffles(spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 101
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
