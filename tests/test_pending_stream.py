"""Pending decisions of a stream against the table operator, however the stream is cut."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import memory
from tarn.streaming import pending

SCHEMA = "id long, title string, status string, created_at timestamp_ntz"
START = dt.datetime(2024, 3, 1, 12, 0, 0, 123456)


def row(i, status="pending", minute=None):
    return (i, f"d{i}", status, START + dt.timedelta(minutes=i if minute is None else minute))


def run(spark, folder, batches, most, slots=4):
    """Feed each batch as one file, one micro-batch each; start the query anew for each of them."""
    (folder / "in").mkdir()
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        query = pending.keep_pending(stream, f"{folder}/out", f"{folder}/checkpoint", trigger={"availableNow": True}, most=most, slots=slots)
        query.awaitTermination(120)
        assert query.exception() is None
    return sorted(map(tuple, pending.read_pending(spark, f"{folder}/out", SCHEMA, most).collect()))


@pytest.mark.parametrize("cuts", [1, 3])
def test_same_rows_as_the_table_however_it_is_cut(spark, tmp_path, cuts):
    rows = [row(i, "approved" if i % 5 == 0 else "pending", i // 3) for i in range(120)]
    rows += [(None, "no id", "pending", START), (7000, "no time", "pending", None), (7001, None, None, START)]
    random.Random(cuts).shuffle(rows)
    found = run(spark, tmp_path, [rows[k::cuts] for k in range(cuts)], most=20)
    table = memory.retain_pending(spark.createDataFrame([r for r in rows if r[0] is not None and r[3]], SCHEMA), 20).filter("status = 'pending'")
    assert found == sorted(map(tuple, table.collect())) and len(found) == 20


def test_rows_sent_again_decisions_and_rows_pushed_out(spark, tmp_path):
    first = [row(i) for i in range(6)]
    # one slot that holds four rows: 0 and 1 are pushed out
    batches = [first, first, [row(3, "approved"), row(9, "rejected")], [row(0), row(3), row(9)], [row(10)]]
    found = run(spark, tmp_path, batches, most=4, slots=1)
    assert [r[0] for r in found] == [2, 4, 5, 10]
    assert found[0] == row(2)  # with the microseconds of its time
    assert all(spark.conf.get(name) != value for name, value in pending.SETTINGS.items())


def test_an_edited_row_counts_once_and_a_slot_can_become_empty(spark, tmp_path):
    found = run(spark, tmp_path, [[row(1), row(2)], [row(1, minute=50), row(3)], [row(1, "approved"), row(2, "approved"), row(3, "approved")]], most=2, slots=1)
    assert found == []
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("id").isNull()).count() == 1
