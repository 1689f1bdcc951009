"""Pending decisions of a stream: the newest ones are kept, decided ones leave.

Decisions are dealt over ``slots`` by their id, so no task sees them all; a slot holds at most ``most`` rows of
state, whatever the stream brings, and each micro-batch writes the slots that it touched anew.  The newest ``most``
of all slots are the answer.

A row of status ``pending`` enters unless a decision on its id is known or rows as old were pushed out before;
any other status (null too) is a decision.  Pending rows of a micro-batch enter first, then its decisions take effect.  What was pushed
out stays out, as in a queue.  So sending rows again changes nothing, and how the stream was cut matters only where decisions
are made on rows of a slot that was full.  Decisions are remembered for ``remember``, for pending rows that come
later than the decision.  Of pending rows with the same id the newest counts; rows without an id or a time are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..operators.memory import PENDING_LIMIT

SLOTS, REMEMBER_MS = 64, 24 * 3600 * 1000
#: This kind of state needs the store; without the second, each trigger runs an empty batch to look for expired state.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
KEPT = "slot int, id long, created long, row string"
MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class _Newest(StatefulProcessor):
    """State of a slot: its rows, the place of the newest row pushed out, and the ids decided with the time of their batch."""

    def __init__(self, most: int, remember_ms: int) -> None:
        self.most, self.remember_ms = most, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "id long, created long, row string")
        self.floor = handle.getValueState("floor", "created long, id long")
        self.decided = handle.getMapState("decided", "id long", "at long", self.remember_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        now = timers.getCurrentProcessingTimeInMs()
        kept = {r[0]: (r[1], r[2]) for r in self.rows.get()}
        order = [(created, i) for i, (created, _) in kept.items()]
        heapq.heapify(order)
        floor = tuple(self.floor.get()) if self.floor.exists() else None
        before, first = dict(kept), floor
        for r in rows:
            if r.status != "pending":
                if not self.decided.containsKey((r.id,)):
                    self.decided.updateValue((r.id,), (now,))
                continue
            place, known = (r.created, r.id), kept.get(r.id)
            if (floor and place <= floor) or (known and known >= (r.created, r.row)):
                continue
            if known is None and self.decided.containsKey((r.id,)) and self.decided.getValue((r.id,))[0] < now:
                continue
            kept[r.id] = (r.created, r.row)
            if known is None or known[0] != r.created:
                heapq.heappush(order, place)
            while len(kept) > self.most:
                created, i = heapq.heappop(order)
                if i in kept and kept[i][0] == created:  # else the place of an older row of this id
                    del kept[i]
                    floor = (created, i)
        for i in [i for i in kept if self.decided.containsKey((i,))]:
            del kept[i]
        if floor != first:
            self.floor.update(floor)
        if kept == before:
            return
        if kept:
            self.rows.put([(i, created, row) for i, (created, row) in kept.items()])
        else:
            self.rows.clear()
        yield Row(slot=key[0], id=None, created=None, row=None)  # says that the slot was written, if with no rows
        for i, (created, row) in kept.items():
            yield Row(slot=key[0], id=i, created=created, row=row)

    def close(self) -> None:
        pass


def newest_pending(decisions: DataFrame, most: int = PENDING_LIMIT, *, slots: int = SLOTS, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """The stream of :data:`KEPT` rows: all rows of a slot whenever they change.  ``decisions`` is a stream with ``id, status, created_at``
    and any other columns, which ``row`` holds as JSON."""
    time = F.col("created_at") if isinstance(decisions.schema["created_at"].dataType, TimestampNTZType) else F.to_utc_timestamp("created_at", F.current_timezone()).cast("timestamp_ntz")
    rows = decisions.select(
        F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(slots)).cast("int").alias("slot"), F.col("id").cast("long").alias("id"), F.coalesce("status", F.lit("")).alias("status"),
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time).alias("created"), F.to_json(F.struct("*"), MICROS).alias("row"),
    )
    rows = rows.filter("id is not null and (status <> 'pending' or created is not null)")
    return rows.groupBy("slot").transformWithState(_Newest(most, remember_ms), KEPT, "Update", "ProcessingTime")


def keep_pending(decisions: DataFrame, path: str, checkpoint: str, *, trigger: dict[str, object] | None = None, **options) -> StreamingQuery:
    """Start the query that keeps the newest pending rows of a stream at ``path``, one folder for each slot.

    A micro-batch that runs again writes the same folders with the same rows."""
    spark = decisions.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)

    stream = newest_pending(decisions, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return stream.trigger(**(trigger or {"processingTime": "2 seconds"})).start()  # a query keeps the settings of its start
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_pending(spark: SparkSession, path: str, schema: str, most: int = PENDING_LIMIT) -> DataFrame:
    """The newest ``most`` pending rows that a query of :func:`keep_pending` has written, with the columns of ``schema``."""
    kept = spark.read.schema("id long, created long, row string, slot int").parquet(path).filter("id is not null")
    newest = kept.orderBy(F.desc("created"), F.desc("id")).limit(most)
    return newest.select(F.from_json("row", schema, MICROS).alias("r")).select("r.*")
