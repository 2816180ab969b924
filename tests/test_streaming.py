"""Streams give what the batch jobs give."""

from hustings.operators import engagement
from hustings.streaming import live

SCHEMA = "event_id long, uid string, item_id string, reaction string, ts timestamp"


def _stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))


def test_live_counts(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    kinds = engagement.REACTIONS
    rows = [(i, f"u{i % 3}", f"i{i % 2}", kinds[(i * 7) % 3], t + dt.timedelta(seconds=i)) for i in range(30)]
    stream = live.live_counts(live.live_deltas(_stream(spark, tmp_path, rows)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {r.item_id: [r[k] for k in kinds] for r in spark.table("counts").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = engagement.counter_sums(engagement.reaction_deltas(spark.createDataFrame(rows, SCHEMA)))
    assert got == {r.item_id: [r[k] for k in kinds] for r in want.collect()}
