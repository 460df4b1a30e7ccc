"""The streaming store: crashes between the phases, poison rows, repeated events."""

import pytest
from pyspark.sql import functions as F

from wayline.operators import events
from wayline.sources import publish, store


def make(spark, ids, kind="plate_read"):
    rows = spark.createDataFrame([("s7" if k % 2 else "007", "r", k, k, float(k), 86400.0 * (1 + k % 3) + k, "car", i) for k, i in enumerate(ids)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, wall_ts double, vehicle_class string, own string")
    return events.event(rows, kind, events.payload(plate=F.lit("34 abc 123"), confidence=F.lit(0.9))).drop("id").join(rows.select("track_id", F.col("own").alias("id")), "track_id")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("moves", [0, 1])
def test_a_batch_that_is_killed_while_it_is_published(spark, tmp_path, moves, monkeypatch):
    root, names = str(tmp_path / "store"), [f"e{k}" for k in range(12)]
    make(spark, names).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    real, left = publish.Files.move, [moves]

    def move(self, a, b):
        if not left[0]:
            raise Killed
        left[0] -= 1
        real(self, a, b)

    def run():
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        src.writeStream.foreachBatch(publish.StoreSink(root)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(publish.Files, "move", move)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(publish.Files, "move", real)
    run()
    assert ids(store.load(spark, f"{root}/events")) == sorted(names) and ids(store.load(spark, f"{root}/plates")) == sorted(names)
    assert store.event_filter(store.load(spark, f"{root}/events"), stream_id="007", until=86400.0 * 2).count() == 2
    # the same events in a later batch are stored already; new ones are not
    sink = publish.StoreSink(root)
    sink(make(spark, names + ["new"]), 1)
    sink(make(spark, names + ["new"]), 1)
    assert ids(store.load(spark, f"{root}/events")) == sorted(names + ["new"])
    assert store.purge(spark, f"{root}/events", "wall_ts", 86400.0 * 4, 2) > 0


def test_poison_rows_stand_alone(spark, tmp_path):
    root, names = str(tmp_path / "store"), [f"e{k}" for k in range(40)]
    bad = ["e7", "e31"]
    check = F.when(F.col("id").isin(bad), F.raise_error(F.lit("no such event"))).otherwise(F.lit(1)).cast("int")
    tables = {"events": lambda e: store.event_rows(e.withColumn("checked", check)), "plates": store.plate_rows}
    batch = make(spark, names + [None, None, "e3"]).cache()
    publish.StoreSink(root, tables)(batch, 0)
    good = sorted(set(names) - set(bad))
    assert ids(store.load(spark, f"{root}/events")) == good and ids(store.load(spark, f"{root}/plates")) == good
    found = publish.quarantined(spark, root).collect()
    assert sorted(r["id"] or "" for r in found) == ["", "", *sorted(bad)] and all("no such event" in r["reason"] or r["id"] is None for r in found)


def test_a_restart_goes_on_with_the_attempts(spark, tmp_path):
    root = str(tmp_path / "store")
    batch = make(spark, [f"e{k}" for k in range(6)]).cache()
    calls = []

    def build(e):
        calls.append(1)
        if len(calls) == 2:
            raise Killed  # the driver dies in the second attempt
        return store.event_rows(e.withColumn("checked", F.when(F.col("id") == "e1", F.raise_error(F.lit("bad"))).otherwise(F.lit(1)).cast("int")))

    with pytest.raises(Killed):
        publish.StoreSink(root, {"events": build})(batch, 3)
    assert publish.Files(spark, root).read(f"{root}/_stage/stream-3/attempts")["open"] == [["", 1]]
    publish.StoreSink(root, {"events": build})(batch, 3)
    assert ids(store.load(spark, f"{root}/events")) == ["e0", "e2", "e3", "e4", "e5"] and ids(publish.quarantined(spark, root)) == ["e1"]
