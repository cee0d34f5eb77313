"""A live feed gives the messages that the batch reader gives, over several micro-batches."""

from fairlead.sources import nmea
from fairlead.streaming import feed
from pyspark.sql import functions as F
from test_engine import SENTENCES


def test_feed_equals_batch(spark, tmp_path):
    lines = SENTENCES.splitlines() * 2
    (tmp_path / "in").mkdir()
    for k, part in enumerate((lines[:3], lines[3:7], lines[7:])):  # a packet is cut between files
        (tmp_path / f"in/{k}.txt").write_text("\n".join(part) + "\n")
        import os

        os.utime(tmp_path / f"in/{k}.txt", (1_700_000_000 + 10 * k,) * 2)
    (tmp_path / "all.ais").write_text("\n".join(lines) + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in").select(F.lit("s").alias("source"), "value")
    query = feed.messages(stream).writeStream.format("memory").queryName("feed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    keys = ["msg_type", "mmsi", "ts_ms", "sog", "name", "ship_type"]
    got = sorted(map(str, spark.table("feed").select(*keys).collect()))
    want = sorted(map(str, nmea.messages(nmea.packets(nmea.read_lines(spark, f"file://{tmp_path}/all.ais"))).select(*keys).collect()))
    assert got == want and len(got) == 4


def test_repeats_of_receivers_go_wherever_borders_lie(spark):
    rows = [("a", 1, 9_900, 7, 1.0), ("b", 1, 10_100, 7, 1.0), ("b", 2, 19_899, 7, 1.0), ("b", 3, 19_900, 7, 1.0), ("b", 4, 10_000, 7, 2.0), ("b", 5, 10_050, 8, 1.0), ("b", 6, None, 8, 1.0)]
    made = spark.createDataFrame([], nmea.MESSAGE_SCHEMA)
    frame = made.unionByName(spark.createDataFrame(rows, "file string, seq long, ts_ms long, mmsi int, lat double"), allowMissingColumns=True)
    got = sorted((r["file"], r["seq"]) for r in nmea.distinct_messages(frame).collect())
    assert got == [("a", 1), ("b", 3), ("b", 4), ("b", 5)]


def test_stream_without_repeats(spark, tmp_path):
    base = spark.createDataFrame([], nmea.MESSAGE_SCHEMA)
    for k, rows in enumerate(([("a", 1, 9_900, 7, 1.0)], [("b", 1, 10_100, 7, 1.0), ("b", 2, 10_200, 7, 3.0)], [("c", 1, 60_000, 7, 1.0)])):
        part = base.unionByName(spark.createDataFrame(rows, "file string, seq long, ts_ms long, mmsi int, lat double"), allowMissingColumns=True)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = feed.distinct(stream).writeStream.format("memory").queryName("distinct").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert sorted((r["file"], r["seq"]) for r in spark.table("distinct").collect()) == [("a", 1), ("b", 2), ("c", 1)]


def test_tcp_feed_survives_lost_connections_and_restarts(spark, tmp_path):
    import socket
    import threading
    import time

    server = socket.create_server(("127.0.0.1", 0))
    sent, go_on = [], threading.Event()

    def serve():
        for k in range(4):
            link, _ = server.accept()
            lines = [f"line {k} {i}" for i in range(50)]
            link.sendall(("\n".join(lines) + "\ncut off").encode())
            sent.extend(lines)
            if k == 1:
                go_on.wait(60)  # the stream is stopped meanwhile
            time.sleep(0.3)
            link.close()

    threading.Thread(target=serve, daemon=True).start()
    stream = nmea.read_socket(spark, "127.0.0.1", server.getsockname()[1], f"file://{tmp_path}/spool")
    seen, tries = {}, []

    def take(batch, number):
        rows = [r["value"] for r in batch.collect()]
        if number == 1 and not tries:
            tries.append(rows)
            raise RuntimeError("lost")
        assert number not in seen or seen[number] == rows
        seen[number] = rows

    def follow(enough):
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").start()
        end = time.monotonic() + 90
        while query.isActive and sum(map(len, seen.values())) < enough and time.monotonic() < end:
            time.sleep(0.2)
        query.stop()

    follow(10_000)  # ends by the failure of the second batch
    assert tries
    go_on.set()
    follow(200)
    assert seen[1] == tries[0] and [x for k in sorted(seen) for x in seen[k]] == sent and len(sent) == 200
