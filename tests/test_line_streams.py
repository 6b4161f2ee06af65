"""Exact numbers of lines of split files, and records of a stream of lines however it is cut."""

import random
import time

import pytest

from tidemark import sources, streaming
from tidemark.operators import logs

SCHEMA = "file string, line long, text string"


@pytest.mark.parametrize("block", [60, 1000, 1 << 20])
def test_numbers_by_ones(spark, tmp_path, block):
    rng = random.Random(1)
    texts = {"a.log": [f"line {k} " + "x" * rng.randint(0, 40) for k in range(300)], "sub/b.txt": ["only"], "c.log": [], "d.log": ["", "", "é" * 50, ""], "e.csv": ["no"]}
    for name, lines in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(t + "\n" for t in lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sources.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["file"].split("/")[-1], r["line"], r["text"]) for r in got) == sorted((n.split("/")[-1], k, t) for n, lines in texts.items() for k, t in enumerate(lines, 1) if not n.endswith("csv"))


def log_lines(rng, file, n):
    out = []
    for k in range(n):
        kind = rng.random()
        text = f"2024-01-02 03:04:{k % 60:02} ERROR [svc] failed {k}" if kind < 0.3 else "\tat com.example.Main(Main.java:10)" if kind < 0.6 else rng.choice(["detail", "", "  more"])
        out.append((file, k * 2, text))
    return out


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_of_records(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    files = {f: log_lines(rng, f, 60) for f in ("a.log", "b.log")} | {"junk.log": [("junk.log", 1, "never opens")]}
    files["c.log"] = [("c.log", 5, "2024-01-02 03:04:05 WARN [x] alone")]
    whole = [row for rows in files.values() for row in rows]
    expected = sorted(map(tuple, logs.sessionize(spark.createDataFrame(whole, SCHEMA)).collect()), key=str)
    folder, out = tmp_path / "in", tmp_path / "out"
    stream = lambda: streaming.log_records(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    got = None
    for k in range(cuts):
        part = [row for rows in files.values() for row in rows[len(rows) * k // cuts : len(rows) * (k + 1) // cuts]]
        if k:  # the last lines of the cut before come again
            part += [row for rows in files.values() for row in rows[max(0, len(rows) * k // cuts - 2) : len(rows) * k // cuts]]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        got = streaming.resumed(stream(), str(out), str(tmp_path / "offsets"))
    # Each file's last record is open until its end is told.
    assert got.count() == len(expected) - 3
    spark.createDataFrame([(f, 10_000, None) for f in files], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    got = streaming.resumed(stream(), str(out), str(tmp_path / "offsets"))
    columns = logs.sessionize(spark.createDataFrame(whole, SCHEMA)).columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == expected


def test_idle_records_close(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "2024-01-02 03:04:05 WARN [x] first"), ("a", 2, "joined")], SCHEMA).write.parquet(folder)
    stream = streaming.log_records(spark.readStream.schema(SCHEMA).parquet(folder), idle_ms=1000)
    query = stream.writeStream.format("memory").queryName("idle_records").outputMode("append").option("checkpointLocation", f"{tmp_path}/offsets").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.sql("SELECT * FROM idle_records").count():
            time.sleep(0.5)
        got = spark.sql("SELECT * FROM idle_records").collect()
    finally:
        query.stop()
    assert [(r["file"], r["line"], r["message"]) for r in got] == [("a", 1, "first\njoined")]


def test_end_of_no_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = streaming.log_records(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    assert streaming.resumed(stream, f"{tmp_path}/out", f"{tmp_path}/offsets").count() == 0
