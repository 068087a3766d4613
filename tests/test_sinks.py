"""The sink of recovered files: all or nothing under the final names."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import sinks


def names(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("_")) if os.path.isdir(folder) else []


def test_files_are_written_and_their_status_can_be_read_again(spark, tmp_path):
    rows = [(f"f{i}.bin", bytes([i]) * i) for i in range(20)] + [("a/b", b"x"), ("..", b"x"), (None, b"x"), ("none.bin", None)]
    files = spark.createDataFrame(rows, "filename string, data binary").repartition(4)
    status = sinks.write_files(files, str(tmp_path))
    where = f"{tmp_path}/01_RECOVERED_FILES"
    assert names(where) == sorted([f"f{i}.bin" for i in range(20)] + ["none.bin"])
    for _ in range(2):  # reading the status writes nothing
        got = {r.filename: r.validation_status for r in status.collect()}
        assert {n for n, s in got.items() if s == "Valid"} == set(names(where)) and len(got) == 24
        os.remove(f"{where}/f3.bin") if os.path.exists(f"{where}/f3.bin") else None
        assert "f3.bin" not in names(where)
        got.pop("f3.bin")
        open(f"{where}/f3.bin", "wb").write(b"\3" * 3)
    assert all(open(f"{where}/f{i}.bin", "rb").read() == bytes([i]) * i for i in range(20))
    assert not [n for n in os.listdir(tmp_path) if n.startswith("_staging")]
    assert sorted(os.listdir(where)) == names(where)


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.format_string("f%d.bin", "id").alias("filename"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost disk")).cast("binary")).otherwise(F.encode(F.repeat(F.lit("x"), 1000), "UTF-8")).alias("data"))
    with pytest.raises(Exception, match="lost disk"):
        sinks.write_files(rows, str(tmp_path))
    assert names(f"{tmp_path}/01_RECOVERED_FILES") == [] and not [n for n in os.listdir(tmp_path) if n.startswith("_staging")]
    sinks.write_files(rows.where("id < 39"), str(tmp_path))
    assert len(names(f"{tmp_path}/01_RECOVERED_FILES")) == 39


def test_only_attempts_that_count_are_moved(tmp_path):
    import pyarrow as pa

    writer = sinks.FilesWriter({"path": str(tmp_path), "job": "j"})
    batch = lambda text: iter([pa.RecordBatch.from_pydict({"filename": ["a.bin"], "data": [text]})])
    lost, kept = writer.write(batch(b"first try")), writer.write(batch(b"second"))
    assert names(tmp_path) == [] and lost.folder != kept.folder
    writer.commit([kept, None])
    assert open(tmp_path / "a.bin", "rb").read() == b"second" and sorted(os.listdir(tmp_path)) == ["_status-j", "a.bin"]
    again = sinks.FilesWriter({"path": str(tmp_path), "job": "k"})
    again.write(batch(b"third"))
    again.abort([])
    assert open(tmp_path / "a.bin", "rb").read() == b"second" and sorted(os.listdir(tmp_path)) == ["_status-j", "a.bin"]


def test_no_files(spark, tmp_path):
    assert sinks.write_files(spark.createDataFrame([], "filename string, data binary"), str(tmp_path)).isEmpty()
