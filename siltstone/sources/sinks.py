"""Sinks: recovered files, JSON and HTML reports, session notes."""

from __future__ import annotations

import html
import itertools
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Recovery report</title></head><body>
<h1>Recovery report</h1><p>{timestamp} &middot; {image}</p>
<table><tr><th>Candidates</th><td>{candidates}</td></tr><tr><th>Files</th><td>{files}</td></tr><tr><th>Success</th><td>{rate:.1f} %</td></tr><tr><th>Bytes</th><td>{total}</td></tr></table>
<h2>Clusters</h2><table><tr><th>#</th><th>Start</th><th>Size KB</th><th>Links</th><th>Score</th></tr>{clusters}</table>
<h2>Files</h2><table><tr><th>#</th><th>Name</th><th>Size KB</th><th>SHA-256</th></tr>{names}</table><h2>Size of files (KB)</h2>{chart}</body></html>
"""


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[str]) -> None:
    """Writes a text, given in pieces, through the cluster's file system. It is written under another name that then takes
    the place of the old file in one step, so there is a whole file at any time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    system = to.getFileSystem(conf)
    to, part = system.makeQualified(to), system.makeQualified(part)
    out = system.create(part, True)
    for piece in pieces:
        out.write(bytearray(piece.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(part, to, how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_pieces(spark, path, [text])


def _opened(uri: str):
    """(file system, path in it) of a folder; for the driver and for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: the folder of its attempt."""

    folder: str


class FilesWriter(DataSourceArrowWriter):
    """Writes each row (filename, data) as a file. A task writes into a folder of its own attempt; when all tasks are done
    the driver moves the files of those attempts that count to their final names, so a retried, slower or failed task
    leaves nothing under a final name, and no half file is ever there. Of several files of one name one stays."""

    def __init__(self, options: dict):
        self.target, self.job = options["path"].rstrip("/"), options["job"]
        work = options.get("work", self.target)  # where attempts and the log of the write go
        self.staging, self.log = f"{work}/_staging-{self.job}", f"{work}/_status-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        folder = f"{self.staging}/{uuid.uuid4().hex}"
        system, base = _opened(folder)
        system.create_dir(f"{base}/files", recursive=True)
        status = []
        for batch in iterator:
            for name, data in zip(batch.column("filename").to_pylist(), batch.column("data")):
                try:
                    if not name or "/" in name or name in (".", ".."):
                        raise OSError("not a name for a file")
                    with system.open_output_stream(f"{base}/files/{name}") as out:
                        out.write(data.as_buffer() if data.is_valid else b"")
                    status.append((name, "Valid"))
                except OSError as e:
                    if name and system.get_file_info(f"{base}/files/{name}").type == fs.FileType.File:
                        system.delete_file(f"{base}/files/{name}")  # no half file
                    status.append((name, f"Corrupted: {e}"))
        with system.open_output_stream(f"{base}/status.json") as out:
            for name, what in status:
                out.write((json.dumps({"filename": name, "validation_status": what}) + "\n").encode())
        return Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        (system, base), (_, log) = _opened(self.target), _opened(self.log)
        system.create_dir(base, recursive=True)
        system.create_dir(log, recursive=True)

        def move(k: int, folder: str) -> None:
            _, mine = _opened(folder)
            for f in system.get_file_info(fs.FileSelector(f"{mine}/files")):
                system.move(f.path, f"{base}/{f.base_name}")
            system.move(f"{mine}/status.json", f"{log}/{k:06d}.json")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, *zip(*((k, m.folder) for k, m in enumerate(messages) if m))) if any(messages) else ())
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, staging = _opened(self.staging)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class Files(DataSource):
    """The sink `recovered_files`: rows (filename, data) become files in a folder."""

    @classmethod
    def name(cls) -> str:
        return "recovered_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FilesWriter(dict(self.options))


def write_files(files: DataFrame, directory: str) -> DataFrame:
    """Writes data (binary) under filename into directory/01_RECOVERED_FILES (see FilesWriter) and returns what became of
    each: (filename, validation_status), read from the log of this write. The folder is one that all executors share."""
    spark = files.sparkSession
    spark.dataSource.register(Files)
    work, job = directory.rstrip("/"), uuid.uuid4().hex
    files.select("filename", "data").write.format(Files.name()).options(job=job, work=work).mode("append").save(f"{work}/01_RECOVERED_FILES")
    return spark.read.schema("filename string, validation_status string").json(f"{work}/_status-{job}")


def report_paths(directory: str, now: datetime | None = None) -> tuple[str, str]:
    stem = f"{directory.rstrip('/')}/reports/recovery_report_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    return f"{stem}.json", f"{stem}.html"


def _bars(values: list[tuple[str, float]]) -> str:
    """A bar chart as SVG."""
    most = max([v for _, v in values] + [1.0])
    row = '<rect x="90" y="{y}" width="{w:.0f}" height="14"/><text x="0" y="{t}">{name}</text><text x="{x:.0f}" y="{t}">{v}</text>'
    rows = (row.format(y=20 * i, t=20 * i + 12, w=300 * v / most, x=96 + 300 * v / most, name=html.escape(name), v=round(v, 2)) for i, (name, v) in enumerate(values))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="480" height="{20 * len(values)}" font-size="12">{"".join(rows)}</svg>'


def write_report(spark: SparkSession, directory: str, report: dict, now: datetime | None = None, clusters: Callable[[], Iterable[dict]] = list) -> tuple[str, str]:
    """Writes the report as JSON and HTML: totals and files kept from the dictionary, the clusters from an iterator each."""
    as_json, as_html = report_paths(directory, now)
    text = json.dumps(report | {"clusters": []}, indent=2, ensure_ascii=False, default=str)
    head, tail = text.split('"clusters": []')
    rows = ((",\n    " if i else "\n    ") + json.dumps(c, ensure_ascii=False, default=str) for i, c in enumerate(clusters()))
    write_pieces(spark, as_json, itertools.chain([head + '"clusters": ['], rows, ["\n  ]" + tail]))
    row = lambda *cells: "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"
    page = _PAGE.format(
        timestamp=html.escape(report["metadata"]["timestamp"]), image=html.escape(report["metadata"]["image_path"]), candidates=report["scan_results"]["candidates_found"], files=report["stats"]["total_processed"],
        rate=report["stats"]["success_rate"], total=report["stats"]["total_bytes_recovered"], clusters="\0",
        chart=_bars([(f["filename"][:12], float(f["size_kb"])) for f in report["recovered_files"]]),
        names="".join(row(f["id"], f["filename"], f["size_kb"], f["sha256"]) for f in report["recovered_files"]),
    )
    head, tail = page.split("\0")
    rows = (row(c["cluster_id"], c["start_offset_hex"], c["size_kb"], c["link_count"], round(c["confidence"], 2)) for c in clusters())
    write_pieces(spark, as_html, itertools.chain([head], rows, [tail]))
    return as_json, as_html


def write_session(spark: SparkSession, directory: str, **notes: str) -> None:
    write_text(spark, f"{directory.rstrip('/')}/session.info", "".join(f"{k}: {v}\n" for k, v in notes.items()))
