"""Images as tables: whole files, byte ranges, directory listings, link lists."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions import predicates as V


def image(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files; an error if there is none."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, media_group) of the files of a directory; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), "length", V.media_group(name).alias("media_group"))


def link_list(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """(link) of a JSON list of links, or of {"links": [...]}, the first `limit`."""
    rows = spark.read.option("multiLine", True).text(path, wholetext=True)
    links = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "links array<string>")["links"])
    return rows.select(F.explode(links).alias("link")).limit(limit)


def large_image(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files of any size, one or many; what reads them asks for ranges of bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def bytes_at(rows: DataFrame, images: DataFrame, at: str, size: str, out: str = "part") -> DataFrame:
    """Adds to rows (path, ...) the bytes of their image at `at`, `size` of them or as many as there are.

    Images with a content column are joined; of others (large_image) each task reads the ranges of its own rows from the
    file, so no image is ever whole in memory."""
    if "content" in images.columns:
        content = images.select("path", F.col("content").alias("_content"))
        part = F.substring("_content", (F.col(at) + 1).cast("int"), F.col(size).cast("int"))
        return rows.join(content, "path").withColumn(out, part).drop("_content")
    columns = rows.columns

    def run(batches):
        import pyarrow as pa

        opened = {}
        for whole in batches:
            begin = 0
            where = [whole.column(columns.index(c)).to_pylist() for c in ("path", at, size)]
            while begin < whole.num_rows:  # a few MiB at a time, and one row at least
                end, total, data = begin, 0, []
                while end < whole.num_rows and (end == begin or total + where[2][end] <= 32 << 20):
                    path, offset, n = (x[end] for x in where)
                    if path not in opened:
                        system, name = _open(path)
                        opened[path] = system.open_input_file(name)
                    opened[path].seek(offset)
                    data.append(opened[path].read(n))
                    total += n
                    end += 1
                part = whole.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*columns, out])
                begin = end

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(b"").cast("binary")).schema)


def spread(rows: DataFrame, images: DataFrame, per_task: int = 64 << 20) -> DataFrame:
    """rows of large images dealt over tasks, about per_task bytes of the images for each; narrow rows, without bytes."""
    if "content" in images.columns:
        return rows
    total = images.agg(F.sum("length")).first()[0] or 0
    return rows.repartition(max(1, min(20_000, ceil(total / per_task))))


class _Range(InputPartition):
    def __init__(self, path: str, chunk_id: int, offset: int, size: int):
        self.path, self.chunk_id, self.offset, self.size = path, chunk_id, offset, size


class ByteRanges(DataSource):
    """Chunks of one large file read as byte ranges through Arrow's file systems, so no task holds the file.

    Options: path, chunk (64 MiB), overlap (0), start (0), limit (0: to the end)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, chunk_id long, chunk_seq long, offset long, size long, data binary"

    def reader(self, schema):
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.chunk, self.overlap = int(options.get("chunk", 64 << 20)), int(options.get("overlap", 0))
        self.start, self.limit = int(options.get("start", 0)), int(options.get("limit", 0))

    def _file(self):
        return _open(self.path)

    def partitions(self):
        system, name = self._file()
        length = system.get_file_info(name).size
        end = min(length, self.start + self.limit) if self.limit else length
        return [_Range(self.path, i, o, min(self.chunk + self.overlap, end - o)) for i, o in enumerate(range(self.start, end, self.chunk))]

    def read(self, partition):
        system, name = self._file()
        with system.open_input_file(name) as f:
            f.seek(partition.offset)
            yield (partition.path, partition.chunk_id, partition.chunk_id, partition.offset, partition.size, f.read(partition.size))


def byte_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def first_bytes(images: DataFrame, n: int = 512) -> DataFrame:
    """(path, head) of images (path, content): a smoke read."""
    return images.select("path", F.substring("content", 1, n).alias("head"))


def memory_mb(text: str) -> int | None:
    """MB of a node from its meminfo text; None without a total."""
    for line in text.splitlines():
        words = line.split()
        if line.startswith("Node") and "MemTotal:" in line and words[-2].isdigit():
            return int(words[-2]) // 1024
    return None


def cpu_list(text: str) -> list[int]:
    """"0-3,8-11" as numbers; parts that are no number or range are skipped."""
    out: list[int] = []
    for part in text.strip().split(","):
        a, _, b = part.partition("-")
        if a.strip().isdigit() and (not b or b.strip().isdigit()):
            out += range(int(a), int(b or a) + 1)
    return out
