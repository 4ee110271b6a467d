"""The change log of a store as a data source, to read at once or to follow.

    spark.dataSource.register(ChangeFeed)
    spark.read.format("changefeed").options(path=log, after=500).load()
    spark.readStream.format("changefeed").options(path=log, maxChanges=100000).load()

A log is a folder ``epoch=<n>`` of Parquet files for each life of the store, with
sequence numbers that grow. An offset is (epoch, seq). What lies between two offsets
is cut into ranges of ``chunk`` numbers, a task each, so a task reads the row groups
of its range alone and is bounded, however far a reader is behind. Between two
triggers of a running stream at most ``maxChanges`` numbers pass; the first trigger
after a restart goes to the end of the log, as a reader is not told where its
checkpoint stands.

When the store has begun a new epoch, numbers of the old one say nothing any more: the
stream fails, until it is started with ``reset``, and then reads the new epoch whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "seq long, actor_id string, id long, operation string, revision long, body string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Sequence numbers of one task.
CHUNK = 1_000_000


class EpochChanged(RuntimeError):
    """The store began a new epoch; the reader must be reset."""


def append_log(changes: DataFrame, path: str, epoch: int) -> None:
    """Add changes to the log of an epoch; files hold ranges of numbers, so that readers can pass over most."""
    changes.select(*COLUMNS).repartitionByRange("seq").sortWithinPartitions("seq").write.mode("append").parquet(f"{path}/epoch={epoch}")


@dataclass
class Files:
    """The files of a log, with what their footers say."""

    path: str

    def __post_init__(self) -> None:
        uri = self.path if re.match(r"\w+:", self.path) else f"file://{self.path}"
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def epochs(self) -> dict[int, list[str]]:
        found: dict[int, list[str]] = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            m = re.search(r"epoch=(\d+)/[^/_.][^/]*\.parquet$", info.path)
            if m and info.is_file and "_temporary" not in info.path:
                found.setdefault(int(m[1]), []).append(info.path)
        return found

    def last(self) -> tuple[int, int]:
        """(epoch, seq) at the end of the log; (0, -1) if it is empty."""
        epochs = self.epochs()
        if not epochs:
            return 0, -1
        epoch = max(epochs)
        return epoch, max((hi for f in epochs[epoch] for _, _, hi in self.groups(f)), default=-1)

    def groups(self, file: str) -> Iterator[tuple[int, int, int]]:
        """(row group, least number, largest number) of a file."""
        with self.fs.open_input_file(file) as f:
            meta = pq.read_metadata(f)
        at = meta.schema.names.index("seq")
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at).statistics
            if meta.row_group(i).num_rows:
                yield i, stats.min, stats.max

    def read(self, epoch: int, after: int, upto: int) -> Iterator[pa.RecordBatch]:
        """Changes with after < seq <= upto."""
        for file in sorted(self.epochs().get(epoch, [])):
            wanted = [i for i, lo, hi in self.groups(file) if lo <= upto and hi > after]
            if wanted:
                with self.fs.open_input_file(file) as f:
                    for batch in pq.ParquetFile(f).iter_batches(row_groups=wanted, columns=COLUMNS):
                        seq = batch.column("seq")
                        part = batch.filter(pc.and_(pc.greater(seq, after), pc.less_equal(seq, upto)))
                        if part.num_rows:
                            yield part.select(COLUMNS)


class Range(InputPartition):
    def __init__(self, epoch: int, after: int, upto: int) -> None:
        self.epoch, self.after, self.upto = epoch, after, upto


def ranges(epoch: int, after: int, upto: int, chunk: int) -> list[Range]:
    """The numbers of (after, upto] in ranges of at most ``chunk``."""
    return [Range(epoch, a, min(a + chunk, upto)) for a in range(after, upto, chunk)]


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changefeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FeedStream(self.options)


class FeedReader(DataSourceReader):
    """The changes after a number, in the last epoch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.after, self.chunk = options["path"], int(options.get("after", -1)), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Range]:
        epoch, last = Files(self.path).last()
        return ranges(epoch, self.after, last, self.chunk) or [Range(epoch, self.after, self.after)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from Files(self.path).read(partition.epoch, partition.after, partition.upto)


class FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.most = int(options.get("maxchanges", options.get("maxChanges", 0)))
        self.reset = options.get("reset", "false").lower() == "true"
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = {"epoch": Files(self.path).last()[0], "seq": -1}
        return self.at

    def latestOffset(self) -> dict:  # noqa: N802
        epoch, last = Files(self.path).last()
        if self.most and self.at is not None and self.at["epoch"] == epoch:
            last = min(last, self.at["seq"] + self.most)
        self.at = {"epoch": epoch, "seq": last}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after = start["seq"]
        if start["epoch"] != end["epoch"]:
            if start["epoch"] and not self.reset:
                raise EpochChanged(f"the log is in epoch {end['epoch']}, the reader in {start['epoch']}: start it with reset to read the new epoch whole")
            after = -1
        return ranges(end["epoch"], after, end["seq"], self.chunk)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from Files(self.path).read(partition.epoch, partition.after, partition.upto)

    def commit(self, end: dict) -> None:
        pass
