"""Recordings that still grow: WAV files read by byte range, as a table or as a stream.

What a file holds is told by its size, as the length in its header lags behind. A task
reads one range of bytes, so that a long recording is spread over tasks. The stream's
offset is the number of complete samples of each file; a sample of which one byte has
been written waits for the next batch. Short recordings share a task.
"""

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lectern.sources.audio import HEADER, RATE
from lectern.sources.places import files_below, opened

WIDTH = 2
SCHEMA = "path string, first bigint, pcm array<smallint>"
_ARROW = pa.schema([("path", pa.string()), ("first", pa.int64()), ("pcm", pa.list_(pa.int16()))])
#: Bytes of one task, and samples of one row: one second.
RANGE_BYTES, BLOCK = 8 << 20, RATE


@dataclass(frozen=True)
class Range:
    """Samples [first, last) of a file."""

    path: str
    first: int
    last: int


class Ranges(InputPartition):
    """What one task reads: a range of a long recording, or those of several short ones."""

    def __init__(self, parts: tuple[Range, ...]):
        self.parts = parts


def ranges(path: str, first: int, last: int, range_bytes: int) -> list[Range]:
    """[first, last) cut where a multiple of about range_bytes ends, at whole rows."""
    step = max(1, range_bytes // WIDTH // BLOCK) * BLOCK
    cuts = [first, *range((first // step + 1) * step, last, step), last]
    return [Range(path, a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def dealt(parts: Iterable[Range], range_bytes: int) -> list[Ranges]:
    """Ranges put together to about range_bytes for a task, in order."""
    out, held, size = [], [], 0
    for r in parts:
        n = (r.last - r.first) * WIDTH
        if held and size + n > range_bytes:
            out.append(Ranges(tuple(held)))
            held, size = [], 0
        held.append(r)
        size += n
    return [*out, Ranges(tuple(held))] if held or not out else out


def complete(size: int) -> int:
    """Whole samples in a file of so many bytes."""
    return max(0, size - HEADER) // WIDTH


def read_range(part: Range):
    """Record batches of (path, first, pcm): rows end where a second of the recording ends."""
    system, path = opened(part.path)
    with system.open_input_file(path) as f:
        at = part.first
        while at < part.last:
            stop = min((at // BLOCK + 64) * BLOCK, part.last)
            raw = f.read_at((stop - at) * WIDTH, HEADER + at * WIDTH)
            if len(raw) < (stop - at) * WIDTH:
                raise EOFError(f"{part.path} has become shorter than {HEADER + stop * WIDTH} bytes")
            starts = np.array([at, *range((at // BLOCK + 1) * BLOCK, stop, BLOCK), stop], np.int64)
            pcm = pa.ListArray.from_arrays(pa.array((starts - at).astype(np.int32)), pa.array(np.frombuffer(raw, "<i2")))
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(pcm)), pa.array(starts[:-1]), pcm], schema=_ARROW)
            at = stop


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".wav")
        self.bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        return dealt((r for path, size in files_below(self.path, self.suffix) for r in ranges(path, 0, complete(size), self.bytes)), self.bytes)

    def read(self, partition: Ranges):
        for part in partition.parts:
            yield from read_range(part)


class GrowingReader(DataSourceStreamReader):
    """Offsets are {path: complete samples}; a batch reads what has come to each file between two of them.

    A file that is gone or shorter than it was keeps its last offset as long as the stream runs. The offset names every
    file of the folder, so this is for the recordings of the day, not for an archive.
    """

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".wav")
        self.bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in files_below(self.path, self.suffix):
            self.seen[path] = max(self.seen.get(path, 0), complete(size))
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        for offset in (start, end):
            for path, n in offset.items():
                self.seen[path] = max(self.seen.get(path, 0), n)
        return dealt((r for path, last in sorted(end.items()) for r in ranges(path, start.get(path, 0), last, self.bytes)), self.bytes)

    def read(self, partition: Ranges):
        for part in partition.parts:
            yield from read_range(part)

    def commit(self, end: dict) -> None:
        pass


class Recordings(DataSource):
    """Format `recordings`: (path, first, pcm) of the WAV files (16 kHz, one channel, 16 bits) below `path`.

    Options: path, suffix (`.wav`), range_bytes (8 MiB). `first` is the number of the row's first sample. Rows end with the
    seconds of the recording, or where a batch of the stream ends. Files without a whole sample have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All samples that the files below path hold now."""
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").option("range_bytes", range_bytes).load(path)


def read_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The samples as they come, each once for one checkpoint."""
    spark.dataSource.register(Recordings)
    return spark.readStream.format("recordings").option("range_bytes", range_bytes).load(path)
