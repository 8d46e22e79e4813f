"""An append-only log of events as a data source: ``spark.dataSource.register(EventLog)``, then format ``eventlog``.

The log is a folder of segments, Parquet files named after the offsets of their events, ``<first>-<after the last>``.
A batch appends one segment for each of its partitions; a batch that runs again, known by its writer's name and its
number, appends nothing. Readers keep their own offsets in their checkpoint, as members of a consumer group of their
own. ``path`` is any folder that pyarrow can open; driver and executors must share it.

Options to read: ``start`` ('earliest', or 'latest' for '$': only what is appended after the stream began) and
``maxEvents``, a bound of a batch, about: a segment is not cut. To write: ``writer``, a name, and ``maxLength``: the oldest segments
are dropped as long as that many events are left, as with an approximate limit of a log's length.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SEGMENT = re.compile(r"(\d{20})-(\d{20})-.*\.parquet")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def segments(path: str) -> list[tuple[int, int, str]]:
    """(first offset, offset after the last, file) of each segment, in order."""
    fs, at = opened(path)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((int(m[1]), int(m[2]), f.path) for f in found if (m := SEGMENT.fullmatch(f.base_name)))


@dataclass
class Part(InputPartition):
    file: str
    skip: int
    most: int


def read_part(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    """The events of a segment from ``skip`` on, ``most`` of them. What retention has dropped meanwhile is gone."""
    fs, _ = opened(path)
    try:
        with fs.open_input_file(part.file) as f:
            yield from pq.read_table(f).slice(part.skip, part.most).to_batches()
    except FileNotFoundError:
        return


def parts(path: str, lo: int, hi: int) -> list[Part]:
    return [Part(file, max(lo - a, 0), min(hi, b) - max(lo, a)) for a, b, file in segments(path) if a < hi and b > lo]


class LogReader(DataSourceReader):
    """The whole log as it is now."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return parts(self.path, 0, 1 << 62)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str, most: int):
        self.path, self.start, self.most, self.at = path, start, most, None

    def initialOffset(self) -> dict:
        found = segments(self.path)
        self.at = 0 if not found else found[-1][1] if self.start == "latest" else found[0][0]
        return {"offset": self.at}

    def latestOffset(self) -> dict:
        """The end of the log, or the first segment's end at which a batch is full."""
        found = segments(self.path)
        end = found[-1][1] if found else self.at or 0
        if self.most and self.at is not None:
            end = next((b for _, b, _ in found if b - self.at >= self.most), end)
        return {"offset": end}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = end["offset"]
        return parts(self.path, start["offset"], end["offset"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, partition)

    def commit(self, end: dict) -> None:
        """Offsets are the reader's checkpoint; the log keeps none."""


@dataclass
class Staged(WriterCommitMessage):
    file: str
    events: int


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, writer: str, most: int):
        self.path, self.writer, self.most = path, writer, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, at = opened(self.path)
        fs.create_dir(f"{at}/staged", recursive=True)
        file, n, out = f"{at}/staged/{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(file, batch.schema, filesystem=fs)
                out.write_batch(batch)
                n += batch.num_rows
        if out:
            out.close()
        return Staged(file, n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        """Gives the batch's files their offsets. These are noted first, so a commit that is repeated after a failure
        puts the missing segments where they belong and adds none. A log has one writer at a time."""
        fs, at = opened(self.path)
        note = lambda n: f"{at}/staged/{self.writer}-{n}.json"
        staged = [m for m in messages if m and m.events]
        fs.create_dir(f"{at}/staged", recursive=True)
        if fs.get_file_info(note(batchId)).type == pafs.FileType.NotFound:
            first = (segments(self.path) or [(0, 0, "")])[-1][1]
            with fs.open_output_stream(note(batchId)) as f:
                f.write(json.dumps([first, [[m.file, m.events] for m in staged]]).encode())
        else:
            self.clear(fs, staged)
        with fs.open_input_file(note(batchId)) as f:
            first, files = json.loads(f.read())
        for k, (file, n) in enumerate(files):
            if fs.get_file_info(file).type != pafs.FileType.NotFound:
                fs.move(file, f"{at}/{first:020d}-{first + n:020d}-{self.writer}-{batchId}-{k}.parquet")
            first += n
        if self.most:
            self.trim(fs)
        if fs.get_file_info(note(batchId - 1)).type != pafs.FileType.NotFound:  # only the last batch can be repeated
            fs.delete_file(note(batchId - 1))

    def clear(self, fs: pafs.FileSystem, staged: list[Staged]) -> None:
        for m in staged:
            fs.delete_file(m.file)

    def trim(self, fs: pafs.FileSystem) -> None:
        found = segments(self.path)
        left = sum(b - a for a, b, _ in found)
        for a, b, file in found[:-1]:
            left -= b - a
            if left < self.most:
                break
            fs.delete_file(file)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        fs, _ = opened(self.path)
        self.clear(fs, [m for m in messages if m and m.events])


class EventLog(DataSource):
    """Give the events' schema to read; an empty log has none of its own."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options["path"], self.options.get("start", "earliest"), int(self.options.get("maxEvents", 0)))

    def streamWriter(self, schema, overwrite) -> LogWriter:
        return LogWriter(self.options["path"], self.options.get("writer", "writer"), int(self.options.get("maxLength", 0)))
