"""Event logs that grow at their end, as a streaming source: each micro-batch holds the complete lines that were added.

    tail.register(spark)
    spark.readStream.format("tidewell_tail").option("path", folder).load()

gives (path, offset, line, restarted). The stream's offset holds for each file how many bytes of complete lines were taken, its
size and its time of change, so what a restarted query reads follows from its checkpoint alone. A file that became shorter, or
changed without becoming longer, starts anew: its lines come again with `restarted`, after one row without a line, which says so even
if nothing is left. A line is taken when its newline is there. Only the new bytes are read, in ranges that tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.packaging import ship

SCHEMA = "path string, offset long, line string, restarted boolean"
NAME = "tidewell_tail"
#: Bytes of new lines that one task reads.
RANGE = 32 << 20
_STEP = 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of `path` that begin from byte `start` up to `end`; `low` is where reading of the file begins."""

    path: str
    low: int
    start: int
    end: int
    restarted: bool


def changes(start: dict, end: dict, size: int = RANGE) -> list[Range]:
    """What to read between two offsets, which map paths to [bytes taken, size, time of change]."""
    out = []
    for path, (taken, length, changed) in sorted(end.items()):
        before = start.get(path)
        restarted = before is not None and (length < before[1] or (length == before[1] and changed != before[2]))
        low = 0 if before is None or restarted else before[0]
        if restarted:
            out.append(Range(path, 0, 0, 0, True))
        out += [Range(path, low, a, min(a + size, taken), restarted) for a in range(low, taken, size)]
    return out


def read_range(file, r: Range) -> Iterator[tuple]:
    """The rows of one range of a seekable binary file."""
    if r.restarted and r.end == 0:
        yield (r.path, 0, None, True)
        return
    at = r.start
    if r.start > r.low:
        # The line that holds the byte before the range began in an earlier one.
        file.seek(r.start - 1)
        at += _skip_line(file) - 1
    file.seek(at)
    rest = b""
    while at < r.end:
        data = file.read(_STEP)
        if not data:
            break
        *lines, rest = (rest + data).split(b"\n")
        for line in lines:
            if at >= r.end:
                return
            yield (r.path, at, line.decode("utf-8", "replace"), r.restarted)
            at += len(line) + 1


def _skip_line(file) -> int:
    """Bytes up to and with the next newline."""
    n = 0
    while data := file.read(_STEP):
        found = data.find(b"\n")
        if found >= 0:
            return n + found + 1
        n += len(data)
    return n


def complete_bytes(file, size: int) -> int:
    """How many of the first `size` bytes are complete lines."""
    end = size
    while end > 0:
        start = max(0, end - _STEP)
        file.seek(start)
        found = file.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix, self.range = options["path"], options.get("suffix", ".jsonl"), int(options.get("rangebytes", RANGE))
        self.seen: dict = {}

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, root = self._files()
        out = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or not info.path.endswith(self.suffix):
                continue
            facts = self.seen.get(info.path)
            if facts is None or facts[1:] != [info.size, info.mtime_ns]:
                with files.open_input_file(info.path) as file:
                    facts = [complete_bytes(file, info.size), info.size, info.mtime_ns]
            out[info.path] = facts
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return changes(start, end, self.range)

    def read(self, partition: Range) -> Iterator[tuple]:
        files, _ = self._files()
        with files.open_input_file(partition.path) as file:
            yield from read_range(file, partition)

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Tail)


def current(stored: DataFrame) -> DataFrame:
    """Of rows that were stored with the number of their `batch`: those of each file since it last started anew."""
    anew = stored.filter("restarted").groupBy("path").agg(F.max("batch").alias("__anew"))
    return stored.join(anew, "path", "left").filter("line is not null and (__anew is null or batch >= __anew)").drop("__anew")
