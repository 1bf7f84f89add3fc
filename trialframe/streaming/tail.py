"""A streaming source of the lines that are appended to journals, resumed in the middle of files.

`spark.readStream.format("journal_tail").load(folder)` gives (path, device, inode, offset, text) of every complete line.
The offset of the stream is a table of bytes by file, a file being its device and inode, not its name: a journal that is
rotated goes on under its new name as long as that is in the folder, and a new file of the old name begins at 0. A file
that became shorter has not grown: reading goes on at its new end. A line without its line feed is not there yet. Blank
lines are counted in the offsets, but are no rows.

Devices and inodes exist on POSIX file systems only, so the folder has to be one that driver and executors mount; journals
elsewhere are read as batches by `sources.journal`. Options: glob (names of files, default *.jsonl), rangeBytes (a task
reads about so many bytes, default 64 MB), startingAt (begin, default, or end).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are read at once, also when a file's last line feed is looked for.
CHUNK = 1 << 20
RANGE_BYTES = 64 << 20


class ByteRange(InputPartition):
    """Lines of a file that begin in [start, end); whole: start is the beginning of a line for sure."""

    def __init__(self, path: str, device: int, inode: int, start: int, end: int, whole: bool):
        self.path, self.device, self.inode, self.start, self.end, self.whole = path, device, inode, start, end, whole


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def files(folder: str, glob: str) -> dict[str, tuple[str, int]]:
    """device:inode of each file below folder, with its path and size."""
    out = {}
    for at, _, names in os.walk(folder):
        for n in sorted(names):
            if fnmatch(n, glob) or fnmatch(n, glob + ".*"):
                try:
                    s = os.stat(p := os.path.join(at, n))
                except FileNotFoundError:  # it went meanwhile
                    continue
                out[f"{s.st_dev}:{s.st_ino}"] = (p, s.st_size)
    return out


def last_feed(path: str, start: int, end: int) -> int:
    """The byte after the last line feed in [start, end), or start."""
    with open(path, "rb") as f:
        while end > start:
            lo = max(start, end - CHUNK)
            f.seek(lo)
            if (k := f.read(end - lo).rfind(b"\n")) >= 0:
                return lo + k + 1
            end = lo
    return start


def lines(r: ByteRange) -> Iterator[tuple]:
    """Rows of a range: its lines are those that begin in it, and it reads on to their ends."""
    if (s := os.stat(r.path)).st_dev != r.device or s.st_ino != r.inode:
        raise FileNotFoundError(f"{r.path} is another file by now")
    with open(r.path, "rb") as f:
        f.seek(r.start)
        at = r.start
        if not r.whole:  # the line that began before belongs to the range before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < r.end and (raw := f.readline()).endswith(b"\n"):
            text = raw[:-1].decode("utf-8", "replace").removesuffix("\r")
            if text.strip():
                yield r.path, r.device, r.inode, at, text
            at += len(raw)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob = local(options["path"]), options.get("glob", "*.jsonl")
        self.range_bytes, self.at_end = int(options.get("rangebytes", RANGE_BYTES)), options.get("startingat", "begin") == "end"
        self.newest: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {k: last_feed(p, 0, n) for k, (p, n) in files(self.folder, self.glob).items()} if self.at_end else {}}

    def latestOffset(self) -> dict:  # noqa: N802
        """Ends of complete lines; a file that is gone keeps its entry, so that it is not read anew when it comes back."""
        now = {}
        for k, (p, n) in files(self.folder, self.glob).items():
            known = self.newest.get(k, 0)
            now[k] = last_feed(p, known if known <= n else 0, n)
        self.newest = self.newest | now
        return {"files": dict(self.newest)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of what each file has grown by; offsets that went back are new ends without rows."""
        self.newest = end["files"] | self.newest  # after a restart the stream goes on from its checkpoint
        there, out = files(self.folder, self.glob), []
        for k, to in sorted(end["files"].items()):
            begin = start["files"].get(k, 0)
            if k not in there or to <= begin:
                continue
            device, inode = map(int, k.split(":"))
            for lo in range(begin, to, self.range_bytes):
                out.append(ByteRange(there[k][0], device, inode, lo, min(lo + self.range_bytes, to), lo == begin))
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        pass


class JournalTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "path string, device long, inode long, offset long, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TailReader({k.lower(): v for k, v in self.options.items()})


def journal_tail(spark: SparkSession, folder: str, **options: str):
    """The stream of a folder's complete lines."""
    spark.dataSource.register(JournalTail)
    return spark.readStream.format("journal_tail").options(**options).load(folder)

