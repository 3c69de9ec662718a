"""A streaming source of complete lines of growing files.

Offsets are {path: [inode, bytes, lines]}. Only whole lines are read; the unfinished end of
a file waits for the next batch. A file whose inode changed or that is shorter than
its offset is read from its start. Line numbers go on from the offset, so a batch reads
its own bytes only. A reader that has just started doesn't know what was committed: its
first batch goes up to the end of each file, and the file's lines are counted once.
Files must be reachable from every executor.

Options: path (a glob), maxBytesPerFile (of one batch, and of one task, default 16 MB).
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_file string, byte_offset bigint, line_no bigint, raw string"


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int, lines: int):
        self.path, self.start, self.end, self.lines = path, start, end, lines


def count_lines(path: str, start: int, end: int, block: int = 1 << 20) -> int:
    """Line breaks in [start, end)."""
    found = 0
    with open(path, "rb") as f:
        f.seek(start)
        while start < end and (got := f.read(min(block, end - start))):
            found += got.count(b"\n")
            start += len(got)
    return found


def last_line_end(path: str, start: int, end: int, block: int = 1 << 16) -> int:
    """Offset behind the last line break in [start, end), or start."""
    with open(path, "rb") as f:
        at = end
        while at > start:
            size = min(block, at - start)
            f.seek(at - size)
            found = f.read(size).rfind(b"\n")
            if found >= 0:
                return at - size + found + 1
            at -= size
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxBytesPerFile", 16 << 20))
        self.known: dict[str, list[int]] = {}  # inode, bytes, lines

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = dict(self.known)
        for path in sorted(glob.glob(self.path, recursive=True)):
            stat = os.stat(path)
            inode, done, lines = self.known.get(path, [stat.st_ino, 0, 0])
            if inode != stat.st_ino or done > stat.st_size:
                done = lines = 0
            end = self.line_end(path, done, stat.st_size) if path in self.known else last_line_end(path, done, stat.st_size)
            now[path] = [stat.st_ino, end, lines + count_lines(path, done, end)]
        self.known = now
        return {"files": json.dumps(now, sort_keys=True)}

    def line_end(self, path: str, start: int, stop: int) -> int:
        """End of the last whole line in at most ``most`` bytes, or of a longer one, up to ``stop``."""
        end = last_line_end(path, start, min(stop, start + self.most))
        return last_line_end(path, start, stop) if end == start and stop - start >= self.most else end

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**after, **self.known}
        out = []
        for path, (inode, stop, _) in after.items():
            first, at, lines = before.get(path, [inode, 0, 0])
            if first != inode or at > stop:
                at = lines = 0
            while at < stop:
                to = self.line_end(path, at, stop)
                out.append(Slice(path, at, to, lines))
                if to < stop:
                    lines += count_lines(path, at, to)
                at = max(to, at + 1)
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            at, number = part.start, part.lines
            while at < part.end:
                line = f.readline()
                if not line:
                    return
                number += 1
                text = line.decode("utf-8", errors="replace").rstrip("\r\n")
                if text.strip():
                    yield (part.path, at, number, text)
                at += len(line)

    def commit(self, end: dict) -> None:
        return None


class TailSource(DataSource):
    """``spark.readStream.format('line_tail').option('path', ...)`` after ``spark.dataSource.register(TailSource)``."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
