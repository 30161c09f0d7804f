"""Files that are one JSON object ``{key: value, ...}``, read by several tasks and
written by several tasks (S1, S8, S9-S11).

Reading. A file is cut into byte ranges. Whether a range begins inside a string, and how
deep, is not known from its bytes, so a first pass over the ranges tells for either
beginning (outside a string, inside, inside behind a backslash) how the range ends and by
how much the depth changes: three small results per range. Composed in file order they
give each range its true beginning. In the second pass a task reads the entries whose
delimiter (the first brace, or a comma of depth one) lies in its range, the last one to
its end beyond the range. So every entry is read once, whatever the strings hold.

Writing. Every task writes its entries to a file of its own; the commit joins the
committed files as streams, in the order of the partitions, into one file that appears
under its name only when it is whole. A task that fails removes its file, an aborted
write removes all, and the target stays as it was.

Both are Python data sources over ``pyarrow.fs``: local paths and the file systems that
it knows. Keys are strings, values are JSON texts for ``from_json``. A key that stands
twice gives two rows; an empty object gives none. A file that is no object is an error.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Planner and executors get this module with its classes, wherever it is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20
MORE_BYTES = 1 << 20  # read beyond a range at once
BATCH_BYTES = 4 << 20
COPY_BYTES = 8 << 20
BLANK = b" \t\r\n"
TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[{}\[\],]|"', re.S)  # the last is a string that goes on
REST = re.compile(rb'(?:[^"\\]++|\\.)*+', re.S)  # of a string

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """The file at ``path``, or the files below it but those whose own or folder's name
    begins with ``_`` or ``.``, with their sizes."""
    fs, base = file_system(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    below = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    head = base.rstrip("/")
    out = []
    for f in below:
        inner = f.path[len(head) + 1:]
        if f.type == pafs.FileType.File and not any(p[0] in "_." for p in inner.split("/")):
            out.append((f"{path.rstrip('/')}/{inner}", f.size))
    return sorted(out)


def read_range(path: str, start: int, size: int) -> bytes:
    fs, base = file_system(path)
    with fs.open_input_file(base) as f:
        return f.read_at(size, start)


def run_through(data: bytes, state: int) -> tuple[int, int, bool]:
    """How a range ends that begins in ``state``, its change of depth, and whether there
    is a token in it."""
    at, depth, seen = 0, 0, state != OUTSIDE
    if state == ESCAPED:
        at = 1
    if state != OUTSIDE:
        if at > len(data) or not data:
            return state, 0, seen
        at = REST.match(data, at).end()
        if at == len(data):
            return INSIDE, 0, seen
        if data[at:at + 1] == b"\\":
            return ESCAPED, 0, seen
        at += 1
    while m := TOKEN.search(data, at):
        c, seen = data[m.start()], True
        if c == 0x22 and m.end() - m.start() == 1:  # goes on behind the range
            at = REST.match(data, m.end()).end()
            return (INSIDE if at == len(data) else ESCAPED), depth, seen
        if c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
        at = m.end()
    return OUTSIDE, depth, seen


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int
    state: int = OUTSIDE
    depth: int = 0
    begun: bool = False  # whether the object begins before this range

    def follow(self, before: Range, state: int, depth: int, seen: bool) -> None:
        """Take up where the range before ended, if it is of the same file."""
        if self.start:
            self.state, self.depth, self.begun = state, before.depth + depth, before.begun or seen


def ranges_of(path: str, range_bytes: int) -> list[Range]:
    return [Range(p, s, min(s + range_bytes, size), size)
            for p, size in files_of(path) for s in range(0, max(size, 1), range_bytes)]


class Scanner:
    """The entries whose delimiter lies in a range."""

    def __init__(self, part: Range):
        self.part = part
        self.data = read_range(part.path, part.start, part.end - part.start)

    def more(self) -> bool:
        at = self.part.start + len(self.data)
        new = read_range(self.part.path, at, min(MORE_BYTES + len(self.data) // 2, self.part.size - at))
        self.data += new
        return bool(new)

    def bad(self, why: str):
        return ValueError(f"{self.part.path} is not one JSON object: {why}")

    def tokens(self, at: int):
        """``(place, character)`` of braces, brackets and commas outside strings."""
        while True:
            m = TOKEN.search(self.data, at)
            if m is None:
                at = len(self.data)
                if not self.more():
                    return
            elif self.data[m.start()] != 0x22:
                yield m.start(), self.data[m.start()]
                at = m.end()
            elif m.end() - m.start() == 1:
                at = m.start()
                if not self.more():
                    raise self.bad("a string does not end")
            else:
                at = m.end()

    def entries(self):
        part, own = self.part, self.part.end - self.part.start
        at, depth, begin = 0, part.depth, None
        if part.state != OUTSIDE:
            at = REST.match(self.data, 1 if part.state == ESCAPED else 0).end()
            if at >= own or self.data[at:at + 1] != b'"':
                return  # the string goes on behind this range
            at += 1
        elif not part.begun:
            self._opens()
        elif depth == 0:
            self._only_blanks(at)
            return
        for place, c in self.tokens(at):
            if depth == 1 and (c == 0x2C or c == 0x7D):
                if begin is not None:
                    entry = self._entry(begin, place, c == 0x7D)
                    if entry:
                        yield entry
                if c == 0x7D:
                    if place < own:
                        self._only_blanks(place + 1)
                    return
                if place >= own:
                    return
                begin = place
                continue
            if c in b"{[":
                depth += 1
                if depth == 1 and place < own:
                    begin = place
            elif c in b"}]":
                depth -= 1
            if begin is None and place >= own:
                return
        if begin is not None:
            raise self.bad("it does not end")

    def _opens(self):
        mark = max(0, 3 - self.part.start)  # bytes that may be of a byte order mark
        self.data = self.data[:mark].translate(bytes(0x20 if b in b"\xef\xbb\xbf" else b for b in range(256))) + self.data[mark:]
        head = self.data.lstrip(BLANK)
        if head and head[:1] != b"{" or not head and self.part.end == self.part.size:
            raise self.bad("it does not begin with a brace")

    def _only_blanks(self, at: int):
        if self.data[at:self.part.end - self.part.start].strip(BLANK):
            raise self.bad("something stands behind it")

    def _entry(self, begin: int, end: int, last: bool) -> tuple[str, str] | None:
        raw = self.data[begin + 1:end].strip(BLANK)
        if not raw:
            if last and self.data[begin] == 0x7B:
                return None
            raise self.bad("an entry is empty")
        text = raw.decode()
        try:
            key, at = json.decoder.scanstring(text, 1)
            rest = text[at:].lstrip(" \t\r\n")
        except ValueError as e:
            raise self.bad(str(e)) from e
        if text[0] != '"' or rest[:1] != ":":
            raise self.bad(f"no key at {text[:40]!r}")
        return key, rest[1:].strip(" \t\r\n")


class SummarySource(DataSource):
    """``(path, start, state, end_state, depth, seen)``: how each range ends for each beginning."""

    @classmethod
    def name(cls):
        return "spanlake_object_summary"

    def schema(self):
        return "path string, start long, state int, end_state int, depth long, seen boolean"

    def reader(self, schema):
        return SummaryReader(self.options["path"], int(self.options["range_bytes"]))


class SummaryReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        return ranges_of(self.path, self.range_bytes)

    def read(self, part: Range):
        data = read_range(part.path, part.start, part.end - part.start)
        for state in (OUTSIDE, INSIDE, ESCAPED) if part.start else (OUTSIDE,):
            yield part.path, part.start, state, *run_through(data, state)


class EntrySource(DataSource):
    """``(key, value)`` of the files' entries; the option ``ranges`` are the JSON ranges
    with their beginnings."""

    @classmethod
    def name(cls):
        return "spanlake_object_entries"

    def schema(self):
        return "key string, value string"

    def reader(self, schema):
        return EntryReader(self.options["ranges"])


class EntryReader(DataSourceReader):
    def __init__(self, ranges: str):
        self.ranges = ranges

    def partitions(self):
        return [Range(*r) for r in json.loads(self.ranges)]

    def read(self, part: Range):
        keys, values, size = [], [], 0
        schema = pa.schema([("key", pa.string()), ("value", pa.string())])
        for key, value in Scanner(part).entries():
            keys.append(key)
            values.append(value)
            size += len(value)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=schema)
                keys, values, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=schema)


def read_object_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(key, value)`` rows of a file, or of the files of a folder, that are one JSON
    object each; one task for each ``range_bytes`` bytes."""
    spark.dataSource.register(SummarySource)
    spark.dataSource.register(EntrySource)
    parts = ranges_of(path, range_bytes)
    ends: dict = {}
    if any(p.start for p in parts):  # three rows per range
        found = spark.read.format(SummarySource.name()).option("range_bytes", str(range_bytes)).load(path)
        ends = {(r["path"], r["start"], r["state"]): (r["end_state"], r["depth"], r["seen"]) for r in found.collect()}
    for before, p in zip(parts, parts[1:]):
        if p.start:
            p.follow(before, *ends[before.path, before.start, before.state])
    listed = json.dumps([[p.path, p.start, p.end, p.size, p.state, p.depth, p.begun] for p in parts])
    return spark.read.format(EntrySource.name()).option("ranges", listed).load()


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    partition: int


class ObjectSink(DataSource):
    """Writes ``(key, value)`` rows as one JSON object at the option ``path``."""

    @classmethod
    def name(cls):
        return "spanlake_object_file"

    def writer(self, schema, overwrite):
        return ObjectWriter(self.options["path"], overwrite)


class ObjectWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.job = path, uuid.uuid4().hex[:12]
        fs, base = file_system(path)
        if not overwrite and fs.get_file_info(base).type != pafs.FileType.NotFound:
            raise FileExistsError(path)

    def _own(self, name: str) -> str:
        head, _, tail = self.path.rpartition("/")
        return f"{head}/_{tail}-{self.job}-{name}" if head else f"_{tail}-{self.job}-{name}"

    def write(self, iterator):
        from pyspark import TaskContext
        context = TaskContext.get()
        target = self._own(f"{context.partitionId():05d}-{context.taskAttemptId()}")
        fs, base = file_system(target)
        if "/" in base:
            fs.create_dir(base.rpartition("/")[0], recursive=True)
        n = 0
        try:
            with fs.open_output_stream(base) as out:
                for row in iterator:
                    entry = f"{json.dumps('' if row[0] is None else row[0], ensure_ascii=False)}:{'null' if row[1] is None else row[1]}"
                    out.write((",\n" if n else "").encode() + entry.encode())
                    n += 1
        except BaseException:
            fs.delete_file(base)
            raise
        if not n:
            fs.delete_file(base)
        return Part(target if n else None, context.partitionId())

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.partition)
        whole = self._own("whole")
        fs, base = file_system(whole)
        if "/" in base:
            fs.create_dir(base.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(base) as out:
            out.write(b"{")
            for i, m in enumerate(parts):
                if i:
                    out.write(b",\n")
                with fs.open_input_stream(file_system(m.path)[1]) as part:
                    while block := part.read(COPY_BYTES):
                        out.write(block)
            out.write(b"}\n")
        fs.move(base, file_system(self.path)[1])
        self._forget(parts)

    def abort(self, messages):
        """A task that was killed could not remove its file: all of this write's go."""
        fs, base = file_system(self._own(""))
        folder, _, name = base.rpartition("/")
        for f in fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True)):
            if f.base_name.startswith(name):
                try:
                    fs.delete_file(f.path)
                except FileNotFoundError:
                    pass  # removed by its task

    @staticmethod
    def _forget(parts):
        for m in parts:
            fs, base = file_system(m.path)
            fs.delete_file(base)


def write_object_entries(entries: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write ``(key, value)`` rows, values being JSON texts, as one JSON object file, in
    the order of the partitions. Keys are not checked for being different."""
    if mode not in ("overwrite", "errorifexists"):
        raise ValueError(f"unknown mode {mode!r}")
    entries.sparkSession.dataSource.register(ObjectSink)
    out = entries.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    out.write.format(ObjectSink.name()).mode("overwrite" if mode == "overwrite" else "append").save(path)
    return path
