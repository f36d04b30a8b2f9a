"""Large JSON collections read by many tasks.

A file is cut into byte ranges. Whether a range begins inside a string, and how
deep in the document, follows from all bytes before it, so two passes are made.
The first one finds for each range, for every state it may begin in, the state it
ends in and how much deeper; a running composition over the ranges of a file gives
each its true beginning. The second one cuts the features that begin in a range
and reads on to the end of the last of them. Nothing is guessed from patterns.

Features are the objects in a list at the top, or in a list right below the top
object. A file of which the end is missing gives its last, open feature as it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Outside of strings, in a string, in a string behind a backslash.
OUT, IN, ESCAPED = 0, 1, 2
RANGE_BYTES = 32 << 20
_REST = re.compile(rb'(?:[^"\\]|\\.)*+', re.S)
_TOKENS = re.compile(rb'"(?:[^"\\]|\\.)*+"?|[{}\[\]]', re.S)
_STRINGS = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.S)
_PIECE = 1 << 20
#: Bytes looked at first for the mark before a place or at the top of a file.
_LITTLE = 256


def _skip_string(data: bytes, at: int, state: int) -> tuple[int, int]:
    """Where the string that was open at ``at`` ends, and the state there."""
    if state == ESCAPED:
        at += 1
        if at > len(data):
            return at, ESCAPED
    end = _REST.match(data, at).end()
    if end < len(data) and data[end:end + 1] == b'"':
        return end + 1, OUT
    return len(data), ESCAPED if end < len(data) else IN


def advance(data: bytes, state: int) -> tuple[int, int]:
    """State behind the data and change of depth, for the state before it."""
    at = 0
    if state != OUT:
        if not data:
            return state, 0
        at, state = _skip_string(data, 0, state)
        if state != OUT:
            return state, 0
    rest = _STRINGS.sub(b"", data[at:])
    open_quote = rest.find(b'"')
    if open_quote >= 0:
        tail = rest[open_quote + 1:]
        state = ESCAPED if _REST.match(tail).end() < len(tail) else IN
        rest = rest[:open_quote]
    return state, rest.count(b"{") + rest.count(b"[") - rest.count(b"}") - rest.count(b"]")


def _first_mark(read, size: int) -> bytes:
    """First byte of a file that is no white space, within its first megabyte."""
    at, step = 0, _LITTLE
    while at < min(size, _PIECE):
        mark = read(at, min(size, _PIECE, at + step)).lstrip()[:1]
        if mark:
            return mark
        at, step = at + step, 2 * step
    return b""


def _last_mark(read, upto: int) -> bytes:
    """Last byte before a place that is no white space, within a megabyte."""
    least, at, step = max(0, upto - _PIECE), upto, _LITTLE
    while at > least:
        mark = read(max(least, at - step), at).rstrip()[-1:]
        if mark:
            return mark
        at, step = at - step, 2 * step
    return b""


def features_in(read, begin: int, end: int, size: int, state: int, depth: int) -> Iterator[bytes]:
    """Texts of the features that begin in [begin, end); ``read(a, b)`` gives bytes of the file."""
    wanted = 1 if _first_mark(read, size) == b"[" else 2
    before = _last_mark(read, begin)
    data, upto = read(begin, end), end
    at = 0
    if state != OUT:
        at, state = _skip_string(data, 0, state)
        if state != OUT:
            return
    started = None
    while True:
        resume = len(data)
        for token in _TOKENS.finditer(data, at):
            mark = token[0][:1]
            if mark == b'"':
                if token.end() >= len(data) - 1 and upto < size and not _STRINGS.fullmatch(token[0]):
                    resume = token.start()  # cut off, maybe behind a backslash: seen again with more bytes
                    break
            elif mark in b"{[":
                if depth == wanted and mark == b"{" and started is None and begin + token.start() < end:
                    last = _last_mark(lambda a, b: data[a:b], token.start())
                    if (last or before) in b"[,":
                        started = token.start()
                depth += 1
            else:
                depth -= 1
                if depth == wanted and started is not None:
                    yield data[started:token.end()]
                    started = None
        if started is None or upto >= size:
            break
        at, more = resume, read(upto, min(size, upto + max(_LITTLE, min(_PIECE, len(data)))))
        data, upto = data + more, upto + len(more)
    if started is not None:
        yield data[started:]


def _reader(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    file = store.open_input_file(name)

    def read(a: int, b: int) -> bytes:
        file.seek(a)
        return file.read(b - a)

    return read


def byte_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, size, begin, stop`` of the ranges of files (``path, length``), dealt over the tasks."""
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)).cast("bigint"),
                                  F.lit(range_bytes).cast("bigint")))
    rows = files.select("path", F.col("length").alias("size"), begins.alias("begin")).withColumn(
        "stop", F.least("size", F.col("begin") + range_bytes))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("begin")).alias("bytes")).first()
    return rows.repartition(_tasks(found["n"], found["bytes"] or 0), "path", "begin")


#: Ranges, and bytes of short ranges, that go to one task.
RANGES_PER_TASK, BYTES_PER_TASK = 1000, 8 << 20


def _tasks(ranges: int, size: int) -> int:
    """A range each for few ranges; many short ones share tasks, whose start costs more than they do."""
    by_size = max(math.ceil(ranges / RANGES_PER_TASK), math.ceil(size / BYTES_PER_TASK))
    return max(1, min(ranges, max(200, by_size)))


def read_features(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, document`` with a row per feature of the files (``path, length``), by byte ranges."""
    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, ranges in frame.groupby("path", sort=False):  # a file is opened once for its ranges here
                read = _reader(path)
                for r in ranges.itertuples(index=False):
                    data = read(r.begin, r.stop)
                    found = [advance(data, state) for state in (OUT, IN, ESCAPED)]
                    rows.append((path, r.size, r.begin, r.stop, [x[0] for x in found], [x[1] for x in found]))
            yield pd.DataFrame(rows, columns=["path", "size", "begin", "stop", "states", "deeper"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, many = [], 0
            for path, ranges in frame.groupby("path", sort=False):
                read = _reader(path)
                for r in ranges.itertuples(index=False):
                    for text in features_in(read, r.begin, r.stop, r.size, r.state, r.depth):
                        held.append((path, text.decode("utf-8", "replace")))
                        many += len(text)
                        if many >= _PIECE:
                            yield pd.DataFrame(held, columns=["path", "document"])
                            held, many = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "document"])

    ranges = byte_ranges(files, range_bytes)
    passed = ranges.mapInPandas(ends, "path string, size bigint, begin bigint, stop bigint, states array<int>, deeper array<bigint>")
    # A few small rows per file: a range for each 32 MB.
    earlier = F.collect_list(F.struct("states", "deeper")).over(
        Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    start = F.struct(F.lit(OUT).alias("state"), F.lit(0).cast("bigint").alias("depth"))
    here = F.aggregate(earlier, start, lambda a, x: F.struct(
        F.get(x["states"], a["state"]).alias("state"), (a["depth"] + F.get(x["deeper"], a["state"])).alias("depth")))
    placed = passed.withColumn("here", here).select("path", "size", "begin", "stop", "here.state", "here.depth")
    return placed.repartition(ranges.rdd.getNumPartitions(), "path", "begin").mapInPandas(
        cut, "path string, document string")
