"""GFA by byte ranges: a Python data source whose tasks read bounded ranges of a file, and a sink that writes paths piece by piece.

A line belongs to the range in which it starts, but the steps of a P line belong to the range in which each of them starts, and come in
pieces of ``CHUNK`` steps at most. So neither a task nor a row holds a path, however long its line is. A range that begins within a line
cannot know whose steps it reads; it numbers them from 0 and says at its end what is open. These states, one row a range, are then applied one after
the other along each file, and give every piece its path and the rank of its first step.

Files are opened through ``pyarrow.fs``: local paths and the stores that it knows. For a store that only Spark reads there is
:func:`braidframe.sources.gfa.read_gfa`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..model import CHUNK, Graph, canonical
from ..plans.loops import checkpointed
from .gfa import GraphError, numbered

RANGE_BYTES, BLOCK = 64 << 20, 1 << 20
#: Places of a file among others: file number and offset in one long.
_FILE_BITS = 44
_STEP = re.compile(rb"(\d+)([+-])")
_CIRCULAR = b"TP:Z:circular"

FIELDS = (
    "kind string, range_no long, file_no long, at long, name string, seq string, a string, a_rev boolean, b string, b_rev boolean,"
    " tabs int, first long, ids array<long>, revs array<boolean>, bad long, open_tabs int, seen array<long>, ended boolean"
)
_NAMES = [x.split()[0] for x in FIELDS.split(",")]


def row(kind: str, **values: object) -> tuple:
    return tuple(kind if n == "kind" else values.get(n) for n in _NAMES)


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", path) else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The file, or the files of the folder in order of their names, with their sizes."""
    store, place = located(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    found = store.get_file_info(fs.FileSelector(place))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


@dataclass
class ByteRange(InputPartition):
    path: str
    file_no: int
    range_no: int
    lo: int
    hi: int


class Window:
    """A file's bytes from some place on, read in blocks."""

    def __init__(self, file: pa.NativeFile, at: int):
        file.seek(at)
        self.file, self.at, self.ended = file, at, False
        self.held, self.pos = b"", 0

    def left(self) -> int:
        return len(self.held) - self.pos

    def more(self) -> bool:
        block = b"" if self.ended else self.file.read(BLOCK)
        self.ended = not block
        self.held, self.pos = self.held[self.pos :] + block, 0
        return not self.ended

    def starts(self, what: bytes) -> bool:
        return self.held.startswith(what, self.pos)

    def take(self, n: int) -> bytes:
        out = self.held[self.pos : self.pos + n]
        self.pos += len(out)
        self.at += len(out)
        return out

    def ahead(self, *delimiters: bytes, looked: int = 0) -> int:
        """How far the next of ``delimiters`` is in what is held, -1 if it is not there."""
        places = [i for d in delimiters if (i := self.held.find(d, self.pos + looked)) >= 0]
        return min(places) - self.pos if places else -1

    def upto(self, *delimiters: bytes) -> bytes:
        """What stands before the next of ``delimiters`` or the file's end, all of it held: for names and whole lines."""
        looked = 0
        while (n := self.ahead(*delimiters, looked=looked)) < 0:
            looked = self.left()
            if not self.more():
                n = self.left()
                break
        return self.take(n)

    def skip_to(self, *delimiters: bytes) -> bool:
        """Drops what stands before the next of ``delimiters`` block by block; false at the file's end."""
        while (n := self.ahead(*delimiters)) < 0:
            self.take(self.left())
            if not self.more():
                return False
        self.take(n)
        return True


class RangeReader:
    """The rows of one byte range."""

    def __init__(self, part: ByteRange, file: pa.NativeFile, chunk: int):
        self.part, self.chunk = part, chunk
        self.before = b"\n"
        if part.lo:
            file.seek(part.lo - 1)
            self.before = file.read(1)
        self.window = Window(file, part.lo)

    def _place(self, at: int) -> int:
        return self.part.file_no << _FILE_BITS | at

    def _field(self, owner: dict, tabs: int, counts: list[int]) -> Iterator[tuple]:
        """The steps of one field that start in the range, in pieces; counts[tabs] is how many tokens there were."""
        w, ids, revs, bad, first = self.window, [], [], 0, 0
        while True:
            n, delimited = w.ahead(b"\t", b"\n"), True
            if n < 0 and w.ended:
                n = w.left()
            elif n < 0:
                n, delimited = w.held.rfind(b",", w.pos) - w.pos, False
                if n < 0:
                    w.more()
                    continue
            segment = w.held[w.pos : w.pos + n]
            room = self.part.hi - w.at
            cut = segment.find(b",", max(room - 1, 0))
            over = room <= 0 or cut >= 0
            if room <= 0:
                segment = b""
            elif cut >= 0:
                segment = segment[:cut]
            if segment == _CIRCULAR:
                yield row("C", **owner, tabs=tabs)
            elif segment:
                for token in segment.split(b","):
                    counts[tabs] += 1
                    step = _STEP.fullmatch(token)
                    if step is None:
                        bad += token != b"*"
                        counts[tabs] -= token == b"*"
                        continue
                    ids.append(int(step[1]))
                    revs.append(step[2] == b"-")
                    if len(ids) == self.chunk:
                        yield row("p", **owner, tabs=tabs, first=first, ids=ids, revs=revs, bad=bad)
                        first, ids, revs, bad = first + len(ids), [], [], 0
            w.take(len(segment))
            if over or delimited:
                break
            w.take(1)  # the comma
        if ids or bad:
            yield row("p", **owner, tabs=tabs, first=first, ids=ids, revs=revs, bad=bad)

    def _steps(self, owner: dict, tabs: int) -> Iterator[tuple]:
        """The rest of a line from a field's or token's start on, as far as it lies in the range, and what is open at the range's end."""
        w, hi, counts = self.window, self.part.hi, [0] * (tabs + 1)
        ended = False
        while w.at < hi:
            yield from self._field(owner, tabs, counts)
            if not w.left() and not w.more():
                ended = True
                break
            if w.at >= hi or w.starts(b","):
                break
            if w.take(1) == b"\n":
                ended = True
                break
            tabs += 1
            counts.append(0)
        yield row("R", **owner, open_tabs=tabs, seen=counts, ended=ended)

    def rows(self) -> Iterator[tuple]:
        w, part = self.window, self.part
        mine = {"range_no": part.range_no, "file_no": part.file_no}
        if self.before in (b",", b"\t"):
            yield from self._steps(mine, 0)
        elif self.before != b"\n":
            if not w.skip_to(b",", b"\t", b"\n") or w.at >= part.hi:
                return  # the range lies within one token
            delimiter = w.take(1)
            if delimiter == b"\n":
                yield row("R", **mine, open_tabs=0, seen=[0], ended=True)
            else:
                yield from self._steps(mine, int(delimiter == b"\t"))
        while w.at < part.hi and (w.left() or w.more()):
            start = w.at
            if w.left() < 2:
                w.more()
            if not w.starts(b"P\t"):
                line = w.upto(b"\n")
                w.take(1)
                yield from self._line(line, mine | {"at": self._place(start)})
                continue
            w.take(2)
            owner = mine | {"at": self._place(start)}
            yield row("P", **owner, name=w.upto(b"\t", b"\n").decode())
            # tabs that lie in the range: the one behind P and the one behind the name
            tabs = int(start + 1 < part.hi) + int(w.at < part.hi)
            if w.take(1) != b"\t":
                continue
            yield from self._steps(owner, tabs)

    def _line(self, line: bytes, mine: dict) -> Iterator[tuple]:
        f = line.rstrip(b"\r").decode().split("\t")
        if f[0] == "S" and len(f) > 2:
            yield row("S", **mine, name=f[1], seq=f[2])
        elif f[0] == "L" and len(f) > 4:
            yield row("L", **mine, a=f[1], a_rev=f[2] == "-", b=f[3], b_rev=f[4] == "-")
        elif f[0]:
            yield row(f[0][:1] if f[0][:1] in "HWCJ" else "?", **mine)


class GfaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.chunk = int(options.get("chunksteps", CHUNK))

    def partitions(self) -> list[ByteRange]:
        out: list[ByteRange] = []
        for k, (path, size) in enumerate(files_of(self.path)):
            out += [ByteRange(path, k, i, lo, min(lo + self.bytes, size)) for i, lo in enumerate(range(0, size, self.bytes))]
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with located(self.path)[0].open_input_file(partition.path) as file:
            yield from RangeReader(partition, file, self.chunk).rows()


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str


class GfaWriter(DataSourceWriter):
    """Writes the texts of (text) rows one behind the other, a file for each task; files get their names when all are done."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid4().hex[:8]

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, place = located(self.path)
        store.create_dir(place, recursive=True)
        path = f"{place}/.{self.run}-{context.partitionId():06d}-{context.attemptNumber()}"
        empty = True
        with store.open_output_stream(path, buffer_size=BLOCK) as out:
            for r in iterator:
                out.write(r[0].encode())
                empty = False
        if empty:
            store.delete_file(path)
        return Written(context.partitionId(), "" if empty else path)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = located(self.path)
        for m in sorted((m for m in messages if m and m.path), key=lambda m: m.part):
            store.move(m.path, f"{place}/part-{m.part:06d}-{self.run}.gfa")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = located(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class GfaSource(DataSource):
    """``spark.read.format("gfa").load(path)``: lines and pieces of paths by byte range; options rangeBytes, chunkSteps."""

    @classmethod
    def name(cls) -> str:
        return "gfa"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> GfaReader:
        return GfaReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> GfaWriter:
        if overwrite and files_of(self.options["path"]):
            raise ValueError("the gfa sink writes to a new folder")
        return GfaWriter(self.options["path"])


def raw_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, chunk_steps: int = CHUNK) -> DataFrame:
    spark.dataSource.register(GfaSource)
    return spark.read.format("gfa").option("rangeBytes", range_bytes).option("chunkSteps", chunk_steps).load(path)


def carried_states(records: DataFrame) -> DataFrame:
    """file_no, range_no, line (at), shift, base: the P line that is open where a range begins, its tabs so far, and its steps so far.

    One row a range is applied after the other along a file; a range without a state of its own lies within one token.
    """
    import pandas as pd

    def scan(d: pd.DataFrame) -> pd.DataFrame:
        out, line, shift, steps = [], None, 0, 0
        for r in d.sort_values(["range_no", "first"]).itertuples():
            if r.first < 0:  # what came before goes on
                if line is not None:
                    out.append((r.file_no, r.range_no, line, shift, steps))
                    k = 2 - shift
                    steps += int(r.seen[k]) if 0 <= k < len(r.seen) else 0
                    shift += int(r.open_tabs)
                if r.ended:
                    line = None
            else:  # a line that starts in the range stays open
                line, shift, steps = int(r.first), int(r.open_tabs), int(r.seen[2]) if len(r.seen) > 2 else 0
        return pd.DataFrame(out, columns=["file_no", "range_no", "line", "shift", "base"])

    # of the lines that start in a range only the last can be open; the state of the one that goes on into it comes first
    states = records.filter("kind = 'R' AND (at IS NULL OR NOT ended)")
    states = states.select("file_no", "range_no", "open_tabs", "seen", "ended", F.coalesce("at", F.lit(-1).cast("long")).alias("first"))
    return states.groupBy("file_no").applyInPandas(scan, "file_no long, range_no long, line long, shift int, base long")


def owned_pieces(records: DataFrame) -> DataFrame:
    """kind (p, C), line, field, first, ids, revs, bad of all P lines, with ranks along the whole line."""
    pieces = records.filter("kind IN ('p', 'C')")
    own = pieces.filter("at IS NOT NULL").select("kind", F.col("at").alias("line"), F.col("tabs").alias("field"), "first", "ids", "revs", "bad")
    rest = pieces.filter("at IS NULL").join(carried_states(records), ["file_no", "range_no"])
    field = F.col("shift") + F.col("tabs")
    first = F.col("first") + F.when(F.col("tabs") == 0, F.col("base")).otherwise(0)
    return own.union(rest.select("kind", "line", field.alias("field"), first.alias("first"), "ids", "revs", "bad"))


def read_gfa_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, chunk_steps: int = CHUNK, checked: bool = True) -> Graph:
    """The graph of a file, or of a folder of files, as :func:`braidframe.sources.gfa.read_gfa` gives it; the text is read once."""
    records = checkpointed(raw_records(spark, path, range_bytes, chunk_steps))
    s = records.filter("kind = 'S'").select("at", "name", "seq")
    if checked and not s.filter(~F.col("name").rlike(r"^\d+$")).isEmpty():
        raise GraphError("node names must be numbers")
    nodes = numbered(s.select("at", F.col("name").cast("long").alias("node_id"), "seq", F.length("seq").cast("long").alias("len")), "node_rank").select("node_id", "seq", "len", "node_rank")
    if checked and not nodes.groupBy("node_id").count().filter("count > 1").isEmpty():
        raise GraphError("node ids must be unique")
    edges = records.filter("kind = 'L'").select(canonical(F.col("a").cast("long"), F.col("a_rev"), F.col("b").cast("long"), F.col("b_rev")).alias("e")).select("e.*").dropDuplicates()
    if checked:
        known = nodes.select("node_id")
        for end in ("from_id", "to_id"):
            if not edges.join(known, edges[end] == known["node_id"], "left_anti").isEmpty():
                raise GraphError("an edge ends at an unknown node")
    pieces = checkpointed(owned_pieces(records))
    if checked and not pieces.filter("kind = 'p' AND field = 2 AND bad > 0").isEmpty():
        raise GraphError("a step is not a number with a sign")
    heads = numbered(records.filter("kind = 'P'").select("at", F.col("name").alias("path_name")), "path_id")
    circular = pieces.filter("kind = 'C' AND field > 2").select(F.col("line").alias("at")).distinct().withColumn("is_circular", F.lit(True))
    paths = heads.join(circular, "at", "left").select("path_id", "path_name", F.coalesce("is_circular", F.lit(False)).alias("is_circular"))
    p = pieces.filter("kind = 'p' AND field = 2").join(heads.select(F.col("at").alias("line"), "path_id"), "line")
    steps = p.select("path_id", "first", F.posexplode(F.arrays_zip("ids", "revs")).alias("k", "s"))
    steps = steps.select("path_id", (F.col("first") + F.col("k")).alias("step_rank"), F.col("s.ids").alias("node_id"), F.col("s.revs").alias("is_rev"))
    return Graph(nodes, edges, paths, steps)


def gfa_pieces(g: Graph, chunk_steps: int = CHUNK) -> DataFrame:
    """section, key, piece, text: the records of a file, each with its line end; a path's steps in pieces of ``chunk_steps`` at most."""
    from .gfa import gfa_lines

    sign = F.when(F.col("is_rev"), "-").otherwise("+")
    whole = gfa_lines(g.with_(paths=g.paths.limit(0), steps=g.steps.limit(0)))
    whole = whole.select("section", "key", F.lit(0).cast("long").alias("piece"), F.concat("line", F.lit("\n")).alias("text"))
    head = g.paths.select(F.lit(3).alias("section"), F.col("path_id").alias("key"), F.lit(-1).cast("long").alias("piece"), F.concat(F.lit("P\t"), "path_name", F.lit("\t")).alias("text"))
    tail = F.concat(F.lit("\t*"), F.when(F.col("is_circular"), f"\t{_CIRCULAR.decode()}").otherwise(""), F.lit("\n"))
    foot = g.paths.select(F.lit(3).alias("section"), F.col("path_id").alias("key"), F.lit(1 << 62).cast("long").alias("piece"), tail.alias("text"))
    chunk = F.floor(F.col("step_rank") / chunk_steps).cast("long")
    walk = g.steps.groupBy("path_id", chunk.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("step_rank", F.concat(F.col("node_id").cast("string"), sign).alias("seg")))).alias("w"))
    text = F.concat(F.when(F.col("piece") > 0, ",").otherwise(""), F.array_join(F.transform("w", lambda x: x["seg"]), ","))
    body = walk.select(F.lit(3).alias("section"), F.col("path_id").alias("key"), "piece", text.alias("text"))
    return whole.union(head).union(body).union(foot)


def write_gfa_pieces(g: Graph, path: str, chunk_steps: int = CHUNK) -> None:
    """A new folder of GFA files, to be read in order of their names. A line's pieces follow each other in one task, which holds one at a time."""
    g.spark.dataSource.register(GfaSource)
    p = gfa_pieces(g, chunk_steps).repartitionByRange("section", "key").sortWithinPartitions("section", "key", "piece", "text")
    p.select("text").write.format("gfa").mode("append").save(path)
