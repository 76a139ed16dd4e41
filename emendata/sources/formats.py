"""Correction formats as data sources by name: `spark.read.format("emendata_pairs").option("kind", "m2").load(folder)`.

A file is cut at byte borders into pieces of `block_bytes`; a block of lines belongs to the piece in which it begins, so
that one large file is read by many tasks, each of which reads pieces that follow one another. Simple comparisons with constants are taken over by the reader. The writer
`emendata_splits` stages each task's files, and its commit publishes all of them with a manifest of counts and digests,
or accepts that the same rows are there already, or refuses.
"""

from __future__ import annotations

import io
import json
import re
import sys
import tarfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from typing import Any

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

#: Bytes of one partition, and of the longest line or block.
BLOCK_BYTES, MOST_BYTES = 64_000_000, 1_000_000
#: Least number of tasks to which pieces are dealt, where there are as many, before a task gets BLOCK_BYTES; rows of one batch.
TASKS, BATCH_ROWS = 200, 10_000
SCHEMA = "file string, start long, source string, target string, annotator string, reject_reason string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _store(path: str):
    """The file system of a path and the path in it: local ones, and those that pyarrow knows by their scheme."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in every if x.type == fs.FileType.File and not re.search(r"(^|/)[._][^/]*$", x.path))


# --- blocks


def _lines(stream, start: int, stop: int, base: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Lines (offset, bytes) that begin in [start, stop) of a stream whose own bytes are [base, end)."""
    at = max(start - 1, 0)
    stream.seek(base + at)
    if start:  # the line before ends where one begins
        at += len(_line(stream, base, at, end))
    while at < stop:
        line = _line(stream, base, at, end)
        if not line:
            return
        yield at, line
        at += len(line)


def _line(stream, base: int, at: int, end: int | None) -> bytes:
    line = stream.readline(MOST_BYTES if end is None else min(MOST_BYTES, end - base - at))
    if len(line) == MOST_BYTES and not line.endswith(b"\n"):
        raise ValueError(f"a line of over {MOST_BYTES} bytes")
    return line


def _paragraphs(stream, start: int, stop: int, base: int = 0, end: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """Runs of lines between blank ones whose first line begins in [start, stop)."""
    first, run, size = None, [], 0
    inside = False  # a line before the start is not blank: its run is another partition's
    if start:
        for at, line in _lines(stream, _line_before(stream, start, base), start, base, end):
            inside = bool(line.strip())
    for at, line in _lines(stream, start, 1 << 62, base, end):
        if line.strip():
            if inside:
                continue
            if first is None:
                if at >= stop:
                    return
                first = at
            run.append(line.decode().rstrip("\r\n"))
            size += len(line)
            if size > MOST_BYTES:
                raise ValueError(f"a block of over {MOST_BYTES} bytes")
        else:
            inside = False
            if run:
                yield first, run
                first, run, size = None, [], 0
            if at >= stop:
                return
    if run:
        yield first, run


def _line_before(stream, start: int, base: int) -> int:
    """The offset of the last line that begins before start."""
    back = 4096
    while True:
        at = max(0, start - back)
        stream.seek(base + at)
        held = stream.read(start - at - 1)
        cut = held.rfind(b"\n")
        if cut >= 0:
            return at + cut + 1
        if at == 0:
            return 0
        back *= 4


# --- formats: rows (source, target, annotator, reject_reason) of a block


def _m2(lines: list[str]) -> Iterator[tuple]:
    """A2: an S line and A lines; a pair for each annotator, edits put in from the right."""
    if not lines[0].startswith("S ") and lines[0] != "S":
        raise ValueError("a block without a source line")
    words, notes = lines[0][2:].split(), {}
    for line in lines[1:]:
        if not line.startswith("A "):
            raise ValueError("a line that is neither source nor annotation")
        spans, kind, tokens, *_, who = line[2:].split("|||")
        start, stop = map(int, spans.split())
        notes.setdefault(who, []).append((start, stop, kind, tokens))
    for who in sorted(notes) or ["0"]:
        edits = sorted(e for e in notes.get(who, []) if e[2] != "noop")
        source = " ".join(words)
        if any(e[2] == "noop" and e[:2] != (-1, -1) for e in notes.get(who, [])):
            raise ValueError("a noop with a span")
        if any(e[2] == "UNK" for e in edits):
            yield source, None, who, "unresolved_annotation"
        elif any(a[1] > b[0] or a[:2] == b[:2] for a, b in zip(edits, edits[1:], strict=False)):
            yield source, None, who, "overlapping_annotation"
        else:
            out = list(words)
            for start, stop, _, tokens in reversed(edits):
                out[start:stop] = [] if tokens in ("-NONE-", "") else tokens.split()
            yield source, " ".join(out), who, None


def _tsv(line: str) -> Iterator[tuple]:
    """A4."""
    source, target = line.split("\t")  # exactly two, or an error
    yield source, target, None, None


_DELETED, _ADDED = re.compile(r"\[-(.*?)-\]"), re.compile(r"\{\+(.*?)\+\}")


def _word_diff(line: str) -> Iterator[tuple]:
    """A6."""
    tidy = lambda x: " ".join(x.split())
    source, target = tidy(_ADDED.sub("", _DELETED.sub(r"\1", line))), tidy(_DELETED.sub("", _ADDED.sub(r"\1", line)))
    wrong = any(mark in x for x in (source, target) for mark in ("[-", "-]", "{+", "+}"))
    yield source, target, None, "invalid_wdiff" if wrong else None


def _jsonl(line: str) -> Iterator[tuple]:
    """A14."""
    row = json.loads(line)
    yield row.get("source"), row.get("target"), row.get("annotator"), None


#: A10: formats by name; blocks of lines, or single lines.
KINDS: dict[str, tuple[bool, Callable]] = {"m2": (True, _m2), "tsv": (False, _tsv), "wdiff": (False, _word_diff), "jsonl": (False, _jsonl)}


@dataclass
class Piece(InputPartition):
    """Bytes [start, stop) of a file, or of a member that lies at [base, end) of an archive."""

    file: str
    start: int
    stop: int
    base: int = 0
    end: int | None = None
    member: str | None = None


class PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.path, self.bytes = options["kind"], options["path"], int(options.get("block_bytes", BLOCK_BYTES))
        self.members = [x for x in options.get("members", "").split(",") if x]
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}; one of {sorted(KINDS)}")
        self.equal: list[tuple[str, list[Any]]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and presence are the reader's; others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo):
                self.equal.append((f.attribute[0], [f.value]))
            elif isinstance(f, In):
                self.equal.append((f.attribute[0], list(f.value)))
            elif isinstance(f, IsNotNull):
                self.present.append(f.attribute[0])
            else:
                yield f

    def partitions(self) -> list[Piece]:
        out = []
        for file, size in _files(self.path):
            if file.endswith(".tar"):  # A3: members of an archive, each cut as a file would be
                store, _ = _store(self.path)
                with store.open_input_file(file) as raw, tarfile.open(fileobj=raw) as archive:
                    found = {m.name: m for m in archive if m.isfile()}
                missing = sorted(set(self.members) - set(found))
                if missing:
                    raise ValueError(f"{file} lacks {missing}")
                for name in self.members or sorted(found):
                    m = found[name]
                    out += [Piece(file, k, min(k + self.bytes, m.size), m.offset_data, m.offset_data + m.size, name) for k in range(0, m.size, self.bytes)]
            else:
                out += [Piece(file, k, min(k + self.bytes, size)) for k in range(0, size, self.bytes)]
        return out or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.file:
            return
        with self._opened(piece.file) as stream:
            yield from self._rows(stream, piece)

    @contextmanager
    def _opened(self, file: str):
        store, _ = _store(self.path)
        with store.open_input_file(file) as raw, io.BufferedReader(raw, 1 << 20) as stream:
            yield stream

    def _rows(self, stream, piece: Piece) -> Iterator[tuple]:
        blocks, parse = KINDS[self.kind]
        name = piece.file if piece.member is None else f"{piece.file}!{piece.member}"
        equal, present = [(NAMES.index(c), values) for c, values in self.equal], [NAMES.index(c) for c in self.present]
        read = _paragraphs if blocks else _lines
        for at, body in read(stream, piece.start, piece.stop, piece.base, piece.end):
            if not blocks:
                body = body.decode().rstrip("\r\n")
                if not body.strip():
                    continue
            for made in parse(body):
                row = (name, at, *made)
                if all(row[c] in values and row[c] is not None for c, values in equal) and all(row[c] is not None for c in present):
                    yield row


@dataclass
class Run(InputPartition):
    """Pieces that follow one another, the work of one task."""

    pieces: list[Piece]


class RunReader(PairReader):
    """What Spark reads by: pieces are dealt to a bounded number of tasks, and rows go to the JVM by columns."""

    def partitions(self) -> list[Run]:
        pieces = super().partitions()
        most = min(BLOCK_BYTES, sum(p.stop - p.start for p in pieces) // TASKS)
        runs, held = [], most + 1
        for p in pieces:
            if held + p.stop - p.start > most:
                runs.append(Run([]))
                held = 0
            runs[-1].pieces.append(p)
            held += p.stop - p.start
        return runs

    def read(self, run: Run) -> Iterator:
        import pyarrow as pa

        types = [pa.int64() if x.endswith(" long") else pa.string() for x in SCHEMA.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)
        rows, held = [], 0
        for file, pieces in groupby(run.pieces, lambda p: p.file):
            if not file:
                continue
            with self._opened(file) as stream:
                for row in (row for piece in pieces for row in self._rows(stream, piece)):
                    rows.append(row)
                    held += len(row[2] or "") + len(row[3] or "")
                    if len(rows) == BATCH_ROWS or held > MOST_BYTES:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)


class PairSource(DataSource):
    """A1, A2, A3, A4, A6, A10, A14."""

    @classmethod
    def name(cls) -> str:
        return "emendata_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        return RunReader(dict(self.options))


# --- immutable splits


@dataclass
class Staged(WriterCommitMessage):
    """A task's files by split with their rows and the sums of their rows' digests."""

    files: dict[str, str]
    rows: dict[str, int]
    digests: dict[str, int]


class SplitWriter(DataSourceWriter):
    """JSON lines by the column `split`, published together with a manifest."""

    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def _at(self, *parts: str):
        store, root = _store(self.path)
        return store, "/".join([root.rstrip("/"), *parts])

    def write(self, rows: Iterator[Row]) -> Staged:
        out, files, counts, sums = {}, {}, {}, {}
        task = uuid.uuid4().hex
        try:
            for row in rows:
                body = json.dumps(row.asDict(recursive=True), ensure_ascii=False, sort_keys=True, default=str).encode() + b"\n"
                split = row["split"]
                if split not in out:
                    store, at = self._at(f"_staged-{self.run}")
                    store.create_dir(at)
                    files[split] = f"{split}-{task}.jsonl"
                    out[split] = store.open_output_stream(f"{at}/{files[split]}")
                out[split].write(body)
                counts[split] = counts.get(split, 0) + 1
                sums[split] = (sums.get(split, 0) + int(sha256(body).hexdigest()[:30], 16)) % (1 << 120)
        finally:
            for f in out.values():
                f.close()
        return Staged(files, counts, sums)

    def _discard(self) -> None:
        from pyarrow import fs

        store, at = self._at(f"_staged-{self.run}")
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        done = [m for m in messages if m is not None]
        splits = sorted({s for m in done for s in m.rows})
        mine = {s: {"rows": sum(m.rows.get(s, 0) for m in done), "digest": f"{sum(m.digests.get(s, 0) for m in done) % (1 << 120):030x}"} for s in splits}
        store, manifest = self._at("_manifest.json")
        if store.get_file_info(manifest).type != fs.FileType.NotFound:
            with store.open_input_stream(manifest) as f:
                there = json.loads(f.read())
            self._discard()
            if there != mine:
                raise ValueError("the path holds other rows")
            return
        _, top = self._at()
        if any(not x.base_name.startswith("_staged-") for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True))):
            self._discard()
            raise ValueError("the path is not empty")
        for m in done:
            for split, name in m.files.items():
                store.create_dir(f"{top}/split={split}")
                store.move(f"{top}/_staged-{self.run}/{name}", f"{top}/split={split}/{name}")
        store.create_dir(top)
        with store.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps(mine, sort_keys=True).encode())
        store.move(f"{manifest}.new", manifest)  # the last step: without a manifest nothing counts as published
        self._discard()

    def abort(self, messages: list[Staged | None]) -> None:
        self._discard()


class SplitSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "emendata_splits"

    def schema(self) -> str:
        return "split string"

    def writer(self, schema, overwrite: bool) -> SplitWriter:
        if overwrite:
            raise ValueError("splits are immutable")
        return SplitWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """spark with both sources known by name, and filters handed to Python sources.

    They travel by value: the processes that plan a Python source don't have the packages that executors get.
    """
    register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PairSource, SplitSink):
        spark.dataSource.register(source)
    return spark
