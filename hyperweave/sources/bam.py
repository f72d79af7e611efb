"""BAM files: a data source that reads a file in splits, and a sink.

A BAM file is a chain of gzip members (blocks of at most 64 KB), so a split begins at the first block from its place in
the file on. Records cross blocks and blocks don't say where records begin: that place is found as the first one from
which ``CHAIN`` records in a row (or all up to the end) are well formed. A record belongs to the split that holds the
block it begins in. Each split also finds where the next one begins and compares that with where its own records end;
a difference is an error, so no record is lost or read twice. Files of plain gzip members are one split.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ALIGNMENTS = "file string, ordinal long, read_id string, flag int, contig string, mapq int, qlen int, qaln int"
ARROW = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("read_id", pa.string()), *((n, pa.string() if n == "contig" else pa.int32()) for n in ("flag", "contig", "mapq", "qlen", "qaln"))])
SPLIT_BYTES, CHAIN, BATCH, TRIM = 64 << 20, 8, 8192, 1 << 22
SPLIT_BITS = 33  # an ordinal is the split's number, then the place in it, so ordinals ascend in a file
OPS = "MIDNSHP=X"
MAGIC = b"\x1f\x8b\x08\x04"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # fixed by the format


def block_size(f: BinaryIO, at: int) -> int | None:
    """Size of the block that begins there, header included; None if none does."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    extra, i = f.read(struct.unpack_from("<H", head, 10)[0]), 0
    while i + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, i + 2)[0]
        if extra[i : i + 2] == b"BC" and size == 2 and i + 6 <= len(extra):
            return struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + size
    return None


def next_block(f: BinaryIO, at: int) -> int | None:
    """The first place from ``at`` on where a block begins that another one, or the end of the file, follows."""
    end = f.seek(0, os.SEEK_END)
    while at < end:
        f.seek(at)
        window = f.read(1 << 17)
        i = window.find(MAGIC)
        while i >= 0:
            size = block_size(f, at + i)
            if size and (at + i + size == end or at + i + size < end and block_size(f, at + i + size)):
                return at + i
            i = window.find(MAGIC, i + 1)
        if at + len(window) >= end:
            return None
        at += len(window) - len(MAGIC) + 1
    return None


class Stream:
    """The bytes of a file's blocks from one on; places are counted from its beginning."""

    def __init__(self, f: BinaryIO, at: int):
        self.f, self.next = f, at
        self.data, self.base = bytearray(), 0  # base: the place of data[0]
        self.begins, self.blocks = [], []  # places where blocks begin, and where they do so in the file

    def has(self, end: int) -> bool:
        while self.base + len(self.data) < end:
            size = block_size(self.f, self.next)
            if size is None:
                if self.f.seek(0, os.SEEK_END) > self.next:
                    raise ValueError(f"no block at {self.next}")
                return False
            self.f.seek(self.next)
            raw = zlib.decompress(self.f.read(size), 31)
            if raw:
                self.begins.append(self.base + len(self.data))
                self.blocks.append(self.next)
                self.data += raw
            self.next += size
        return True

    def get(self, at: int, n: int) -> bytes:
        if not self.has(at + n):
            raise ValueError("the file ends within a record")
        return bytes(self.data[at - self.base : at - self.base + n])

    def where(self, at: int) -> tuple[int, int] | None:
        """(block's place in the file, place in the block); None at the end of the file."""
        if not self.has(at + 1):
            return None
        i = bisect_right(self.begins, at) - 1
        return self.blocks[i], at - self.begins[i]

    def trim(self, at: int) -> None:
        """Forget what lies before, now and then."""
        if at - self.base > TRIM:
            del self.data[: at - self.base]
            self.base = at
            i = bisect_right(self.begins, at) - 1
            del self.begins[:i], self.blocks[:i]


def header(stream: Stream) -> tuple[str, list[str], int]:
    """(text, contigs' names, place of the first record)."""
    number = lambda at: struct.unpack("<i", stream.get(at, 4))[0]
    if stream.get(0, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    text, names = stream.get(8, at - 8).decode(errors="replace"), []
    count, at = number(at), at + 4
    for _ in range(count):
        size = number(at)
        names.append(stream.get(at + 4, size - 1).decode())
        at += 8 + size
    return text, names, at


def well_formed(stream: Stream, at: int, n_contigs: int) -> int | None:
    """The place after the record that may begin there; None if none can."""
    if not stream.has(at + 37):
        return None
    size, ref, pos, name_len, _, _, n_ops, _, seq_len, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", stream.get(at, 36))
    if not (-1 <= ref < n_contigs and -1 <= mate < n_contigs and pos >= -1 and mate_pos >= -1 and name_len > 0 and seq_len >= 0):
        return None
    if 32 + name_len + 4 * n_ops + (seq_len + 1) // 2 + seq_len > size or not stream.has(at + 36 + name_len + 4 * n_ops):
        return None
    name = stream.get(at + 36, name_len)
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    if any(o & 15 >= len(OPS) for o in struct.unpack(f"<{n_ops}I", stream.get(at + 36 + name_len, 4 * n_ops))):
        return None
    return at + 4 + size


def first_record(stream: Stream, n_contigs: int) -> int | None:
    """The first place from which records are well formed; None if no record begins in the rest of the file."""
    at = 0
    while stream.has(at + 37):
        next_one, seen = well_formed(stream, at, n_contigs), 1
        while next_one is not None and seen < CHAIN and stream.has(next_one + 1):
            next_one, seen = well_formed(stream, next_one, n_contigs), seen + 1
        if next_one is not None and (seen == CHAIN or stream.has(next_one)):
            return at
        at += 1
    return None


def fields(record: bytes, names: list[str]) -> tuple:
    """(read_id, flag, contig, mapq, qlen, qaln)."""
    ref, _, name_len, mapq, _, n_ops, flag, seq_len = struct.unpack_from("<iiBBHHHi", record)
    ops = struct.unpack_from(f"<{n_ops}I", record, 32 + name_len)
    total = lambda kinds: sum(o >> 4 for o in ops if OPS[o & 15] in kinds)
    return record[32 : 31 + name_len].decode(), flag, names[ref] if ref >= 0 else "*", mapq, seq_len or total("MIS=X"), total("MI=X")


def split_records(path: str, begin: int, end: int | None) -> Iterator[tuple]:
    """The fields of the records of one split; ``end`` None: the last."""
    with open(path, "rb") as f:
        whole = Stream(f, 0) if block_size(f, 0) else Plain(path)
        _, names, at = header(whole)
        stream = whole
        if begin:
            first = next_block(f, begin)
            stream = Stream(f, f.seek(0, os.SEEK_END) if first is None else first)
            at = first_record(stream, len(names))
        while at is not None and stream.has(at + 1) and (end is None or stream.where(at)[0] < end):
            size = struct.unpack("<i", stream.get(at, 4))[0]
            yield fields(stream.get(at + 4, size), names)
            at += 4 + size
            stream.trim(at)
        if end is not None:
            first, found = next_block(f, end), None
            if first is not None:
                after = Stream(f, first)
                start = first_record(after, len(names))
                found = None if start is None else after.where(start)
            if found != (None if at is None else stream.where(at)):
                raise ValueError(f"{path}: records around {end} cannot be told apart; read it with splitBytes 0")


class Plain(Stream):
    """A file of other gzip members, as one block."""

    def __init__(self, path: str):
        self.gzip, self.data, self.base = gzip.open(path, "rb"), bytearray(), 0

    def has(self, end: int) -> bool:
        while self.base + len(self.data) < end:
            more = self.gzip.read(1 << 20)
            if not more:
                return False
            self.data += more
        return True

    def trim(self, at: int) -> None:
        if at - self.base > TRIM:
            del self.data[: at - self.base]
            self.base = at


def sort_order(path: str) -> str | None:
    """The order that a file's header declares."""
    with open(path, "rb") as f:
        text = header(Stream(f, 0) if block_size(f, 0) else Plain(path))[0]
    found = re.search(r"^@HD\t(?:.*\t)?SO:(\w+)", text, re.MULTILINE)
    return found[1] if found else None


class BamDataSource(DataSource):
    """``spark.read.format("hyperweave_bam").option("paths", "a.bam,b.bam").load()``; files on storage all executors mount.

    ``splitBytes``: compressed bytes of a split; 0: a file is one split."""

    @classmethod
    def name(cls) -> str:
        return "hyperweave_bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> DataSourceReader:
        return BamReader((self.options.get("paths") or self.options["path"]).split(","), int(self.options.get("splitBytes", SPLIT_BYTES)))


class Split(InputPartition):
    def __init__(self, path: str, number: int, begin: int, end: int | None):
        self.path, self.number, self.begin, self.end = path, number, begin, end


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                size, blocks = os.path.getsize(path), block_size(f, 0)
            step = self.split_bytes if blocks and self.split_bytes > 0 else size + 1
            begins = list(range(0, size, step)) or [0]
            out += [Split(path, i, b, e) for i, (b, e) in enumerate(zip(begins, [*begins[1:], None]))]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        rows, place = [], split.number << SPLIT_BITS
        for record in split_records(split.path, split.begin, split.end):
            rows.append((split.path, place, *record))
            place += 1
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)


def block(raw: bytes) -> bytes:
    """One block of a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def write_bam(records: DataFrame, folder: str, contigs: list[str], per_block: int = 60_000) -> list[str]:
    """Files, one for each partition, of ``records(read_id, flag, contig, mapq, cigar)`` without sequences, in the order
    of each partition; ``contigs`` go to every header. Returns the files. The folder lies on storage all executors mount."""
    number = {c: i for i, c in enumerate(contigs)}
    head = b"BAM\1" + struct.pack("<ii", 0, len(contigs)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", 0) for c in contigs)
    shared = records.sparkSession.sparkContext.broadcast((number, head))  # as large as the files' own headers
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, head = shared.value
        task = TaskContext.get()
        path, trial = f"{folder}/part-{task.partitionId():05d}.bam", f"{folder}/.{task.taskAttemptId()}"
        pending, n = bytearray(head), 0
        with open(trial, "wb") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    ops = [int(size) << 4 | OPS.index(op) for size, op in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
                    name = r["read_id"].encode()
                    body = struct.pack(f"<iiBBHHHiiii{len(name) + 1}s{len(ops)}I", number.get(r["contig"], -1), 0, len(name) + 1, r["mapq"], 0, len(ops), r["flag"], 0, -1, -1, 0, name, *ops)
                    pending += struct.pack("<i", len(body)) + body
                    n += 1
                    while len(pending) >= per_block:
                        f.write(block(bytes(pending[:per_block])))
                        del pending[:per_block]
            f.write((block(bytes(pending)) if pending else b"") + END_OF_FILE)
        os.replace(trial, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    done = records.select("read_id", "flag", "contig", "mapq", "cigar").mapInArrow(write, "path string, n long").collect()
    return sorted(r.path for r in done)
