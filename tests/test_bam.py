"""BAM files in splits."""

import struct
import zlib

import numpy as np
import pytest

from hyperweave.sources import bam

NAMES = ["c0", "c1", "c2"]


def _write(path, rng, records, per_block):
    """A file with records of random sizes, some longer than many blocks; returns their fields."""
    raw = b"BAM\1" + struct.pack("<i", 12) + b"@HD\tSO:query" + struct.pack("<i", 3) + b"".join(struct.pack("<i", 3) + n.encode() + b"\0" + struct.pack("<i", 9) for n in NAMES)
    want = []
    for i in range(records):
        seq_len = int(rng.choice([0, 5, 300, 3000], p=[0.3, 0.3, 0.3, 0.1]))
        ops, name = [int(rng.integers(1, 99)) << 4 | int(o) for o in rng.integers(0, 9, rng.integers(0, 6))], f"r{i}" * int(rng.integers(1, 4))
        ref, flag, mapq = int(rng.integers(-1, 3)), int(rng.integers(0, 4096)), int(rng.integers(0, 256))
        rest = rng.integers(0, 256, (seq_len + 1) // 2 + seq_len + int(rng.integers(0, 40)), np.uint8).tobytes()
        body = struct.pack("<iiBBHHHiiii", ref, 0, len(name) + 1, mapq, 0, len(ops), flag, seq_len, -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + rest
        raw += struct.pack("<i", len(body)) + body
        total = lambda kinds: sum(o >> 4 for o in ops if bam.OPS[o & 15] in kinds)  # noqa: B023, E731
        want.append((name, flag, NAMES[ref] if ref >= 0 else "*", mapq, seq_len or total("MIS=X"), total("MI=X")))
    path.write_bytes(b"".join(bam.block(raw[i : i + per_block]) for i in range(0, len(raw), per_block)) + bam.END_OF_FILE)
    return want


@pytest.mark.parametrize("per_block,step", [(200, 900), (700, 300), (60_000, 5000), (60_000, 1 << 30)])
def test_splits_hold_each_record_once(tmp_path, per_block, step):
    path = tmp_path / "a.bam"
    want = _write(path, np.random.default_rng(per_block + step), 400, per_block)
    splits = bam.BamReader([str(path)], step).partitions()
    assert len(splits) == -(-path.stat().st_size // step)
    assert [r for s in splits for r in bam.split_records(s.path, s.begin, s.end)] == want


def test_odd_files(tmp_path, spark):
    rng = np.random.default_rng(1)
    assert _write(tmp_path / "none.bam", rng, 0, 500) == []
    splits = bam.BamReader([str(tmp_path / "none.bam")], 10).partitions()
    assert [r for s in splits for r in bam.split_records(s.path, s.begin, s.end)] == []
    want = _write(tmp_path / "two.bam", rng, 90, 500)
    spark.dataSource.register(bam.BamDataSource)
    got = spark.read.format("hyperweave_bam").option("paths", f"{tmp_path}/none.bam,{tmp_path}/two.bam").option("splitBytes", 4000).load().orderBy("ordinal").collect()
    assert [tuple(r)[2:] for r in got] == want and bam.sort_order(str(tmp_path / "two.bam")) == "query"
    cut = (tmp_path / "two.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(cut[: len(cut) // 2])
    with pytest.raises((ValueError, zlib.error)):
        list(bam.split_records(str(tmp_path / "cut.bam"), 0, None))
    (tmp_path / "no.bam").write_bytes(bam.block(b"something else") + bam.END_OF_FILE)
    with pytest.raises(ValueError):
        list(bam.split_records(str(tmp_path / "no.bam"), 0, None))


def test_files_written_are_read_alike(tmp_path, spark):
    rows = [(f"r{i // 3}", 0, f"c{i % 4}", i % 61, f"{i + 1}M{i % 7 + 1}S") for i in range(3000)]
    df = spark.createDataFrame(rows, "read_id string, flag int, contig string, mapq int, cigar string").coalesce(2)
    paths = bam.write_bam(df, str(tmp_path / "out"), ["c0", "c1", "c2"], per_block=3000)
    spark.dataSource.register(bam.BamDataSource)
    got = spark.read.format("hyperweave_bam").option("paths", ",".join(paths)).option("splitBytes", 3000).load()
    assert got.rdd.getNumPartitions() > 2 * len(paths)
    want = sorted((r, f, "*" if c == "c3" else c, m, i + 1 + i % 7 + 1, i + 1) for i, (r, f, c, m, _) in enumerate(rows))
    assert sorted(tuple(r)[2:] for r in got.collect()) == want
