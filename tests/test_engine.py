import gzip
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperweave import queries as Q
from hyperweave.config import Filters, load_config
from hyperweave.operators import cluster, hyperedges, incidence, kmers, knn, spectral
from hyperweave.plans import pipelines
from hyperweave.sources import bam, bio


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_equals_sql(name, same):
    same(Q.QUERIES[name], Q.SQL[name])


def test_worked_read(spark):
    rows = [(0, "r", 0, "c1", 60, 5000, 1500), (1, "r", 0, "c2", 30, 5000, 1200), (2, "r", 2048, "c3", 40, 5000, 1000), (3, "r", 0, "c1", 50, 5000, 2000), (4, "r", 256, "c4", 60, 9000, 5000), (5, "r", 4, "c4", 60, 9000, 5000)]
    a = spark.createDataFrame(rows, "ordinal long, read_id string, flag int, contig string, mapq int, qlen int, qaln int")
    contigs = spark.createDataFrame([(i, f"c{i + 1}") for i in range(4)], "idx long, name string")
    (e,) = hyperedges.hyperedges(a, contigs, Filters()).collect()
    assert e.members == [0, 1, 2] and e.k == 3
    assert math.isclose(e.r, 0.84) and math.isclose(e.q_prime, 0.8396916351207541) and math.isclose(e.w, 0.8396916351207541)
    f = hyperedges.funnel(a, contigs, Filters(max_hyperedge_size=2)).first()
    assert (f.reads_total, f.reads_pass_contigs, f.edges_truncated, f.edges_yielded) == (1, 1, 1, 1)
    assert hyperedges.hyperedges(a.limit(0), contigs, Filters()).count() == 0


def test_self_test_spectrum(spark):
    inc = incidence.incidence(pipelines.self_test_edges(spark))
    deg = incidence.vertex_degrees(inc, spark.range(6).select(F.col("id").alias("v")))
    rows = spectral.hyperedge_rows(inc, deg)
    want = [0, 0.102564, 0.794872, 1, 1, 1]
    assert np.allclose(spectral.smallest(rows, 6, 6)[0], want, atol=1e-6)
    assert np.allclose(spectral.smallest(rows, 6, 2, dense_limit=0)[0], want[:2], atol=1e-3)
    with pytest.raises(ValueError):
        spectral.smallest(rows, 6, 0)


def test_block_solver_finds_planted_groups(spark):
    rng = np.random.default_rng(1)
    edges = [(e, [int(g * 30 + m) for m in rng.choice(30, 3, replace=False)], 1.0) for e, g in enumerate(rng.integers(0, 3, 900))]
    inc = incidence.incidence(spark.createDataFrame(edges, "edge_id long, members array<long>, w double"))
    rows = spectral.hyperedge_rows(inc, incidence.vertex_degrees(inc, spark.range(90).select(F.col("id").alias("v"))))
    dense, block = spectral.smallest(rows, 90, 4)[0], spectral.smallest(rows, 90, 4, dense_limit=0)
    spread = spectral.smallest(rows, 90, 4, dense_limit=0, local_cells=0)  # rows that stay on the executors
    assert np.allclose(spread[0], block[0], atol=1e-9) and (spectral.residuals(rows, *block) < 1e-3).all()
    assert np.allclose(dense, block[0], atol=1e-3)
    assert spectral.largest_gap(dense, 1, 3) == 3
    got = {r.v: r.cluster for r in cluster.kmeans(cluster.frame(spark, block[1][:, :3]), 3, n_init=3).collect()}
    assert all(len({got[g * 30 + i] for i in range(30)}) == 1 for g in range(3)) and len(set(got.values())) == 3


def test_gap_and_fusion():
    assert spectral.largest_gap(np.array([0, 0.1, 0.9, 1.0]), 1, 9) == 2
    with pytest.raises(ValueError):
        spectral.largest_gap(np.array([0.0]), 2, 5)
    u = spectral.fuse_layers(np.array([[1.0, 0], [0, 0], [3.0, 0], [0, 0]]))
    assert np.allclose(u, [[1, 0], [0, 0]])


def test_silhouette_of_single_cluster_is_zero(spark):
    v = spark.createDataFrame([(0, [0.0], 1), (1, [1.0], 1)], "v long, features array<double>, cluster long")
    assert [r.s for r in knn.silhouettes(v).collect()] == [0.0, 0.0]


FASTA = ">c0 first one\nACGT\nacgtN\n>c1\nRYACGTACGTAA\n>c2\nACG\n>c3 empty\n\n>c4\nGGGTTTAACCGGTT"


def _bam(path, refs, records):
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for r in refs:
        raw += struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1000)
    for name, flag, ref, mapq, ops, seq in records:
        body = struct.pack("<iiBBHHHiiii", ref, 0, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + bytes((len(seq) + 1) // 2) + b"\xff" * len(seq)
        raw += struct.pack("<i", len(body)) + body
    path.write_bytes(gzip.compress(raw[:40]) + gzip.compress(raw[40:]))


def test_sources(spark, tmp_path):
    (tmp_path / "c.fa").write_text(FASTA)
    got = bio.read_fasta(spark, str(tmp_path / "c.fa")).orderBy("idx").collect()
    assert [(r.idx, r.name, r.seq) for r in got] == [(0, "c0", "ACGTacgtN"), (1, "c1", "RYACGTACGTAA"), (2, "c2", "ACG"), (3, "c3", ""), (4, "c4", "GGGTTTAACCGGTT")]
    assert got[0].description == "c0 first one"
    sam = "@HD\tVN:1\tSO:queryname\nr1\t0\tc0\t1\t60\t2S5M1I\t*\t0\t0\t*\t*\nr1\t2048\tc1\t1\t255\t3H4M\t*\t0\t0\tACGT\tIIII\n"
    (tmp_path / "a.sam").write_text(sam)
    assert [tuple(r)[2:] for r in bio.read_alignments(spark, str(tmp_path / "a.sam")).orderBy("ordinal").collect()] == [("r1", 0, "c0", 60, 8, 6), ("r1", 2048, "c1", 255, 4, 4)]
    assert bio.sam_sort_order(spark, str(tmp_path / "a.sam")).first().sort_order == "queryname"
    _bam(tmp_path / "a.bam", ["c0", "c1"], [("r1", 0, 0, 60, [(2, "S"), (5, "M"), (1, "I")], ""), ("r1", 2048, 1, 255, [(3, "H"), (4, "M")], "ACGT"), ("r2", 4, -1, 0, [], "AC")])
    assert [tuple(r)[2:] for r in bio.read_alignments(spark, str(tmp_path / "a.bam")).orderBy("ordinal").collect()] == [("r1", 0, "c0", 60, 8, 6), ("r1", 2048, "c1", 255, 4, 4), ("r2", 4, "*", 0, 2, 0)]
    (tmp_path / "bins.tsv").write_text("contig\tbin\nc0\tweird/bin name\nc1\tx\nc1\ty\n")
    stats = pipelines.export_bins(spark, str(tmp_path / "c.fa"), str(tmp_path / "bins.tsv"), str(tmp_path / "out"))
    assert {tuple(r) for r in stats.collect()} == {("weird_bin_name", 1, 9), ("y", 1, 12)}
    assert sorted(p.name for p in (tmp_path / "out/fasta").iterdir() if p.name[0] != ".") == ["weird_bin_name.fasta", "y.fasta"]
    assert (tmp_path / "out/fasta/y.fasta").read_text() == ">c1\nRYACGTACGTAA\n" and (tmp_path / "out/bin_fasta_stats.tsv").read_text().startswith("bin\tnum_contigs\ttotal_bases\n")
    (tmp_path / "fa").mkdir()
    for i in range(3):
        (tmp_path / f"fa/{2 - i}.fa").write_text("".join(f">s{2 - i}_{j}\nACGT\n" for j in range(400)))
    many = bio.read_fasta(spark, str(tmp_path / "fa")).orderBy("idx").select("idx", "name").collect()
    assert [tuple(r) for r in many] == [(400 * i + j, f"s{i}_{j}") for i in range(3) for j in range(400)]
    assert bam.sort_order(str(tmp_path / "a.bam")) is None and bio.sort_order(spark, str(tmp_path / "a.sam")) == "queryname"
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        bio.read_bins(spark, str(tmp_path / "bad.tsv"))


def test_sort_order_over_spans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    reads = [None if x == 4 else f"r{x}" for x in rng.integers(0, 5, 200)]
    rows = spark.createDataFrame(list(enumerate(reads)), "ordinal long, read_id string")
    runs = {}
    for a, b in zip([None, *reads], reads):
        runs[b] = runs.get(b, 0) + (a != b)
    for span in (1 << 20, 7, 1):
        monkeypatch.setattr(hyperedges, "PROBE_SPAN", span)
        assert {r.read_id: r.runs for r in hyperedges.sort_order_probe(rows).collect() if r.read_id} == {k: n for k, n in runs.items() if k and n > 1}
    assert hyperedges.sort_order_probe(rows, 1).count() == 0
    files = spark.createDataFrame([(f, (f << 33) + i, r) for f in range(2) for i, r in enumerate("aab" if f == 0 else "abac")], "file int, ordinal long, read_id string")
    assert [tuple(r) for r in hyperedges.sort_order_probe(files, 3).collect()] == [(1, "a", 2)]
    assert hyperedges.sort_order_probe(files, 2).isEmpty()


@pytest.mark.parametrize("k", [1, 3, 4])
def test_kmers_by_brute_force(spark, k):
    rng = np.random.default_rng(k)
    seqs = {i: "".join(rng.choice(list("ACGTacgtNR"), rng.integers(0, 60))) for i in range(30)} | {99: None}
    turn = str.maketrans("ACGT", "TGCA")
    want = {}
    for v, s in seqs.items():
        for i in range(len(s or "") - k + 1 if len(s or "") >= 10 else 0):
            w = s[i : i + k].upper()
            if set(w) <= set("ACGT"):
                key = (v, min(w, w.translate(turn)[::-1]))
                want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame(list(seqs.items()), "v long, seq string")
    assert {(r.v, r.kmer): r.cnt for r in kmers.kmer_counts(df, 10, k).collect()} == want


def test_counters_add_up(spark):
    f = Q.QUERIES["funnel_counters"](spark, "/root/testdata/sf0.001").first()
    assert f.reads_total == f.reads_filtered_low_quality + f.reads_pass_segments and f.reads_pass_segments == f.reads_filtered_small + f.reads_pass_contigs
    assert f.edges_truncated <= f.edges_yielded <= f.reads_pass_contigs


def test_pipelines_end_to_end(spark, tmp_path, caplog):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGT"), 300, p=[0.4, 0.1, 0.1, 0.4] if i < 6 else [0.1, 0.4, 0.4, 0.1])) for i in range(12)]
    (tmp_path / "c.fa").write_text("".join(f">c{i}\n{s}\n" for i, s in enumerate(seqs)))
    lines = []
    for r in range(60):
        for c in rng.choice(6, 3, replace=False) + 6 * (r % 2):
            lines.append(f"r{r}\t0\tc{c}\t1\t60\t1200M\t*\t0\t0\t*\t*")
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "c.yml").write_text(f"inputs: {{contigs_fasta: {tmp_path}/c.fa, porec_bam: {tmp_path}/a.sam}}\noutputs: {{output_dir: {tmp_path}/out}}\nfilters: {{mapq_min: 30, min_contig_len: 200}}\nspectral: {{k: 2}}\nmultiplex: {{knn_k: 4}}\n")
    caplog.set_level("INFO", logger="hyperweave")
    config = load_config(str(tmp_path / "c.yml"))
    for run in (pipelines.run_single, pipelines.run_multiplex):
        got = {r.contig: r.bin for r in run(spark, config).collect()}
        assert len({got[f"c{i}"] for i in range(6)}) == 1 and len({got[f"c{i}"] for i in range(6, 12)}) == 1 and len(set(got.values())) == 2
    assert load_config(str(tmp_path / "c.yml"), k=7, beta=0.25).k == 7
    stats = json.loads((tmp_path / "out/hypergraph.stats.json").read_text())
    assert stats["n_vertices"] == 12 and stats["n_hyperedges"] == 60 and stats["n_chunks"] >= 1
    assert (tmp_path / "out/bins.tsv").read_text().startswith("contig\tbin\nc0\tbin_") and (tmp_path / "out/k_used.txt").read_text().strip() == "2"
    assert "k used: 2" in caplog.text and "reads: " in caplog.text
    (tmp_path / "c.yml").write_text((tmp_path / "c.yml").read_text().replace("mapq_min: 30", "mapq_min: 61"))
    with pytest.raises(RuntimeError):
        pipelines.run_single(spark, load_config(str(tmp_path / "c.yml")))

    from hyperweave.streaming.ingest import stream_hyperedges

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.sam").write_text((tmp_path / "a.sam").read_text())
    contigs = bio.read_fasta(spark, str(tmp_path / "c.fa"))
    stream_hyperedges(spark, str(tmp_path / "in"), contigs, config.filters, str(tmp_path / "edges"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 60
