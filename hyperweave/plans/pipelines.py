"""The pipelines: one layer, two layers, export, self-test."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.config import Config
from hyperweave.operators import cluster, hyperedges, incidence, kmers, knn, spectral
from hyperweave.sources import bio, sinks


log = logging.getLogger("hyperweave")
PROBE_RECORDS = 50_000


def _alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments; warns where records don't come grouped by read, which changes no result here."""
    found = bio.read_alignments(spark, path)
    if bio.sort_order(spark, path) != "queryname" and not hyperedges.sort_order_probe(found, PROBE_RECORDS).isEmpty():
        log.warning("%s is not sorted by read name", path)
    return found


def _vertices(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.col("idx").alias("v"))


def run_single(spark: SparkSession, c: Config) -> DataFrame:
    """Bins by the hypergraph alone; writes edges, statistics, bins, sizes and k, and returns (contig, bin)."""
    contigs = bio.read_fasta(spark, c.contigs_fasta).persist()
    n = contigs.count()
    edges_path = f"{c.output_dir}/edges"
    log.info("%d contigs", n)
    sinks.write_edges(hyperedges.hyperedges(_alignments(spark, c.alignments), contigs, c.filters), edges_path, c.edges_per_file)
    edges = spark.read.parquet(edges_path)
    inc = incidence.incidence(edges)
    degrees = incidence.vertex_degrees(inc, _vertices(contigs)).persist()
    # edges are stored in files whether streaming is enabled in the settings or not
    stats = incidence.stats(edges, degrees).withColumn("n_chunks", F.lit(len(edges.inputFiles()))).persist()
    sinks.write_json(stats, f"{c.output_dir}/hypergraph.stats.json")
    log.info("hypergraph: %s", stats.first().asDict())
    if edges.isEmpty():
        raise RuntimeError("no hyperedges pass the filters")
    rows = spectral.hyperedge_rows(inc, degrees)
    if c.k <= 0:
        k, u = cluster.auto_k(rows, n, seed=c.seed, maxiter=c.maxiter)
    else:
        k = min(c.k, n)
        u = cluster.scaled(spectral.Embedding(rows, n, k, maxiter=c.maxiter, seed=c.seed).vectors)
    log.info("k used: %d", k)
    labels = cluster.kmeans(u, k, seed=c.seed).persist()
    return _write_bins(contigs, labels, c.output_dir, k)


def _write_bins(contigs: DataFrame, labels: DataFrame, out: str, k: int | None) -> DataFrame:
    bins = sinks.bins(contigs, labels)
    sinks.write_tsv(bins, f"{out}/bins.tsv")
    sinks.write_tsv(sinks.bin_sizes(labels), f"{out}/bin_sizes.tsv")
    if k is not None:
        sinks.write_text(contigs.sparkSession.range(1).select(F.lit(str(k)).alias("value")), f"{out}/k_used.txt")
    log.info("bins written to %s", out)
    return bins


def run_multiplex(spark: SparkSession, c: Config) -> DataFrame:
    """Bins by contacts and composition together; contigs shorter than the least length take no part."""
    out = f"{c.output_dir}/multiplex"
    long = bio.read_fasta(spark, c.contigs_fasta).where(F.length("seq") >= c.filters.min_contig_len)
    numbers = incidence.numbered(_vertices(long)).withColumnRenamed("idx", "number")
    contigs = long.join(numbers, F.col("idx") == F.col("v")).withColumn("idx", F.col("number")).drop("v", "number").persist()
    n = contigs.count()
    if not n:
        raise ValueError("no contigs of the least length")
    vertices = _vertices(contigs)
    values = kmers.tnf(kmers.kmer_counts(contigs.select(F.col("idx").alias("v"), "seq"), c.filters.min_contig_len))
    vectors = kmers.feature_vectors(values, kmers.canonical_dictionary(spark), vertices)
    chem = incidence.knn_incidence(knn.mutual(knn.knn(vectors, min(c.knn_k, n)))).persist()
    alignments = _alignments(spark, c.alignments)
    phys = incidence.incidence(hyperedges.hyperedges(alignments, contigs, c.filters)).persist()
    funnel = hyperedges.funnel(alignments, contigs, c.filters).persist()
    sinks.write_json(funnel, f"{out}/porec_stats.json")
    log.info("reads: %s", funnel.first().asDict())
    rows = spectral.multiplex_rows(*(spectral.hyperedge_rows(i, incidence.vertex_degrees(i, vertices)) for i in (phys, chem)), n, c.beta)
    wanted = min(c.k, 2 * n - 1) if c.k > 0 else max(2, min(min(200, n - 1), 2 * n - 2))
    found = spectral.Embedding(rows, 2 * n, wanted, shift=1 + 2 * c.beta, maxiter=c.maxiter, seed=c.seed)
    k = min(n, wanted if c.k > 0 else spectral.multiplex_k(found.values, n))
    log.info("k used: %d", k)
    labels = cluster.kmeans(spectral.fused(found.vectors.withColumn("features", F.slice("features", 1, k)), n), k, seed=c.seed).persist()
    return _write_bins(contigs, labels, out, None)


def export_bins(spark: SparkSession, contigs_fasta: str, bins_tsv: str, out_dir: str) -> DataFrame:
    """Sequences by bin under ``out_dir/fasta`` and their statistics; returns the statistics."""
    found = sinks.assigned(bio.read_fasta(spark, contigs_fasta), bio.read_bins(spark, bins_tsv)).persist()
    sinks.write_fasta_by_bin(found, f"{out_dir}/fasta")
    stats = sinks.bin_stats(found)
    sinks.write_tsv(stats, f"{out_dir}/bin_fasta_stats.tsv")
    return stats


SELF_TEST = ((0, [0, 1, 2], 0.9), (1, [3, 4, 5], 0.9), (2, [2, 3], 0.2))


def self_test_edges(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({e}L, array({', '.join(f'{m}L' for m in members)}), {q!r}D)" for e, members, q in SELF_TEST)
    return spark.sql(f"SELECT edge_id, members, q_prime, q_prime * 2e0 / (size(members) - 1) AS w FROM VALUES {values} AS t(edge_id, members, q_prime)")


def self_test(spark: SparkSession, n_init: int = 10) -> DataFrame:
    """(contig, bin) of six contigs that fall into two bins; bins are numbered by their first contig."""
    inc = incidence.incidence(self_test_edges(spark))
    degrees = incidence.vertex_degrees(inc, spark.range(6).select(F.col("id").alias("v")))
    u = spectral.smallest(spectral.hyperedge_rows(inc, degrees), 6, 2)[1]
    labels = cluster.kmeans(cluster.frame(spark, u), 2, n_init)
    first = labels.groupBy("cluster").agg(F.min("v").alias("first"))
    return labels.join(first, "cluster").select(F.concat(F.lit("c"), "v").alias("contig"), F.when(F.col("first") == 0, "bin_0").otherwise("bin_1").alias("bin"))
