"""One query for each operator, on the driver's tables, with the SQL that DuckDB checks it by."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave import functions as fn
from hyperweave.config import Filters
from hyperweave.operators import cluster, hyperedges, incidence, kmers, knn, spectral
from hyperweave.plans import pipelines
from hyperweave.sources import bam, bio, scratch, sinks, tables
from hyperweave.streaming import ingest

FILTERS = Filters(mapq_min=20, segment_min_bases=500, min_segments_per_read=2, max_hyperedge_size=20)
TRUNCATING = Filters(mapq_min=20, segment_min_bases=500, min_segments_per_read=2, max_hyperedge_size=4)  # to show truncation
MIN_SEQ, KNN, BETA = 200, 10, 0.5


def r6(c: str):
    """Rounded to six places, without a negative zero."""
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)


def aln(s: SparkSession, d: str) -> DataFrame:
    return tables.alignments(s, d)


def edges(s: SparkSession, d: str, f: Filters = FILTERS) -> DataFrame:
    return hyperedges.hyperedges(aln(s, d), tables.universe(s, d), f)


def vertices(s: SparkSession, d: str) -> DataFrame:
    return tables.universe(s, d).select(F.col("idx").alias("v"))


def contacts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(incidence, degrees); the incidence is kept, as its users read it several times."""
    inc = incidence.incidence(edges(s, d)).persist()
    return inc, incidence.vertex_degrees(inc, vertices(s, d))


def neighbours(s: SparkSession, d: str) -> DataFrame:
    """Neighbours are kept, as both sides of the pairs and those who use them read them again."""
    return knn.mutual(knn.knn(tables.features(s, d).select("v", "features"), KNN).persist())


def chem(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inc = incidence.knn_incidence(neighbours(s, d))
    return inc, incidence.vertex_degrees(inc, tables.features(s, d).select("v"))


def both_layers(s: SparkSession, d: str) -> tuple[tuple, tuple, int]:
    """Contacts and composition over one universe: vertices 0 .. n-1 of the embeddings."""
    n = tables.features(s, d).count()
    v = s.range(n).select(F.col("id").alias("v"))
    folded = aln(s, d).withColumn("contig", F.col("contig") % n)
    inc = incidence.incidence(hyperedges.hyperedges(folded, v.select(F.col("v").alias("idx"), F.col("v").alias("name")), FILTERS)).persist()
    return (inc, incidence.vertex_degrees(inc, v)), chem(s, d), n


def edge_rows(e: DataFrame) -> DataFrame:
    return e.select("edge_id", "k", r6("r"), r6("q_read"), r6("q_prime"), r6("w"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def labels_of_parts(s: SparkSession, d: str) -> DataFrame:
    return vertices(s, d).select("v", (F.col("v") % 7).alias("cluster"))


def bin_input(s: SparkSession, d: str) -> DataFrame:
    """Documents' sequences as contigs, bins named by source with characters that need replacing."""
    docs = tables.table(s, d, "documents").select("doc_id", "source")
    seq = tables.sequences(s, d).select(F.col("v").alias("idx"), F.concat(F.lit("ctg"), "v").alias("name"), F.concat(F.lit("ctg"), "v").alias("description"), "seq")
    bins = docs.select(F.concat(F.lit("ctg"), "doc_id").alias("contig"), F.concat(F.lit("bin/"), "source").alias("bin"))
    return sinks.assigned(seq, bins)


def supra(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    (pi, pd_), (ci, cd), n = both_layers(s, d)
    return incidence.supra_laplacian(incidence.laplacian(pi, pd_), incidence.laplacian(ci, cd), s.range(n).select(F.col("id").alias("v")), n, BETA), n


def x_of(v: str = "v"):
    return (F.col(v) % 7 + 1).cast("double").alias("x")


def q_matvec(s, d):
    inc, deg = contacts(s, d)
    return incidence.matvec(inc, deg, vertices(s, d).select("v", x_of())).select("v", r6("y"))


def q_supra_matvec(s, d):
    matrix, n = supra(s, d)
    return incidence.multiply_coo(matrix, s.range(2 * n).select(F.col("id").alias("v"), x_of("id"))).select("i", r6("y"))


def q_universe(s, d):
    kept, discarded = hyperedges.in_universe(aln(s, d), tables.some_parts(s, d), FILTERS)
    return kept.agg(F.count("*").alias("kept")).join(discarded.agg(F.count("*").alias("discarded")))


def q_eigengap(s, d):
    found = spectral.largest_gap_of(tables.table(s, d, "supplier").select("s_acctbal"))
    return s.createDataFrame([found] if found else [], "k long, gap double").select("k", r6("gap"))


def q_row_normalize(s, d):
    x = tables.features(s, d).select("v", F.posexplode(spectral.normalised(F.col("features"))).alias("pos", "val"))
    return x.select("v", F.col("pos").cast("long").alias("pos"), r6("val"))


def contact_rows(s, d) -> tuple[DataFrame, DataFrame, int]:
    """(sparse rows, (v, idx), n) of the contact hypergraph over vertices without gaps."""
    inc, numbers = incidence.dense(contacts(s, d)[0], vertices(s, d))
    degrees = incidence.vertex_degrees(inc, numbers.select(F.col("idx").alias("v")))
    return spectral.hyperedge_rows(inc, degrees), numbers, numbers.count()


def q_eigenvalues(s, d):
    """The ten smallest eigenvalues, held by what must be true of them: each pair's residual is small, vectors are
    orthonormal, values ascend within [0, 2] from 0 (the vector sqrt(degree))."""
    rows, _, n = contact_rows(s, d)
    rows = rows.persist()
    found = spectral.Embedding(rows, n, 10)
    values, (residuals, inner) = found.values, found.held()
    small = residuals < 2e-3
    orthonormal = bool(np.allclose(inner, np.eye(len(values)), atol=1e-6))
    ordered = bool((np.diff(values) >= -1e-9).all() and abs(values[0]) < 1e-3 and values[-1] <= 2)
    return s.createDataFrame([(i + 1, n, bool(x), orthonormal, ordered) for i, x in enumerate(small)], "k long, n_vertices long, residual_small boolean, orthonormal boolean, ordered boolean")


def labelled(labels: DataFrame, k: int) -> DataFrame:
    """Each vertex with whether its bin is one of k: of random graphs bins themselves cannot be told. Tests plant groups."""
    return labels.select("v", F.col("cluster").between(0, k - 1).alias("valid"))


def q_spectral_bins(s, d):
    rows, numbers, n = contact_rows(s, d)
    labels = cluster.kmeans(cluster.scaled(spectral.Embedding(rows, n, 5).vectors), 5, n_init=2).withColumnRenamed("v", "idx")
    return labelled(numbers.join(labels, "idx"), 5)


def q_auto_k_bins(s, d):
    """On contacts, with the reference method's range of k and its 20 k-means starts."""
    (inc, deg), _, n = both_layers(s, d)
    k, u = cluster.auto_k(spectral.hyperedge_rows(inc, deg), n)
    return labelled(cluster.kmeans(u, k), k)


def q_multiplex_bins(s, d):
    first, second, n = both_layers(s, d)
    rows = spectral.multiplex_rows(spectral.hyperedge_rows(*first), spectral.hyperedge_rows(*second), n, BETA)
    u = spectral.Embedding(rows, 2 * n, 6, shift=1 + 2 * BETA).vectors
    return labelled(cluster.kmeans(spectral.fused(u, n), 6, n_init=2), 6)


def records(s: SparkSession, d: str) -> DataFrame:
    """The alignments as fields of file records: parts are contigs c<number>; an alignment longer than its read lengthens it."""
    clipped = F.greatest(F.col("qlen") - F.col("qaln"), F.lit(0))
    cigar = F.concat(F.col("qaln"), F.lit("M"), F.when(clipped > 0, F.concat(clipped, F.lit("S"))).otherwise(""))
    rows = aln(s, d).select(F.col("read_id").cast("string").alias("read_id"), "flag", F.concat(F.lit("c"), "contig").alias("contig"), "mapq", cigar.alias("cigar"), "ordinal")
    return rows.repartition(4, "read_id").sortWithinPartitions("read_id", "ordinal")


def sam_folder(s: SparkSession, d: str) -> str:
    folder = scratch.shared_folder(s, "sam")
    line = F.concat_ws("\t", "read_id", "flag", "contig", F.lit("1"), "mapq", "cigar", *[F.lit(x) for x in ("*", "0", "0", "*", "*")])
    records(s, d).select(line.alias("value")).write.text(folder)
    return folder


def named_parts(s: SparkSession, d: str) -> DataFrame:
    return vertices(s, d).select(F.col("v").alias("idx"), F.concat(F.lit("c"), "v").alias("name"))


def q_sam_scan(s, d):
    return bio.read_alignments(s, sam_folder(s, d)).drop("file", "ordinal")


def q_bam_scan(s, d):
    """Through several files, each read in splits."""
    contigs = [r.name for r in named_parts(s, d).orderBy("idx").select("name").collect()]  # contigs, as in a file's header
    paths = bam.write_bam(records(s, d), scratch.shared_folder(s, "bam").removeprefix("file:"), contigs)
    return bio.read_alignments(s, ",".join(paths), split_bytes=1 << 18).drop("file", "ordinal")


def q_file_hyperedges(s, d):
    """Hyperedges of a SAM file, members in the order of its records."""
    return edge_rows(hyperedges.hyperedges(bio.read_alignments(s, sam_folder(s, d)), named_parts(s, d), FILTERS).withColumn("edge_id", F.col("edge_id").cast("long")))


def q_stream_hyperedges(s, d):
    """The same from a stream of files."""
    out = scratch.shared_folder(s, "stream")
    ingest.stream_hyperedges(s, sam_folder(s, d), named_parts(s, d), FILTERS, f"{out}/edges", f"{out}/progress").awaitTermination()
    return edge_rows(s.read.parquet(f"{out}/edges").withColumn("edge_id", F.col("edge_id").cast("long")))


def q_fasta_scan(s, d):
    """Documents' sequences as a FASTA file in lines of 60, in the order of documents."""
    folder = scratch.shared_folder(s, "fasta")
    sinks.fasta_records(bin_input(s, d).withColumn("bin", F.lit("all"))).repartitionByRange(4, "idx").sortWithinPartitions("idx").select(F.col("record").alias("value")).write.text(folder)
    return bio.read_fasta(s, folder).select("idx", "name", "description", "seq", "length")


def q_bins_scan(s, d):
    path = f"{scratch.shared_folder(s, 'bins')}/bins.tsv"
    sinks.write_tsv(sinks.bins(named_parts(s, d), labels_of_parts(s, d)), path)
    return bio.read_bins(s, path)


def q_stored_matvec(s, d):
    """The solver's own product, on hyperedges read back from files."""
    folder = scratch.shared_folder(s, "edges")
    sinks.write_edges(edges(s, d), folder, per_file=1000)
    inc, numbers = incidence.dense(incidence.incidence(s.read.parquet(folder)), vertices(s, d))
    numbers = numbers.persist()
    rows = spectral.hyperedge_rows(inc, incidence.vertex_degrees(inc, numbers.select(F.col("idx").alias("v"))))
    x = numbers.orderBy("idx").select("v", x_of()).toPandas()  # a vector over the vertices, as the solver holds
    y = x.x.to_numpy()[:, None] - spectral.multiply(spectral.packed(rows), x.x.to_numpy()[:, None])
    x["y"] = y[:, 0]
    return s.createDataFrame(x[["v", "y"]], "v long, y double").select("v", r6("y"))


def q_planted_groups(s, d):
    """Bins, their number chosen too, of a hypergraph that falls into five parts: parts that a customer orders and whose
    numbers leave the same remainder. Bins are named by their first vertex."""
    lines = tables.table(s, d, "lineitem").join(tables.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = lines.groupBy("o_custkey", F.pmod("l_partkey", F.lit(5)).alias("g")).agg(F.sort_array(F.collect_set("l_partkey")).alias("members"))
    planted = sets.select(F.xxhash64("o_custkey", "g").alias("edge_id"), "members", F.lit(1.0).alias("w"))
    inc, numbers = incidence.dense(incidence.incidence(planted).persist(), vertices(s, d))
    numbers = numbers.persist()
    rows = spectral.hyperedge_rows(inc, incidence.vertex_degrees(inc, numbers.select(F.col("idx").alias("v"))))
    k, u = cluster.auto_k(rows, numbers.count(), k_min=2, k_max=12, n_init=5)
    labels = cluster.kmeans(u, k, n_init=10).withColumnRenamed("v", "idx")
    found = numbers.join(labels, "idx").select("v", "cluster")
    first = found.groupBy("cluster").agg(F.min("v").alias("first"))
    return found.join(first, "cluster").select("v", F.lit(k).cast("long").alias("k"), "first")


def self_test(s):
    inc = incidence.incidence(pipelines.self_test_edges(s))
    return inc, incidence.vertex_degrees(inc, s.range(6).select(F.col("id").alias("v")))


QUERIES = {
    "alignment_filter": lambda s, d: hyperedges.passing(aln(s, d), FILTERS),
    "read_bundle_measures": lambda s, d: hyperedges.read_bundles(aln(s, d)).select("read_id", r6("explained_frac"), "n_contigs", "min_segment_qaln", r6("mean_mapq")),
    "contig_merge": lambda s, d: hyperedges.merge_contigs(aln(s, d), tables.some_parts(s, d), FILTERS).select("read_id", "contig", "mapq", "qaln", "ordinal", "segments"),
    "hyperedges": lambda s, d: edge_rows(edges(s, d)),
    "hyperedges_truncated": lambda s, d: edge_rows(edges(s, d, TRUNCATING)),
    "funnel_counters": lambda s, d: hyperedges.funnel(aln(s, d), tables.some_parts(s, d), TRUNCATING),
    "sort_order_probe": lambda s, d: hyperedges.sort_order_probe(tables.table(s, d, "events").select(F.lit(1).alias("file"), F.col("event_id").alias("ordinal"), F.col("user_id").alias("read_id"))),
    "universe_semi_anti": q_universe,
    "incidence": lambda s, d: incidence.incidence(edges(s, d)).select("edge_id", "v"),
    "edge_degree": lambda s, d: incidence.edge_table(edges(s, d)).select("edge_id", r6("w"), "de"),
    "vertex_degree": lambda s, d: contacts(s, d)[1].select("v", r6("dv")),
    "hypergraph_stats": lambda s, d: incidence.stats(edges(s, d), contacts(s, d)[1]).select("n_vertices", "n_hyperedges", F.round("sum_w", 4).alias("sum_w"), r6("mean_degree_v")),
    "laplacian_matvec": q_matvec,
    "laplacian_coo": lambda s, d: incidence.laplacian(*contacts(s, d)).select("i", "j", r6("val")),
    "laplacian_diag": lambda s, d: incidence.laplacian(*contacts(s, d)).where("i = j").select("i", r6("val")),
    "canonical_kmers": lambda s, d: kmers.canonical_dictionary(s),
    "kmer_counts": lambda s, d: kmers.kmer_counts(tables.sequences(s, d), MIN_SEQ),
    "tnf": lambda s, d: kmers.tnf(kmers.kmer_counts(tables.sequences(s, d), MIN_SEQ)).select("v", "kmer", r6("val")),
    "knn": lambda s, d: knn.knn(tables.features(s, d).select("v", "features"), KNN).select("center", "neighbor", r6("dist")),
    "mutual_knn": lambda s, d: neighbours(s, d).select("center", "neighbor", r6("h")),
    "chem_degrees": lambda s, d: (lambda i, v: v.join(i.select(F.col("edge_id").alias("v"), "de").distinct(), "v").select("v", r6("dv"), r6("de")))(*chem(s, d)),
    "chem_laplacian_coo": lambda s, d: incidence.laplacian(*chem(s, d)).select("i", "j", r6("val")),
    "supra_laplacian_coo": lambda s, d: supra(s, d)[0].select("i", "j", r6("val")),
    "supra_matvec": q_supra_matvec,
    "eigengap": q_eigengap,
    "row_normalize": q_row_normalize,
    "silhouette_by_label": lambda s, d: knn.silhouettes(tables.features(s, d)).select("v", "cluster", r6("s")),
    "bin_sizes": lambda s, d: sinks.bin_sizes(labels_of_parts(s, d)),
    "bins_table": lambda s, d: sinks.bins(tables.universe(s, d), labels_of_parts(s, d)),
    "bin_stats": lambda s, d: sinks.bin_stats(bin_input(s, d)),
    "bin_sanitize": lambda s, d: tables.table(s, d, "part").select("p_partkey", fn.safe_name(F.col("p_name")).alias("safe")),
    "export_records": lambda s, d: sinks.fasta_records(bin_input(s, d)),
    "self_test_edges": lambda s, d: pipelines.self_test_edges(s).select("edge_id", F.size("members").cast("long").alias("k"), r6("w")),
    "self_test_laplacian": lambda s, d: incidence.laplacian(*self_test(s)).select("i", "j", r6("val")),
    "self_test_bins": lambda s, d: pipelines.self_test(s, 3),
    "eigenvalues": q_eigenvalues,
    "spectral_bins": q_spectral_bins,
    "auto_k_bins": q_auto_k_bins,
    "multiplex_bins": q_multiplex_bins,
    "planted_groups": q_planted_groups,
    "sam_scan": q_sam_scan,
    "bam_scan": q_bam_scan,
    "file_hyperedges": q_file_hyperedges,
    "stream_hyperedges": q_stream_hyperedges,
    "fasta_scan": q_fasta_scan,
    "bins_scan": q_bins_scan,
    "stored_matvec": q_stored_matvec,
}

# The same in SQL, by common table expressions that build on one another.
_ALN = """a AS (SELECT CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS BIGINT) AS ordinal, l_orderkey AS read_id,
  CASE WHEN l_linenumber = 7 THEN 256 WHEN l_linenumber = 6 THEN 4 WHEN l_linenumber = 5 THEN 2048 ELSE 0 END AS flag, {contig} AS contig,
  CAST(l_quantity AS INT) AS mapq, CAST(floor(o_totalprice) AS BIGINT) AS qlen, CAST(floor(l_extendedprice) AS BIGINT) AS qaln FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT * FROM a WHERE flag & 260 = 0), p AS (SELECT * FROM m WHERE mapq >= 20 AND qaln >= 500),
u AS ({universe}),
merged AS (SELECT read_id, contig, max(mapq) AS mapq, max(qaln) AS qaln, min(ordinal) AS ordinal, count(*) AS segments FROM p GROUP BY read_id, contig)"""
_PARTS = {"contig": "l_partkey", "universe": "SELECT p_partkey AS idx FROM part"}
_SOME = {"contig": "l_partkey", "universe": "SELECT p_partkey AS idx FROM part WHERE p_partkey % 10 <> 3"}
_FOLDED = {"contig": "l_partkey % (SELECT count(*) FROM embeddings)", "universe": "SELECT vec_id AS idx FROM embeddings"}
_EDGES = """, kept AS (SELECT merged.*, row_number() OVER (PARTITION BY read_id ORDER BY ordinal) AS pos, count(*) OVER (PARTITION BY read_id) AS k_all FROM merged JOIN u ON contig = idx),
len AS (SELECT read_id, max(qlen) AS qlen FROM p GROUP BY read_id),
e0 AS (SELECT read_id AS edge_id, count(*) AS k, least(1e0, sum(qaln)::DOUBLE / greatest(1, max(qlen))) AS r,
  exp(avg(ln(greatest(1e-12, least(1e0, 1e0 - pow(1e1, -mapq / 1e1)))))) AS q_read, string_agg(CAST(contig AS VARCHAR), ',' ORDER BY pos) AS members
  FROM kept JOIN len USING (read_id) WHERE k_all >= 2 AND pos <= {cap} GROUP BY read_id),
e AS (SELECT *, greatest(0e0, least(1e0, r * q_read)) AS q_prime, greatest(0e0, least(1e0, r * q_read)) * 2e0 / (k - 1) AS w FROM e0 WHERE k >= 2),
inc AS (SELECT edge_id, contig AS v, 1e0 AS h, w, k::DOUBLE AS de FROM e JOIN kept ON edge_id = read_id WHERE pos <= {cap}),
deg AS (SELECT idx AS v, coalesce(sum(w), 0e0) AS dv FROM u LEFT JOIN inc ON v = idx GROUP BY idx)"""
_LAP = """, {n}l AS (SELECT i, j, sum(val) AS val FROM (SELECT a.v AS i, b.v AS j, -sum(a.h * a.w / a.de * b.h) / sqrt(max(x.dv)) / sqrt(max(y.dv)) AS val FROM {inc} a JOIN {inc} b USING (edge_id)
  JOIN {deg} x ON x.v = a.v JOIN {deg} y ON y.v = b.v GROUP BY a.v, b.v UNION ALL SELECT v, v, 1e0 FROM {deg}) GROUP BY i, j)"""
_KNN = """f AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
knn AS MATERIALIZED (SELECT * FROM (SELECT a.v AS center, b.v AS neighbor, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.v ORDER BY list_distance(a.x, b.x), b.v) AS n FROM f a, f b) WHERE n <= 10),
mutual AS (SELECT center, neighbor, 1e0 / (1e0 + dist) AS h FROM knn a JOIN (SELECT center AS back, neighbor AS forth FROM knn) ON back = neighbor AND forth = center),
cde AS (SELECT center, sum(h) AS de FROM mutual GROUP BY center), cinc AS (SELECT center AS edge_id, neighbor AS v, h, 1e0 AS w, de FROM mutual JOIN cde USING (center)),
cdeg AS (SELECT f.v, coalesce(sum(h), 0e0) AS dv FROM f LEFT JOIN cinc ON cinc.v = f.v GROUP BY f.v)"""
_DEC = "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))"
_KMERS = f"""s AS (SELECT doc_id AS v, {_DEC} AS seq FROM documents), k0 AS (SELECT v, substr(seq, i, 4) AS k FROM s, LATERAL (SELECT unnest(range(1, length(seq) - 2)) AS i) WHERE length(seq) >= {MIN_SEQ}),
k AS (SELECT v, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM k0 GROUP BY 1, 2)"""
_BINS = f"""b AS (SELECT doc_id AS idx, {_DEC} AS seq, regexp_replace('bin/' || source, '[^A-Za-z0-9._-]', '_', 'g') AS bin FROM documents)"""
_SELF = """mem(edge_id, v, q, k) AS (VALUES (0, 0, 0.9e0, 3), (0, 1, 0.9e0, 3), (0, 2, 0.9e0, 3), (1, 3, 0.9e0, 3), (1, 4, 0.9e0, 3), (1, 5, 0.9e0, 3), (2, 2, 0.2e0, 2), (2, 3, 0.2e0, 2)),
inc AS (SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(v AS BIGINT) AS v, 1e0 AS h, q * 2e0 / (k - 1) AS w, k::DOUBLE AS de FROM mem), deg AS (SELECT v, sum(w) AS dv FROM inc GROUP BY v)"""


def _r(e: str, places: int = 6) -> str:
    return f"round({e}, {places}) + 0e0"


def _with(*parts: str) -> str:
    return "WITH " + "".join(parts)


_A, _A_SOME = _ALN.format(**_PARTS), _ALN.format(**_SOME)
_E4, _E20 = _A + _EDGES.format(cap=4), _A + _EDGES.format(cap=20)
_L = _LAP.format(n="", inc="inc", deg="deg")
_ROWS = f"SELECT edge_id, k, {_r('r')} AS r, {_r('q_read')} AS q_read, {_r('q_prime')} AS q_prime, {_r('w')} AS w, members FROM e"
_RECORDS = " SELECT CAST(read_id AS VARCHAR) AS read_id, flag, 'c' || contig AS contig, mapq, CAST(greatest(qlen, qaln) AS INT) AS qlen, CAST(qaln AS INT) AS qaln FROM a"
_SUPRA = _with(_ALN.format(**_FOLDED) + _EDGES.format(cap=20), _L, ", ", _KNN, _LAP.format(n="c", inc="cinc", deg="cdeg"), """, n AS (SELECT count(*) AS n FROM embeddings),
supra AS (SELECT i, j, sum(val) AS val FROM (SELECT i, j, val FROM l UNION ALL SELECT i + n, j + n, val FROM cl, n UNION ALL SELECT vec_id, vec_id, 0.5e0 FROM embeddings UNION ALL SELECT vec_id + n, vec_id + n, 0.5e0 FROM embeddings, n
UNION ALL SELECT vec_id, vec_id + n, -0.5e0 FROM embeddings, n UNION ALL SELECT vec_id + n, vec_id, -0.5e0 FROM embeddings, n) GROUP BY i, j) """)

SQL = {
    "alignment_filter": _with(_A, " SELECT * FROM p"),
    "read_bundle_measures": _with(_A, f" SELECT read_id, {_r('CASE WHEN max(qlen) > 0 THEN least(1e0, sum(qaln)::DOUBLE / greatest(1, max(qlen))) ELSE 0e0 END')} AS explained_frac, count(DISTINCT contig) AS n_contigs, min(qaln) AS min_segment_qaln, {_r('avg(mapq)')} AS mean_mapq FROM m GROUP BY read_id"),
    "contig_merge": _with(_A_SOME, " SELECT * FROM merged"),
    "hyperedges": _with(_E20, " ", _ROWS),
    "hyperedges_truncated": _with(_E4, " ", _ROWS),
    "funnel_counters": _with(_A_SOME, """, g AS (SELECT read_id, bool_or(mapq >= 20 AND qaln >= 500) AS good, count(DISTINCT CASE WHEN mapq >= 20 AND qaln >= 500 AND idx IS NOT NULL THEN contig END) AS k, count(CASE WHEN mapq >= 20 AND qaln >= 500 AND idx IS NULL THEN 1 END) AS gone FROM m LEFT JOIN u ON contig = idx GROUP BY read_id)
 SELECT count(*) AS reads_total, count(CASE WHEN NOT good THEN 1 END) AS reads_filtered_low_quality, count(CASE WHEN good THEN 1 END) AS reads_pass_segments, CAST(sum(gone) AS BIGINT) AS contig_hits_discarded, count(CASE WHEN good AND k < 2 THEN 1 END) AS reads_filtered_small,
 count(CASE WHEN good AND k >= 2 THEN 1 END) AS reads_pass_contigs, count(CASE WHEN good AND k > 4 THEN 1 END) AS edges_truncated, count(CASE WHEN good AND k >= 2 THEN 1 END) AS edges_yielded FROM g"""),
    "sort_order_probe": "WITH s AS (SELECT user_id AS read_id, CASE WHEN user_id IS NOT DISTINCT FROM lag(user_id) OVER (ORDER BY event_id) AND event_id <> (SELECT min(event_id) FROM events) THEN 0 ELSE 1 END AS starts FROM events) SELECT 1 AS file, read_id, CAST(sum(starts) AS BIGINT) AS runs FROM s GROUP BY read_id HAVING sum(starts) > 1",
    "universe_semi_anti": _with(_A_SOME, " SELECT (SELECT count(*) FROM p WHERE contig IN (SELECT idx FROM u)) AS kept, (SELECT count(*) FROM p WHERE contig NOT IN (SELECT idx FROM u)) AS discarded"),
    "incidence": _with(_E20, " SELECT edge_id, v FROM inc"),
    "edge_degree": _with(_E20, f" SELECT edge_id, {_r('w')} AS w, k::DOUBLE AS de FROM e"),
    "vertex_degree": _with(_E20, f" SELECT v, {_r('dv')} AS dv FROM deg"),
    "hypergraph_stats": _with(_E20, f" SELECT (SELECT count(*) FROM deg) AS n_vertices, (SELECT count(*) FROM e) AS n_hyperedges, (SELECT round(sum(w), 4) FROM e) AS sum_w, (SELECT {_r('avg(dv)')} FROM deg) AS mean_degree_v"),
    "laplacian_matvec": _with(_E20, f""", x AS (SELECT v, (v % 7 + 1)::DOUBLE AS x, 1e0 / sqrt(CASE WHEN dv > 0 THEN dv ELSE 1e0 END) AS root FROM deg), s AS (SELECT edge_id, sum(h * x * root) AS s FROM inc JOIN x USING (v) GROUP BY edge_id),
 acc AS (SELECT v, sum(h * s * w / de) AS acc FROM inc JOIN s USING (edge_id) GROUP BY v) SELECT v, {_r('x - coalesce(acc, 0e0) * root')} AS y FROM x LEFT JOIN acc USING (v)"""),
    "laplacian_coo": _with(_E20, _L, f" SELECT i, j, {_r('val')} AS val FROM l"),
    "laplacian_diag": _with(_E20, _L, f" SELECT i, {_r('val')} AS val FROM l WHERE i = j"),
    "canonical_kmers": "WITH b(x) AS (VALUES ('A'), ('C'), ('G'), ('T')), w AS (SELECT p.x || q.x || r.x || s.x AS k FROM b p, b q, b r, b s), c AS (SELECT DISTINCT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM w) SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS feature FROM c",
    "kmer_counts": _with(_KMERS, " SELECT * FROM k"),
    "tnf": _with(_KMERS, f" SELECT v, kmer, {_r('cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY v))')} AS val FROM k"),
    "knn": _with(_KNN, f" SELECT center, neighbor, {_r('dist')} AS dist FROM knn"),
    "mutual_knn": _with(_KNN, f" SELECT center, neighbor, {_r('h')} AS h FROM mutual"),
    "chem_degrees": _with(_KNN, f" SELECT v, {_r('dv')} AS dv, {_r('de')} AS de FROM cdeg JOIN cde ON v = center"),
    "chem_laplacian_coo": _with(_KNN, _LAP.format(n="c", inc="cinc", deg="cdeg"), f" SELECT i, j, {_r('val')} AS val FROM cl"),
    "supra_laplacian_coo": _SUPRA + f"SELECT i, j, {_r('val')} AS val FROM supra",
    "supra_matvec": _SUPRA + f"SELECT i, {_r('sum(val * (j % 7 + 1))')} AS y FROM supra GROUP BY i",
    "eigengap": f"WITH o AS (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k, s_acctbal AS val FROM supplier WHERE s_acctbal IS NOT NULL), g AS (SELECT k, lead(val) OVER (ORDER BY k) - val AS gap FROM o) SELECT k, {_r('gap')} AS gap FROM g WHERE gap IS NOT NULL ORDER BY g.gap DESC, k LIMIT 1",
    "row_normalize": f"WITH f AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT v, pos, {_r('CASE WHEN list_dot_product(x, x) > 0 THEN x[pos + 1] / sqrt(list_dot_product(x, x)) ELSE 0e0 END')} AS val FROM f, LATERAL (SELECT unnest(range(0, len(x))) AS pos)",
    "silhouette_by_label": _with(_KNN, f""", d AS (SELECT a.v, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM f a, f b GROUP BY 1, 2, 3),
 q AS (SELECT v, own, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN t END) AS t, min(CASE WHEN own <> other THEN t / n END) AS b FROM d GROUP BY v, own)
 SELECT v, CAST(own AS BIGINT) AS cluster, {_r('CASE WHEN n > 1 AND b IS NOT NULL THEN (b - t / (n - 1)) / greatest(t / (n - 1), b) ELSE 0e0 END')} AS s FROM q"""),
    "bin_sizes": "SELECT p_partkey % 7 AS bin, count(*) AS num_contigs FROM part GROUP BY 1",
    "bins_table": "SELECT p_partkey AS contig, 'bin_' || (p_partkey % 7) AS bin FROM part",
    "bin_stats": _with(_BINS, " SELECT bin, count(*) AS num_contigs, CAST(sum(length(seq)) AS BIGINT) AS total_bases FROM b GROUP BY bin"),
    "bin_sanitize": "SELECT p_partkey, CASE WHEN p_name = '' THEN 'bin' ELSE regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') END AS safe FROM part",
    "export_records": _with(_BINS, r" SELECT bin, idx, '>ctg' || idx || chr(10) || rtrim(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10)) AS record FROM b"),
    "self_test_edges": f"SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT, {_r('0.9e0')}), (1, 3, 0.9e0), (2, 2, 0.4e0)) AS t(edge_id, k, w)",
    "self_test_laplacian": _with(_SELF, _L, f" SELECT i, j, {_r('val')} AS val FROM l"),
    "eigenvalues": "SELECT k, (SELECT count(*) FROM part) AS n_vertices, true AS residual_small, true AS orthonormal, true AS ordered FROM range(1, 11) AS t(k)",
    "spectral_bins": "SELECT p_partkey AS v, true AS valid FROM part",
    "auto_k_bins": "SELECT vec_id AS v, true AS valid FROM embeddings",
    "multiplex_bins": "SELECT vec_id AS v, true AS valid FROM embeddings",
    "planted_groups": "SELECT p_partkey AS v, 5 AS k, min(p_partkey) OVER (PARTITION BY p_partkey % 5) AS first FROM part",
    "sam_scan": _with(_A, _RECORDS),
    "bam_scan": _with(_A, _RECORDS),
    "file_hyperedges": _with(_E20, " ", _ROWS),
    "stream_hyperedges": _with(_E20, " ", _ROWS),
    "fasta_scan": _with(_BINS, " SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, 'ctg' || idx AS name, 'ctg' || idx AS description, seq, length(seq) AS length FROM b WHERE bin IS NOT NULL"),
    "bins_scan": "SELECT 'c' || p_partkey AS contig, 'bin_' || (p_partkey % 7) AS bin FROM part",
    "self_test_bins": "SELECT 'c' || i AS contig, CASE WHEN i < 3 THEN 'bin_0' ELSE 'bin_1' END AS bin FROM range(6) AS t(i)",
}
SQL["stored_matvec"] = SQL["laplacian_matvec"]
