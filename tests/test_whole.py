"""Queries do their whole job."""

import numpy as np
import pytest

from hyperweave import queries as Q
from hyperweave.operators import spectral


def test_eigengap_takes_the_whole_series(spark):
    values = [float(i) for i in range(60)] + [500.0, 501.0, None]  # the largest step comes after the first 50 rows
    series = spark.createDataFrame([(v,) for v in reversed(values)], "val double")
    assert spectral.largest_gap_of(series) == (60, 441.0)
    assert spectral.largest_gap_of(series.limit(1)) is None and spectral.largest_gap_of(series.where("val > 500")) is None
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=3000), 3)
    k, gap = spectral.largest_gap_of(spark.createDataFrame([(float(v),) for v in x], "val double").repartition(7))
    x.sort()
    assert k == spectral.largest_gap(x, 1, len(x) - 1) and np.isclose(gap, np.diff(x).max())
    assert Q.QUERIES["eigengap"](spark, "/root/testdata/sf0.01").collect()[0].k == 53


def test_hypergraph_queries_keep_members_beyond_the_fourth(spark):
    d = "/root/testdata/sf0.001"
    members = {r.edge_id: set(r.members) for r in Q.edges(spark, d).collect()}
    assert max(map(len, members.values())) > 4
    assert {(r.edge_id, r.v) for r in Q.QUERIES["incidence"](spark, d).collect()} == {(e, v) for e, some in members.items() for v in some}
    assert {r.v for r in Q.QUERIES["vertex_degree"](spark, d).collect()} == {r.p_partkey for r in spark.read.parquet(f"{d}/part.parquet").collect()}


def test_bins_and_eigenvalues_take_whole_hyperedges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.hyperedges, "hyperedges", lambda a, c, f, real=Q.hyperedges.hyperedges: (seen.append(f.max_hyperedge_size), real(a, c, f))[1])
    for name in ("eigenvalues", "spectral_bins", "multiplex_bins"):
        Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [20, 20, 20]


def test_bins_take_all_documents(spark):
    d = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").where("source IS NOT NULL").select("doc_id").collect()}
    assert {r.idx for r in Q.QUERIES["export_records"](spark, d).select("idx").collect()} == ids
    assert sum(r.num_contigs for r in Q.QUERIES["bin_stats"](spark, d).collect()) == len(ids)
