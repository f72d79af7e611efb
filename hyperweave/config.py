"""Settings of the pipelines, read from YAML; explicit arguments win over the file."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Filters:
    mapq_min: int = 30
    segment_min_bases: int = 1000
    min_segments_per_read: int = 3
    max_hyperedge_size: int = 20
    read_coverage_min: float = 0.0  # accepted for compatibility, has no effect
    min_contig_len: int = 2000


@dataclass(frozen=True)
class Config:
    contigs_fasta: str
    alignments: str
    output_dir: str
    filters: Filters = field(default_factory=Filters)
    k: int = 50
    maxiter: int = 300
    seed: int = 42
    edges_per_file: int = 200_000
    q_cap: float = 0.95  # accepted for compatibility, has no effect
    streaming: bool = True
    beta: float = 0.5
    knn_k: int = 10


def load_config(path: str, k: int | None = None, beta: float | None = None) -> Config:
    import yaml

    raw = yaml.safe_load(Path(path).read_text())
    spectral, multiplex, chunks = raw["spectral"], raw.get("multiplex") or {}, raw.get("streaming") or {}
    known = {f: raw["filters"][f] for f in Filters.__dataclass_fields__ if f in raw["filters"]}
    return Config(
        contigs_fasta=raw["inputs"]["contigs_fasta"], alignments=raw["inputs"]["porec_bam"], output_dir=raw["outputs"]["output_dir"],
        filters=Filters(**known), k=int(spectral.get("k", 50) if k is None else k), maxiter=int(spectral.get("maxiter", 300)), seed=int(spectral.get("seed", 42)),
        edges_per_file=int(chunks.get("edges_per_chunk", 200_000)), streaming=bool(chunks.get("enabled", True)), q_cap=float((raw.get("weights") or {}).get("q_cap", 0.95)),
        beta=float(multiplex.get("beta", 0.5) if beta is None else beta), knn_k=int(multiplex.get("knn_k", 10)),
    )
