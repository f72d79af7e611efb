"""Command line: ``python -m hyperweave.cli pipeline|multiplex|self-test|export-bins``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from hyperweave.config import load_config
from hyperweave.plans import pipelines


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hyperweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("pipeline", "multiplex"):
        p = commands.add_parser(name)
        p.add_argument("config")
        p.add_argument("--k", type=int)
        if name == "multiplex":
            p.add_argument("--beta", type=float)
    commands.add_parser("self-test")
    p = commands.add_parser("export-bins")
    for arg in ("contigs", "bins", "out_dir"):
        p.add_argument(arg)
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("hyperweave").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("hyperweave").getOrCreate()
    if a.command == "pipeline":
        pipelines.run_single(spark, load_config(a.config, a.k)).show()
    elif a.command == "multiplex":
        pipelines.run_multiplex(spark, load_config(a.config, a.k, a.beta)).show()
    elif a.command == "export-bins":
        pipelines.export_bins(spark, a.contigs, a.bins, a.out_dir).show()
    else:
        pipelines.self_test(spark).orderBy("contig").show()


if __name__ == "__main__":
    main()
