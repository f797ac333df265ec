"""Run a query from the command line: python -m lumenframe NAME SF_DIR [--out FOLDER] [--explain]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lumenframe import registry


def main() -> None:
    p = argparse.ArgumentParser(prog="lumenframe", description="Run one of the library's queries.")
    p.add_argument("name", choices=sorted(registry.QUERIES), metavar="NAME", help="a query of the registry")
    p.add_argument("sf_dir", help="folder of the Parquet tables")
    p.add_argument("--out", help="write the result there as Parquet instead of showing it")
    p.add_argument("--explain", action="store_true", help="show the plan, too")
    p.add_argument("--version", action="version", version="lumenframe 0.1")
    a = p.parse_args()
    df = registry.QUERIES[a.name](SparkSession.builder.appName("lumenframe").getOrCreate(), a.sf_dir)
    if a.explain:
        df.explain("formatted")
    df.write.parquet(a.out) if a.out else df.show()


if __name__ == "__main__":
    main()
