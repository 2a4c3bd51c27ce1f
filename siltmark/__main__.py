"""python -m siltmark FILE_OR_FOLDER... [--out FOLDER]: profile, relate and validate files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siltmark.plans import pipeline
from siltmark.sources import readers, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siltmark", description=__doc__)
    p.add_argument("inputs", nargs="+", help="files, or folders whose files are read")
    p.add_argument("--out", default="siltmark_output")
    p.add_argument("--zip", action="store_true", help="pack the folder that is written as well")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siltmark").getOrCreate()
    suffixes = tuple(readers.READERS)
    files = [f for i in a.inputs for f in ([i] if i.rstrip("/").lower().endswith(suffixes) else readers.discover(spark, i))]
    if not files:
        p.error("no file that can be read")
    result = pipeline.run(spark, files, a.out)
    if a.zip:
        print(f"packed as {sinks.pack(result.folder)}")
    print("\n".join([f"written to {result.folder}", *sinks.relationship_lines(result.relationships)]))


if __name__ == "__main__":
    main()
