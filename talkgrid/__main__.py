"""``python -m talkgrid TABLES OUT``: every artefact of the recordings in a folder of tables."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="talkgrid", description=__doc__)
    parser.add_argument("tables", help="folder with segments.parquet and events_timeline.parquet")
    parser.add_argument("out", help="folder that gets one folder for each artefact")
    given = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from talkgrid.plans import pipeline

    names = pipeline.run(SparkSession.builder.appName("talkgrid").getOrCreate(), given.tables, given.out)
    print("\n".join(names))
    return names


if __name__ == "__main__":
    main()
