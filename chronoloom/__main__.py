"""python -m chronoloom: list the catalogue's queries, run one over a folder of tables and write its rows, or transcribe a folder of audio files (E5)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.render import PROFILES
from .plans import catalogue, transcribe
from .sources import readers
from .sources.stages import KEY


def written(found, chosen: argparse.Namespace) -> int:
    if chosen.output:
        found.write.format(chosen.format).mode("overwrite").save(chosen.output)
    else:
        found.show(50, truncate=False)
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    parser.add_argument("query", nargs="?", help="name of a query")
    parser.add_argument("--tables", help="folder of the tables' Parquet files")
    parser.add_argument("--output", help="folder for the rows; without it they are shown")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    parser.add_argument("--list", action="store_true", help="names of all queries")
    parser.add_argument("--audio", help="files to transcribe (a path or pattern)")
    parser.add_argument("--stages", help="folder of the stages' tables, kept between runs")
    parser.add_argument("--language", help="language of the tracks, where it isn't told by their transcription")
    parser.add_argument("--profile", default="inline_slash", choices=sorted(PROFILES))
    parser.add_argument("--engine", action="append", default=[], metavar="KIND=NAME", help=f"engine of a kind ({', '.join(transcribe.ENGINES.values())})")
    chosen = parser.parse_args(arguments)
    if chosen.audio:
        if any("=" not in e for e in chosen.engine):
            parser.error("--engine takes KIND=NAME")
        spark = SparkSession.builder.appName("chronoloom transcribe").getOrCreate()
        audio = readers.content_ids(spark, chosen.audio).withColumnRenamed("content_id", KEY)
        options = transcribe.Options(chosen.language, chosen.profile, dict(e.split("=", 1) for e in chosen.engine))
        return written(transcribe.transcribe(spark, audio, chosen.stages, options).select(KEY, "value.*"), chosen)
    if chosen.list:
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if chosen.query not in catalogue.QUERIES or not chosen.tables:
        parser.error("a known query and --tables are needed; see --list")
    found = catalogue.QUERIES[chosen.query](SparkSession.builder.appName(f"chronoloom {chosen.query}").getOrCreate(), chosen.tables)
    return written(found, chosen)


if __name__ == "__main__":
    raise SystemExit(main())
