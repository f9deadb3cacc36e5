"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(path: str, given: dict | None = None) -> dict:
    """The options of a TOML file, with those given in place of its own."""
    with open(path, "rb") as f:
        return tomllib.load(f) | {k: v for k, v in (given or {}).items() if v is not None}


def main(name: str, run: Callable, config: str, paths: tuple[str, ...]) -> None:
    """A job's command line: reads the options, creates a session, runs the job in it and stops it."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", default=config, help="TOML file of the options")
    for p in paths:
        parser.add_argument(f"--{p}", help=f"path of the {p}, in place of the file's")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    options = settings(given.pop("config"), given)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, options)
    finally:
        spark.stop()
