"""What the jobs share: configuration read by Spark, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession


def config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` with the values of a JSON file, which may lie in any store that Spark reads."""
    if not path:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given


def main(run, name: str, *paths: str, defaults: dict) -> None:
    """Run ``run(spark, *paths, settings)`` from a command line; only here a session starts and stops."""
    from paperloom.session import ship

    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = ship(SparkSession.builder.appName(name).getOrCreate())
    try:
        run(spark, *(getattr(given, p) for p in paths), config(spark, given.config, defaults))
    finally:
        spark.stop()
