"""What both jobs share: the configuration file, the log, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def read_config(path: str | None, known: dict[str, Any]) -> dict[str, Any]:
    """The defaults with what a JSON file gives instead. Keys that no default has, and values of another type, are refused."""
    given = json.loads(Path(path).read_text()) if path else {}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"unknown key {key!r}; known: {sorted(known)}")
        if type(value) is not type(known[key]):
            raise ValueError(f"{key} must be a {type(known[key]).__name__}, not {value!r}")
    return {**known, **given}


def default_file(module: str) -> str:
    """The configuration that lies beside a job."""
    return str(Path(module).with_suffix(".json"))


def command_line(about: str, paths: dict[str, str], config: str, work: Callable[..., Any], known: dict[str, Any], arguments: list[str] | None = None) -> None:
    """Reads the arguments, then runs `work` in a session that ends with it. Only here a session is made and stopped."""
    parser = argparse.ArgumentParser(description=about)
    for name, told in paths.items():
        parser.add_argument(f"--{name}", required=True, help=told)
    parser.add_argument("--config", default=config, help="a JSON file; without one, %(default)s")
    given = vars(parser.parse_args(arguments))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = read_config(given.pop("config"), known)
    spark = SparkSession.builder.appName(work.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, *(given[name] for name in paths), settings)
    finally:
        spark.stop()
