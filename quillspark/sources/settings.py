"""Settings of checks as a JSON file, found in a folder or above it."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import SparkSession

from ..functions.tables import files_of
from ..operators.checks import Config
from .discovery import above
from .files import arrow_files

NAME = "quillspark.json"
#: What a file can't say: functions.
_CODE = {"parser"}


def _plain(config: Config) -> dict:
    return {k: v for k, v in asdict(config).items() if k not in _CODE}


def load(spark: SparkSession, start: str) -> Config:
    """The settings of a file of that name, or of the first NAME in a path's folder or above it; those that aren't said, and all where there is none, are the usual ones.

    Settings that don't exist are an error, as a slip of the pen would otherwise go unnoticed."""
    path = start if start.endswith(".json") else above(spark, start, NAME)
    if path is None:
        return Config()
    text = spark.read.text(path, wholetext=True).first()
    said = json.loads(text["value"]) if text else {}
    known = {f.name for f in fields(Config)} - _CODE
    if unknown := sorted(set(said) - known):
        raise ValueError(f"{path}: no such settings: {', '.join(unknown)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


def save(spark: SparkSession, folder: str, config: Config | None = None) -> str:
    """Writes all settings into a folder's NAME, as a template; one that is there already stays."""
    files, path = files_of(spark, f"{folder}/{NAME}")
    if not files.exists(path):
        # Not by Hadoop's own streams: they leave a checksum beside it, which an edit by hand would belie.
        own, root = arrow_files(path.getParent().toString())
        with own.open_output_stream(f"{root}/{NAME}") as stream:
            stream.write((json.dumps(_plain(config or Config()), indent=2, ensure_ascii=False) + "\n").encode())
    return path.toString()
