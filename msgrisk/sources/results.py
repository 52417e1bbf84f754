"""Which result files of a folder count, and where they lie."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from msgrisk import files

RESULT_NAME = "dataset-{sheet}_{model}_test.csv"  # fixed value
LOG = "_results.json"


def read_log(spark: SparkSession, folder: str) -> dict:
    """``files``, the parts of each result, and ``staged``, the folder they are moved from."""
    text = files.read_text(spark, f"{folder}/{LOG}")
    return json.loads(text) if text else {"files": {}, "staged": None}


def result_paths(spark: SparkSession, folder: str, model: str | None = None) -> list[str]:
    """The files of the results (of a model), wherever they lie right now.

    A part that a writer has not come to move is read where it was written. Results that
    are not in the log, because others put them there, are read as they are.
    """
    log = read_log(spark, folder)
    tail = re.escape(f"_{model}_test.csv") if model else "_.*_test\\.csv"
    named = re.compile(f"dataset-.*{tail}")
    found = []
    for result, parts in log["files"].items():
        for part in parts if named.fullmatch(result) else ():
            staged = f"{folder}/{log['staged']}/{part}"
            moved = log["staged"] is None or not files.is_there(spark, staged)
            found.append(f"{folder}/{part}" if moved else staged)
    for name in files.names(spark, folder):
        if named.fullmatch(name) and name not in log["files"]:
            found.append(f"{folder}/{name}")
    return sorted(found)
