"""Result files ``dataset-<sheet>_<model>_test.csv``, whole or not at all.

Tasks write sorted parts to a folder for this call. Then one small file, the log of
the folder, names them, and from that moment on the results are the new ones. Each
part is moved to its place by one rename. A reader that finds a move undone reads the
part where it still lies, and the next writer finishes it; so whatever moment a
writer is cut off at, readers see all of the old results or all of the new ones.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk import files
from msgrisk.sources.results import LOG, RESULT_NAME, read_log

CSV = {
    "header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_results(
    df: DataFrame, folder: str, model: str, sheet: str = "sheet", position: str = "position",
    rows_per_part: int | None = None,
) -> None:
    """Write the rows of each sheet, in order, as its result of a model.

    A result that one task wrote is a file, a larger one a folder of numbered files of
    the same name. Results of the same sheet and model are replaced, others stay. The
    columns but for sheet and position are written; a sheet may be text or a number and
    must have no slash in it; rows without a sheet are an error. With ``rows_per_part``
    parts have about that many rows, else Spark decides. One writer at a time.
    """
    stage_results(df, folder, model, sheet, position, rows_per_part)
    finish(df.sparkSession, folder)


def stage_results(
    df: DataFrame, folder: str, model: str, sheet: str = "sheet", position: str = "position",
    rows_per_part: int | None = None,
) -> None:
    """``write_results`` up to the moment from which on the results count.

    Readers see them where they lie; ``finish`` or the next writer moves them.
    """
    spark = df.sparkSession
    finish(spark, folder)
    for left in files.names(spark, folder):  # by writers that were cut off
        if left.startswith("_staged-"):
            files.remove(spark, f"{folder}/{left}")
    name = F.col(sheet).cast("string")
    checked = F.when(name.isNull() | F.contains(name, F.lit("/")), F.raise_error(F.concat(
        F.lit("no name of a sheet: "), F.coalesce(name, F.lit("null"))))).otherwise(name)
    rows = df.withColumn("_sheet", checked)
    keys = ["_sheet", position]
    if rows_per_part:
        parts = max(1, -(-rows.count() // rows_per_part))
        rows = rows.repartitionByRange(parts, *keys)
    else:
        rows = rows.repartitionByRange(*keys)
    kept = [c for c in df.columns if c not in (sheet, position)]
    staged = f"_staged-{uuid.uuid4().hex}"
    written = f"{folder}/{staged}/parts"
    sorted_rows = rows.sortWithinPartitions(*keys).select("_sheet", *[F.col(f"`{c}`") for c in kept])
    sorted_rows.write.options(**CSV).partitionBy("_sheet").csv(written)
    found = _named(spark, written, model)
    for target, source in found.items():
        files.move(spark, f"{written}/{source}", f"{folder}/{staged}/{target}")
    log = read_log(spark, folder)
    results = {**log["files"]}
    for target in found:
        results.setdefault(target.split("/")[0], [])
    for result in {t.split("/")[0] for t in found}:
        results[result] = sorted(t for t in found if t.split("/")[0] == result)
    files.write_text(spark, f"{folder}/{LOG}", json.dumps({"files": results, "staged": staged}))


def _named(spark: SparkSession, written: str, model: str) -> dict[str, str]:
    """Where each part belongs. Parts of a sheet are numbered in the order of tasks."""
    found: dict[str, list[str]] = {}
    for folder in files.names(spark, written):
        if folder.startswith("_sheet="):
            sheet = _unescaped(folder.removeprefix("_sheet="))
            parts = [n for n in files.names(spark, f"{written}/{folder}") if n.startswith("part-")]
            found[RESULT_NAME.format(sheet=sheet, model=model)] = [f"{folder}/{n}" for n in sorted(parts)]
    named = {}
    for result, parts in found.items():
        for i, part in enumerate(parts):
            named[result if len(parts) == 1 else f"{result}/{i:05}.csv"] = part
    return named


def _unescaped(name: str) -> str:
    """The value in the name of a partition folder."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def finish(spark: SparkSession, folder: str) -> None:
    """Make the moves that a writer may not have come to, and clear its folder."""
    log = read_log(spark, folder)
    staged = log["staged"]
    if staged is None:
        return
    for result, parts in log["files"].items():
        moving = [p for p in parts if files.is_there(spark, f"{folder}/{staged}/{p}")]
        # The old result goes as soon as its first part is moved, and not once one has been.
        if moving and len(moving) == len(parts):
            files.remove(spark, f"{folder}/{result}")
        for part in moving:
            if not files.move(spark, f"{folder}/{staged}/{part}", f"{folder}/{part}"):
                raise OSError(f"cannot move {part}")
    files.write_text(spark, f"{folder}/{LOG}", json.dumps(log | {"staged": None}))
    files.remove(spark, f"{folder}/{staged}")
