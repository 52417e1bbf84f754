"""Message datasets in CSV files of unknown charset, and files of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from msgrisk.sources import records, results
from msgrisk.sources.results import RESULT_NAME  # noqa: F401

# Datasets scored when none are named.
DEFAULT_DATASETS = ["datasets/dataset-正常短信.csv", "datasets/dataset-广告.csv"]

# Texts that stand for a missing number in a CSV file, as
# documented for pandas.read_csv.
NULL_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or patterns) that match something, in the order given."""
    kept = []
    for path in paths:
        hadoop, files = _hadoop_path(spark, path)
        if files.globStatus(hadoop):
            kept.append(path)
    return kept


def number_or_null(value: Column) -> Column:
    """A number written in a CSV cell; null for a null mark or no number."""
    text = F.trim(value)
    return F.when(~text.isin(NULL_MARKS), text.try_cast("double"))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(F.url_decode(F.regexp_replace(path, "\\+", "%2B")), "[^/]*$", 0)
    return F.regexp_replace(name, "\\.csv$", "")


def read_datasets(
    spark: SparkSession, paths: list[str] | None = None, schema: str | None = None
) -> DataFrame:
    """All rows of the datasets, absent files skipped.

    Each file is read in the first of the charsets UTF-8, GBK and Latin-1 that fits all
    of it, by many tasks if it is large. Columns go by the names in the header of each
    file, whatever their order; a column that a file lacks is null there. All are carried
    along as text, those of ``schema`` as the types it gives and ``rating`` as a number;
    ``dataset`` and ``position``, the row's number in its file, come on top.
    """
    present = existing(spark, DEFAULT_DATASETS if paths is None else paths)
    if not present:
        raise FileNotFoundError("none of the datasets exists")
    rows = records.read_table(spark, present, {"dataset": file_stem(F.col("file"))})
    if "content" not in rows.columns:
        raise ValueError("the datasets lack the column content")
    for field in StructType.fromDDL(schema) if schema else ():
        value = F.col(f"`{field.name}`") if field.name in rows.columns else F.lit(None)
        if isinstance(field.dataType, NumericType):
            value = number_or_null(value.cast("string")) if field.name in rows.columns else value
        rows = rows.withColumn(field.name, value.try_cast(field.dataType))
    if "rating" in rows.columns:
        rows = rows.withColumn("rating", number_or_null(F.col("rating").cast("string")))
    return rows


def read_ratings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Merged labels: ``content, human rating, rating`` from UTF-8 CSV files."""
    df = records.read_table(spark, [paths] if isinstance(paths, str) else paths)
    missing = {"human rating", "rating"} - set(df.columns)
    if missing:
        raise ValueError(f"ratings lack the columns {sorted(missing)}")
    return df.withColumns(
        {name: number_or_null(F.col(f"`{name}`")) for name in ("human rating", "rating")}
    )


def read_model_output(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """Result files ``dataset-<sheet>_<model>_test.csv`` of a folder.

    Columns ``content, rating, sheet, model, position``. With a model given only
    its files are read. Files that ``sinks.results`` writes count from the moment on at
    which all of them are there; a result may be a folder of numbered parts.
    """
    paths = results.result_paths(spark, folder, model)
    if not paths:
        raise FileNotFoundError(f"no result files of {model or 'any model'} in {folder}")
    path = F.url_decode(F.regexp_replace("file", "\\+", "%2B"))
    stem = F.regexp_extract(path, "/(dataset-[^/]*_test)\\.csv(/[0-9]+\\.csv)?$", 1)
    part = F.regexp_extract(path, "_test\\.csv/([0-9]+)\\.csv$", 1)
    carried = {"_stem": stem, "_part": F.coalesce(part.try_cast("bigint"), F.lit(0))}
    df = records.read_table(spark, [_glob_literal(p) for p in paths], carried)
    if "rating" not in df.columns:
        raise ValueError("the result files lack the column rating")
    if "position" in df.columns:
        df = df.withColumn("position", F.shiftleft("_part", 33) + F.col("position").cast("bigint"))
    if model:
        sheet = F.substr("_stem", F.lit(9), F.length("_stem") - F.lit(len(f"dataset-_{model}_test")))
        columns = {"sheet": sheet, "model": F.lit(model)}
    else:
        columns = {
            "sheet": F.regexp_extract("_stem", "^dataset-(.*)_(.*)_test$", 1),
            "model": F.regexp_extract("_stem", "^dataset-(.*)_(.*)_test$", 2),
        }
    return df.withColumns({**columns, "rating": number_or_null(F.col("rating"))}).drop("_stem", "_part")


def _glob_literal(text: str) -> str:
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in text)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """A table of scored datasets as written by the sink, one folder per
    dataset and model. A ``position`` is a number again, so rows keep their order."""
    df = spark.read.options(**CSV_OPTIONS, basePath=path).csv(path)
    typed = {c: F.col(c).cast("string") for c in ("dataset", "model")}
    if "position" in df.columns:
        typed["position"] = F.col("position").cast("bigint")
    return df.withColumn("rating", number_or_null(F.col("rating"))).withColumns(typed)
