"""Folders and small files on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder, sorted; nothing if there is none."""
    folder, files = _at(spark, path)
    if not files.exists(folder):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(folder))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder, 0 if there is none."""
    found, files = _at(spark, path)
    return files.getContentSummary(found).getLength() if files.exists(found) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that is in it; it need not be there."""
    found, files = _at(spark, path)
    files.delete(found, True)


def is_there(spark: SparkSession, path: str) -> bool:
    found, files = _at(spark, path)
    return files.exists(found)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches."""
    found, files = _at(spark, pattern)
    return sorted(str(f.getPath().toString()) for f in files.globStatus(found) or [])


def read_text(spark: SparkSession, path: str) -> str | None:
    """What ``write_text`` wrote last, also if it was cut off; None if it never ran."""
    found, files = _at(spark, path)
    if not files.exists(found):
        found, _ = _at(spark, f"{path}.staged")
        if not files.exists(found):
            return None
    stream = files.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that ``read_text`` sees all of it or what was there before."""
    target, files = _at(spark, path)
    staged, _ = _at(spark, f"{path}.staged")
    stream = files.create(staged, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(target, False)
    if not files.rename(staged, target):
        raise OSError(f"cannot write {path}")


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder; false if the target is there or the source is not."""
    old, files = _at(spark, source)
    new, _ = _at(spark, target)
    if files.exists(new) or not files.exists(old):
        return False
    files.mkdirs(new.getParent())
    return files.rename(old, new)
