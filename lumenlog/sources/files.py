"""Small files on any file system that Spark reads: text in and out, lists, removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob."""
    p, fs = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames, so readers see the old text or the new one."""
    p, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.next")
    stream = fs.create(beside, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    replace(spark, f"{path}.next", path)


def replace(spark: SparkSession, new: str, target: str) -> None:
    """Puts ``new`` in the place of ``target``; the old one is moved aside first and removed last, so one of the two always is there."""
    made, fs = _path(spark, new)
    place, _ = _path(spark, target)
    aside, _ = _path(spark, f"{target}.old")
    fs.delete(aside, True)
    if fs.exists(place) and not fs.rename(place, aside):
        raise OSError(f"can't move {target} aside")
    if not fs.rename(made, place):
        raise OSError(f"can't rename {new}")
    fs.delete(aside, True)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)
