"""Small files beside the tables: reports, metadata, quarantined rows."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def _local(path: str) -> Path | None:
    """The local file that a path or a file: URI names, None for other stores."""
    url = urlparse(path)
    if len(url.scheme) > 1 and url.scheme != "file":
        return None
    return Path(unquote(url.path)) if url.scheme == "file" else Path(path)


def _on_store(path: str) -> tuple[Any, Any, Any]:
    """JVM, Hadoop path and file system of a path on another store, through the running session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(path: str | None, text: str) -> None:
    """Write a text, making folders as needed, on any store that Spark knows; without a path, nothing."""
    if not path:
        return
    out = _local(path)
    if out is not None:
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(text, encoding="utf-8")
        return
    _, file, fs = _on_store(path)
    stream = fs.create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(path: str) -> str:
    source = _local(path)
    if source is not None:
        return source.read_text(encoding="utf-8")
    jvm, file, fs = _on_store(path)
    stream = fs.open(file)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(path: str | None, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str))


def read_json(path: str) -> Any:
    return json.loads(read_text(path))


def input_files(df: DataFrame) -> list[str]:
    """The files of a scan, sorted; ValueError if there are none."""
    files = sorted(df.inputFiles())
    if not files:
        raise ValueError("the input has no files")
    return files


def quarantine(df: DataFrame, path: str) -> bool:
    """Write rows that were set apart; an empty set leaves no folder."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_failed(frames: dict[str, DataFrame], base: str, most: int = 100) -> list[str]:
    """A sample of the rows of each failed check, so many at most, in a folder of the check's name."""
    paths = {name: f"{base}/{name}" for name in frames}
    for name, path in paths.items():
        frames[name].limit(most).write.mode("overwrite").parquet(path)
    return list(paths.values())
