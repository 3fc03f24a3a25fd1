"""Optimistic commits to a folder: version n exists once, by whoever creates its manifest first.

A manifest is a small JSON file that is only ever created where it is absent. Data are written before it, to a place of
their own, and are read only through a manifest, so a writer that dies or loses leaves nothing that a reader sees. On a
local or mounted path the file is linked into place; elsewhere the file system's own create-if-absent decides, and a
manifest that is still empty counts as not there yet.
"""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_MANIFESTS = "_manifests"
_PATIENCE_S = 60.0


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_MANIFESTS}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(version: int) -> str:
    return f"{version:012d}.json"


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The number and content of the last version; -1 and None where there is none."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return -1, None
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0].isdigit())
    for name in reversed(names):
        content = _content(spark, files, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name))
        if content is not None:
            return int(name[:12]), content
    return -1, None


def _content(spark: SparkSession, files, path) -> dict | None:
    stream = files.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text else None


def commit(spark: SparkSession, folder: str, version: int, content: dict) -> bool:
    """Creates version ``version``, one more than the last that the writer has seen; False if another writer was first."""
    path, files = _files(spark, folder)
    files.mkdirs(path)
    text = json.dumps(content, sort_keys=True)
    if files.getUri().getScheme() == "file":
        local = urlparse(path.toString()).path
        handle, draft = tempfile.mkstemp(dir=local, prefix="draft-")
        try:
            with os.fdopen(handle, "w") as f:
                f.write(text)
            os.link(draft, f"{local}/{_name(version)}")  # fails where the name is taken, and shows the whole file at once
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    jvm = spark.sparkContext._jvm
    try:
        out = files.create(jvm.org.apache.hadoop.fs.Path(path, _name(version)), False)
    except Exception as e:  # py4j wraps what Java throws
        if "AlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def updated(spark: SparkSession, folder: str, change, tries_s: float = _PATIENCE_S) -> dict:
    """Commits what ``change`` makes of the last content, again from the new one where another writer was first."""
    end, turn = time.monotonic() + tries_s, 0
    while True:
        version, content = latest(spark, folder)
        new = change(content)
        if commit(spark, folder, version + 1, new):
            return new
        if time.monotonic() > end:
            raise TimeoutError(f"others keep committing to {folder}")
        turn += 1
        time.sleep(random.uniform(0, min(1.0, 0.02 * 2**turn)))  # so that writers do not meet again
