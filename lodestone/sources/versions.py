"""Versions of a base: one file per commit decides what its readers see.

A version's tables lie in a folder of their own, `data-<id>`, below the base's path; then
`_versions/<number>.json` is created, never overwritten, and names that folder, the schema
revision and the tables. Its creation is the commit: before it readers see the version
before, after it this one, and a writer that is killed leaves files that no version names
(`vacuum` removes them). Two writers cannot commit the same number: the second one's
creation fails and it takes the next. No folder is ever renamed, so object stores will do.

A folder without `_versions` is a base of one version whose tables lie in it directly.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lodestone.errors import BadArguments

LOG = "_versions"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str  # where the tables lie
    revision: int | None  # of the schema; None where nothing says
    id: str | None  # names this content
    tables: tuple[str, ...] | None = None


def file_system(spark: SparkSession, path: str):
    """(file system, Path class) for a path."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, Path = file_system(spark, path)
    stream = fs.open(Path(path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; False if there is one already."""
    fs, Path = file_system(spark, path)
    at = Path(path)
    if fs.exists(at):
        return False
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, ascending."""
    fs, Path = file_system(spark, path)
    log = Path(f"{path}/{LOG}")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def resolve(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The version to read: the latest, or the asked one."""
    path = path.rstrip("/")
    known = numbers(spark, path)
    if not known:
        if number is not None:
            raise BadArguments(f"{path} has no versions")
        return Version(0, path, None, None)
    number = known[-1] if number is None else number
    if number not in known:
        raise BadArguments(f"{path}: no version {number}, there are {known[0]} to {known[-1]}")
    saved = json.loads(read_text(spark, f"{path}/{LOG}/{number:012d}.json"))
    return Version(number, f"{path}/{saved['folder']}", saved["revision"], saved["id"], tuple(saved["tables"]))


def new_folder() -> tuple[str, str]:
    """(id, folder name) for the tables of the next version."""
    id_ = uuid.uuid4().hex
    return id_, f"data-{id_}"


def commit(spark: SparkSession, path: str, id_: str, revision: int, tables: list[str]) -> Version:
    """Makes the tables written to `data-<id>` the latest version."""
    path = path.rstrip("/")
    text = json.dumps({"id": id_, "folder": f"data-{id_}", "revision": revision, "tables": sorted(tables)})
    number = (numbers(spark, path) or [0])[-1] + 1
    while not create_text(spark, f"{path}/{LOG}/{number:012d}.json", text):
        number += 1
    return resolve(spark, path, number)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes all but the last ``keep`` versions, and folders of writers that never committed; gives their names.

    Not to be called while somebody writes to or still reads what goes."""
    path = path.rstrip("/")
    if keep < 1:
        raise BadArguments("the latest version stays")
    fs, Path = file_system(spark, path)
    known = numbers(spark, path)
    live = {resolve(spark, path, n).folder.rpartition("/")[2] for n in known[-keep:]}
    for n in known[:-keep]:  # first the names, then what they name
        fs.delete(Path(f"{path}/{LOG}/{n:012d}.json"), False)
    gone = [s.getPath().getName() for s in fs.listStatus(Path(path)) if s.getPath().getName().startswith("data-")] if fs.exists(Path(path)) else []
    gone = [n for n in gone if known and n not in live]
    for n in gone:
        fs.delete(Path(f"{path}/{n}"), True)
    return gone
