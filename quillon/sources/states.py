"""Saved states: tables that are written aside, then named by a manifest. What has no manifest does not exist for readers."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .scratch import file_system

VERSION = "1.0"
#: Seconds after which tables without a manifest are left over from a save that was stopped.
STALE = 3600


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """The file, whole or not at all: it is written beside its place and renamed."""
    fs, at = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}.aside")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"{path} cannot be put in place")


def get_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_tables(spark: SparkSession, folder: str, name: str, tables: dict[str, DataFrame]) -> str:
    """Tables written under a name of their own and renamed to folder/name once all are there. A folder of that name, which no manifest
    can name yet, is replaced."""
    aside = f"{folder}/{name}.{uuid.uuid4().hex}.aside"
    for table, df in tables.items():
        df.write.parquet(f"{aside}/{table}")
    fs, source = file_system(spark, aside)
    fs.mkdirs(source)
    _, target = file_system(spark, f"{folder}/{name}")
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{folder}/{name} cannot be put in place")
    return f"{folder}/{name}"


def save_state(spark: SparkSession, folder: str, session_id: str, tables: dict[str, DataFrame], *, progress: float = 0.0, current_file: str = "", remaining_files: int = 0, keep: int = 10) -> str:
    """Saves the tables of a session and gives the manifest's path, which templates.saved_states() lists and load_state() reads. First the
    tables are put in place, last the manifest: a save that is stopped anywhere leaves the former states as they were. The `keep` manifests
    modified last stay, with their tables."""
    if "/" in session_id or not session_id:
        raise ValueError("a session's name has no / and is not empty")
    saved_at = time.time()
    name = f"processing_state_{session_id}_{int(saved_at)}_{uuid.uuid4().hex[:8]}"
    put_tables(spark, folder, f"{name}.tables", tables)
    facts = {"version": VERSION, "saved_at": saved_at, "tables": sorted(tables), "metadata": {"session_id": session_id, "progress": progress, "current_file": current_file, "remaining_files": remaining_files}}
    path = f"{folder}/{name}.json"
    put_text(spark, path, json.dumps(facts, ensure_ascii=False, indent=2))
    retain(spark, folder, keep)
    return path


def load_state(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest's metadata and the tables by name. One of another version is read as well as it goes."""
    facts = json.loads(get_text(spark, path))
    base = path.removesuffix(".json") + ".tables"
    return facts["metadata"] | {"saved_at": facts["saved_at"]}, {t: spark.read.parquet(f"{base}/{t}") for t in facts["tables"]}


def retain(spark: SparkSession, folder: str, keep: int = 10) -> list[str]:
    """Deletes all manifests but the `keep` modified last (of equal times the greater names), each before its tables; and what stopped
    saves have left for an hour. Gives the names of the manifests that went."""
    fs, at = file_system(spark, folder)
    listed = [(s.getModificationTime(), s.getPath().getName(), s.getPath()) for s in fs.listStatus(at)]
    manifests = sorted((x for x in listed if x[1].startswith("processing_state_") and x[1].endswith(".json")), key=lambda x: x[:2])
    gone = manifests[: max(len(manifests) - keep, 0)]
    for _, name, path in gone:
        fs.delete(path, False)
        fs.delete(file_system(spark, f"{folder}/{name.removesuffix('.json')}.tables")[1], True)
    named = {n.removesuffix(".json") + ".tables" for _, n, _ in manifests}
    old = (time.time() - STALE) * 1000
    for modified, name, path in listed:
        if modified < old and (name.endswith(".aside") or name.startswith("processing_state_") and name.endswith(".tables") and name not in named):
            fs.delete(path, True)
    return [n for _, n, _ in gone]
