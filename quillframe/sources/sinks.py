"""Sinks: label-free JSON lines, idempotent and atomic publication, reports, shards and bundles."""

from __future__ import annotations

import hashlib
import io
import json
import os
import platform
import shutil
import tarfile
import tempfile
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that would leak a label into a blind output.
FORBIDDEN = frozenset({"answer", "evidence", "labels", "candidate_answers", "portal_score", "portal_scores"})


class LeakError(ValueError):
    """An output holds a label column."""


def label_free(df: DataFrame) -> DataFrame:
    """The frame itself, or an error if a column, at any depth, names a label."""

    def names(kind) -> set[str]:
        if hasattr(kind, "fields"):
            return {f.name for f in kind.fields} | set().union(*[names(f.dataType) for f in kind.fields])
        inner = [getattr(kind, a) for a in ("elementType", "valueType", "keyType") if hasattr(kind, a)]
        return set().union(*[names(k) for k in inner])

    if leaked := sorted(names(df.schema) & FORBIDDEN):
        raise LeakError(", ".join(leaked))
    return df


def write_json_lines(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """One JSON object a line with sorted keys and nulls kept, as a folder of parts in range order of ``sort``."""
    ordered = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
    ordered.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """One folder per shard; each shard is written by the tasks that hold it."""
    df.repartition(shard).write.mode("errorifexists").partitionBy(shard).json(path)


def flat_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV can hold every column."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def publish(path: str | Path, payload: bytes) -> str:
    """Write a small report in one step and give its SHA-256; the same content twice is fine, another is an error."""
    target = Path(path)
    digest = hashlib.sha256(payload).hexdigest()
    if target.exists():
        if hashlib.sha256(target.read_bytes()).hexdigest() != digest:
            raise FileExistsError(f"{target} holds other content")
        return digest
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(payload)
            file.flush()
            os.fsync(file.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return digest


def publish_pair(first: tuple[str, bytes], second: tuple[str, bytes]) -> tuple[str, str]:
    """Both reports complete beside their targets before either takes its name."""
    staged = []
    for path, payload in (first, second):
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        temp = target.with_name(f".{target.name}.staged")
        temp.write_bytes(payload)
        staged.append((temp, target, hashlib.sha256(payload).hexdigest()))
    for temp, target, _ in staged:
        os.replace(temp, target)
    return staged[0][2], staged[1][2]


def markdown(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A small summary as a Markdown table; a larger one is an error, for a report is no export."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *body, ""])


def bundle(files: dict[str, bytes], path: str | Path) -> str:
    """A tar.gz whose bytes depend on nothing but names and contents."""
    import gzip

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name in sorted(files):
            entry = tarfile.TarInfo(name)
            entry.size, entry.mode, entry.mtime = len(files[name]), 0o644, 0
            tar.addfile(entry, io.BytesIO(files[name]))
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", mtime=0, filename="") as zipped:
        zipped.write(raw.getvalue())
    return publish(path, packed.getvalue())


def manifest(files: dict[str, bytes]) -> bytes:
    """Names, sizes and hashes of a bundle's members as JSON."""
    rows = [{"name": n, "bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(files.items())]
    return json.dumps(rows, ensure_ascii=False, indent=1).encode()


def prompt_safe(text: F.Column) -> F.Column:
    """Angle brackets as escapes, so that data cannot close the delimiter around it."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


#: The file that marks a folder as one this package may replace.
OWNED = ".quillframe-owned"


def managed(path: str | Path) -> Path:
    """An empty folder for reports: a new one, or one this package made before; any other folder with content is an error."""
    folder = Path(path)
    if folder.is_symlink() or (folder.exists() and not folder.is_dir()):
        raise FileExistsError(f"{folder} is no folder of its own")
    if folder.exists() and any(folder.iterdir()):
        if not (folder / OWNED).is_file():
            raise FileExistsError(f"{folder} holds files of others")
        shutil.rmtree(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / OWNED).write_text("")
    return folder


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> bytes:
    """The platform, the interpreter and the versions of packages as JSON with sorted keys; a missing package is null."""
    found: dict[str, str | None] = {}
    for name in packages:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    told = {"platform": platform.system(), "machine": platform.machine(), "python": platform.python_version(), "packages": found}
    return (json.dumps(told, sort_keys=True) + "\n").encode()
