"""Sources of (path, content, read_error): folders, the git index, tables. A file that can't be read is a row with its error.

Large folders are listed by tasks, level by level, and files are dealt to reading tasks by their sizes; the driver sees a bounded number of paths.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

# Paths that a walk of a folder leaves out. Patterns without **/ hold at the root only.
DEFAULT_IGNORE = ("node_modules/**", ".git/**", "dist/**", "build/**", "coverage/**", "*.log", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
EVERYTHING = ("**/*",)
SCHEMA = "path string, content string, read_error string"
#: Bytes and files of one reading task, about; a larger file is one by itself. What a file costs besides its bytes.
TASK_BYTES, FILE_BYTES = 32 << 20, 16 << 10
#: Folders that one task lists; files that the driver lists itself, at most, before it leaves the rest to tasks.
FOLDERS_A_TASK, NEAR_FILES = 64, 10_000


def relative(path: str, root: str) -> str:
    """Relative to root, with slashes; a path outside root starts with dots."""
    return os.path.relpath(path, root).replace(os.sep, "/")


def compiled(globs: Iterable[str], dot: bool) -> list[re.Pattern]:
    return [re.compile(glob_regex(g.removeprefix("./"), dot).replace("\\z", "\\Z")) for g in globs]


def is_wanted(path: str, include: list[re.Pattern], ignore: list[re.Pattern]) -> bool:
    return any(p.match(path) for p in include) and not any(p.match(path) for p in ignore)


class Wanted:
    """Which files of a tree are wanted, and which folders are entered. User ignores add to the default ones; folders that are
    ignored as a whole, and those that can't be opened, are passed over; links to folders aren't followed."""

    def __init__(self, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False):
        ignores = [*DEFAULT_IGNORE, *ignore]
        self.outs, self.ins = compiled(ignores, True), compiled(include or EVERYTHING, dot)
        self.whole = compiled([g.removesuffix("/**") for g in ignores if g.endswith("/**")], True)

    def children(self, root: str, folder: str) -> Iterator[tuple[str, int | None]]:
        """(path, size) of the wanted files in a folder below root, and (path, None) of the folders to enter, by name."""
        base = f"{folder}/" if folder else ""
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = base + e.name
            if e.is_dir(follow_symlinks=False):
                if not any(p.match(path) for p in self.whole):
                    yield path, None
            elif e.is_file() and is_wanted(path, self.ins, self.outs):
                try:
                    yield path, e.stat().st_size
                except OSError:
                    yield path, 0

    def below(self, root: str, folder: str = "") -> Iterator[tuple[str, int]]:
        """(path, size) of all wanted files below a folder."""
        for path, size in self.children(root, folder):
            if size is None:
                yield from self.below(root, path)
            else:
                yield path, size


def discover(root: str | Path, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False, absolute: bool = False) -> list[str]:
    """Files below root, on the driver: for a look at a small tree; listed() is for scans."""
    found = [path for path, _ in Wanted(ignore, include, dot).below(str(root))]
    return [os.path.join(str(root), p) for p in found] if absolute else found


def near(root: str, wanted: Wanted, most: int = NEAR_FILES) -> tuple[list[tuple[str, int]], list[str]]:
    """(path, size) of the files in the first levels, and the folders that are left: none in small trees, and all that
    follows once there are folders enough to share out, or too many files."""
    folders, found = [""], []
    while folders and len(folders) < FOLDERS_A_TASK:
        below: list[str] = []
        for k, folder in enumerate(folders):
            got = list(islice(wanted.children(root, folder), most - len(found) + 1))
            if len(found) + len(got) > most:
                return found, folders[k:] + below
            found += [x for x in got if x[1] is not None]
            below += [path for path, size in got if size is None]
        folders = below
    return found, folders


def listed(spark: SparkSession, root: str | Path, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False, most: int = NEAR_FILES) -> DataFrame:
    """(path, size) of the files below root. Of large trees the driver lists the beginning, the rest is listed by tasks, a level at a time."""
    wanted = list(ignore), list(include) if include else None, dot
    return _listed(spark, str(root), wanted, *near(str(root), Wanted(*wanted), most))


def _listed(spark: SparkSession, top: str, wanted: tuple, here: list[tuple[str, int]], folders: list[str]) -> DataFrame:
    from ..plans.store import stored

    def look(batches):
        which = Wanted(*wanted)
        for b in batches:
            for folder in b["path"]:
                rest = which.children(top, folder)
                while got := list(islice(rest, NEAR_FILES)):
                    yield pd.DataFrame(got, columns=["path", "size"]).astype({"size": "Int64"})

    found = spark.createDataFrame(here, "path string, size long")
    level = spark.createDataFrame([(f,) for f in folders], "path string")
    n = len(folders)
    while n:
        level, _ = stored(level.repartition(max(1, -(-n // FOLDERS_A_TASK))).mapInPandas(look, "path string, size long"), "level")
        found = found.unionByName(level.where("size is not null"))
        level = level.where("size is null").select("path")
        n = level.count()
    return found


def balanced(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of (path, size, ..) dealt to as many tasks as their sizes ask for, each of about task_bytes, large files first and apart.

    Files of over half a task's bytes have a task each. The others are dealt by running sums of sizes over an order of paths that mixes
    folders, cut at every task_bytes.
    """
    cost = F.coalesce("size", F.lit(0)) + FILE_BYTES
    large = cost > task_bytes // 2
    spread = rows.withColumn("_cost", cost).withColumn("_group", F.when(large, -1).otherwise(F.pmod(F.xxhash64("path"), F.lit(64))).cast("int"))
    sums = {r["_group"]: (r["n"], r["bytes"]) for r in spread.groupBy("_group").agg(F.count("*").alias("n"), F.sum("_cost").alias("bytes")).collect()}  # 65 rows at most
    if not sums:
        return rows
    first, n = {}, 0
    for g in sorted(sums):
        first[g] = n
        n += sums[g][0] if g < 0 else -(-sums[g][1] // task_bytes)
    from pyspark.sql import Window as W

    order = W.partitionBy("_group").orderBy("path")
    start = F.element_at(F.create_map(*[F.lit(x) for g, k in first.items() for x in (g, k)]), F.col("_group"))
    place = F.when(F.col("_group") < 0, F.row_number().over(order) - 1).otherwise(F.floor((F.sum("_cost").over(order) - F.col("_cost")) / task_bytes))
    return spread.withColumn("_task", (start + place).cast("int")).repartitionById(n, F.col("_task")).select(*rows.columns)


def packed(here: list[tuple[str, int]], task_bytes: int = TASK_BYTES) -> list[tuple[str, int, int]]:
    """(path, size, task) of a short list, dealt as balanced() deals."""
    out, task, left = [], -1, 0
    for path, size in sorted(here, key=lambda f: (f[1] <= task_bytes // 2, f[0])):
        cost = size + FILE_BYTES
        if cost > task_bytes // 2 or left < cost:
            task, left = task + 1, task_bytes if cost <= task_bytes // 2 else 0
        left -= cost
        out.append((path, size, task))
    return out


def paths_frame(spark: SparkSession, paths: list[str], files_a_task: int = 200) -> DataFrame:
    """A given list of paths as rows."""
    if not paths:
        return spark.createDataFrame([], "path string")
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, -(-len(paths) // files_a_task)))


def read_all(rows: DataFrame, reader: Callable[[str], bytes]) -> DataFrame:
    """Reads each path on the executors; reader gives bytes or raises."""
    return read_each(rows, lambda: reader)


def read_each(rows: DataFrame, open_reader: Callable[[], Callable[[str], bytes]], key: str = "path") -> DataFrame:
    """Reads what `key` names for each path, with one reader for each task; a reader with close() is closed.

    Bytes that aren't UTF-8 become replacement characters, as the JVM's make_valid_utf8 does it. A batch ends once enough bytes are in it.
    """

    def read(batches):
        reader = open_reader()
        try:
            for b in batches:
                got, size = [], 0
                for p, k in zip(b["path"], b[key], strict=True):
                    try:
                        raw = reader(k)
                        got.append((p, raw, None))
                        size += len(raw)
                    except Exception as e:  # noqa: BLE001  whatever keeps a file from being read is that file's skip reason
                        got.append((p, None, str(e) or type(e).__name__))
                    if size >= TASK_BYTES:
                        yield pd.DataFrame(got, columns=["path", "raw", "read_error"])
                        got, size = [], 0
                yield pd.DataFrame(got, columns=["path", "raw", "read_error"])
        finally:
            getattr(reader, "close", lambda: None)()

    raw = rows.select("path", *[key] * (key != "path")).mapInPandas(read, "path string, raw binary, read_error string")
    return raw.select("path", F.when(F.col("read_error").isNull(), F.make_valid_utf8(F.col("raw").cast("string"))).alias("content"), "read_error")


def disk(spark: SparkSession, root: str | Path, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False) -> DataFrame:
    """Files of a folder that all executors see. Names that start with dots or underscores are read like others, which
    Spark's own readers pass over."""
    top = str(root)

    def reader(path: str) -> bytes:
        return Path(top, path).read_bytes()

    wanted = list(ignore), list(include) if include else None, dot
    here, folders = near(top, Wanted(*wanted))
    if folders:
        return read_all(balanced(_listed(spark, top, wanted, here, folders)), reader)
    dealt = packed(here)
    rows = spark.createDataFrame(dealt, "path string, size long, task int")
    return read_all(rows.repartitionById(dealt[-1][2] + 1 if dealt else 1, F.col("task")), reader)


def staged_blobs(root: str | Path, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False) -> list[tuple[str, str]]:
    """(path, id of its content) of the added, copied, modified and renamed files of the git index. The default ignores don't hold here."""
    run = subprocess.run(["git", "diff", "--cached", "--raw", "--no-abbrev", "--diff-filter=ACMR", "-z"], cwd=root, capture_output=True)
    if run.returncode:
        raise RuntimeError(f"git diff --cached failed: {run.stderr.decode(errors='replace').strip() or 'unknown error'}")
    ins, outs = compiled(include or EVERYTHING, dot), compiled(ignore, True)
    parts, found = iter(run.stdout.decode(errors="surrogateescape").split("\0")), []
    for meta in parts:
        if not meta:
            break
        _, _, _, blob, status = meta.split(" ")
        path = next(parts)
        if status[0] in "CR":  # the old name comes first
            path = next(parts)
        path = path.encode(errors="surrogateescape").decode(errors="replace")
        if is_wanted(path, ins, outs):
            found.append((path, blob))
    return found


def staged_paths(root: str | Path, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False) -> list[str]:
    return [path for path, _ in staged_blobs(root, ignore, include, dot)]


class Blobs:
    """Contents from git by their ids, with one process for all."""

    def __init__(self, root: str):
        self.git = subprocess.Popen(["git", "cat-file", "--batch"], cwd=root, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def __call__(self, blob: str) -> bytes:
        self.git.stdin.write(blob.encode() + b"\n")
        self.git.stdin.flush()
        head = self.git.stdout.readline().decode().split()
        if len(head) != 3:
            raise OSError(" ".join(head) or "git cat-file ended")
        body = self.git.stdout.read(int(head[2]) + 1)[:-1]
        if head[1] != "blob":
            raise OSError(f"{blob} is a {head[1]}")
        return body

    def close(self) -> None:
        self.git.stdin.close()
        self.git.wait()


def staged(spark: SparkSession, root: str | Path, ignore: Iterable[str] = (), include: Iterable[str] | None = None, dot: bool = False) -> DataFrame:
    """Contents of the index, not of the working tree."""
    top, found = str(root), staged_blobs(root, ignore, include, dot)
    rows = spark.createDataFrame(found, "path string, blob string")
    return read_each(rows.repartition(max(1, -(-len(found) // 200))), lambda: Blobs(top), "blob")


def injected(rows: DataFrame, path: str = "path", content: str = "content", read_error: str | None = None) -> DataFrame:
    """Any table as a source; a null content without an error is one that can't be read."""
    error = F.col(read_error).cast("string") if read_error else F.lit(None).cast("string")
    return rows.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"), F.coalesce(error, F.when(F.col(content).isNull(), "no content")).alias("read_error"))
