"""Listing, dealing and reading trees: tasks list what the driver leaves, tasks are balanced, one git process reads many blobs."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from credsift.sources import files
from credsift.sources.folder import FolderReader, FolderSource


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for k in range(300):
        path = top / f"a{k % 70}" / f"b{k % 3}" / f"f{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (k * 10))
    for name in ("node_modules/x.js", "a1/x.log", "y.log", "a1/node_modules/z.js", ".hidden", "top.txt", "_odd/é ä.txt"):
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    (top / "bad.bin").write_bytes(b"\xff\xfea")
    os.symlink(top / "a1", top / "link")
    return top


@pytest.mark.parametrize("most", [0, 5, 10_000])
def test_tasks_list_what_the_driver_leaves(spark, tree, most):
    rows = files.listed(spark, tree, most=most).collect()
    assert sorted(r.path for r in rows) == sorted(files.discover(tree)) and len(rows) == 305
    assert {r.path: r.size for r in rows}["a9/b0/f9.txt"] == 90
    some = files.listed(spark, tree, ["a1/**", "**/f2*"], ["a1/**", "a2/**", "*.txt"], most=most)
    assert sorted(r.path for r in some.collect()) == sorted(files.discover(tree, ["a1/**", "**/f2*"], ["a1/**", "a2/**", "*.txt"]))


def test_the_driver_stops_at_many_files_or_folders(tree):
    found, left = files.near(str(tree), files.Wanted(), 3)
    assert len(found) <= 3 and left
    found, left = files.near(str(tree), files.Wanted())
    assert len(left) == 71 and {p for p, _ in found} == {"top.txt", "bad.bin"}
    assert files.near(str(tree / "a1"), files.Wanted())[1] == []


def test_tasks_get_like_bytes_and_large_files_their_own(spark):
    rows = spark.range(4000).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") % 1000 == 7, F.lit(50 << 20)).when(F.col("id") < 500, F.lit(1 << 20)).otherwise(F.lit(100)).alias("size"))
    dealt = files.balanced(rows).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
    assert sum(r.n for r in dealt) == 4000
    alone = [r for r in dealt if r.largest >= 50 << 20]
    assert [r.n for r in alone] == [1] * 4
    assert all(r.bytes <= files.TASK_BYTES + (1 << 20) for r in dealt if r.largest < 50 << 20)
    assert files.balanced(rows.limit(0)).count() == 0


def test_short_lists_are_dealt_alike():
    here = [(f"f{k}", 50 << 20 if k % 1000 == 7 else 1 << 20 if k < 500 else 100) for k in range(4000)]
    tasks = {}
    for path, size, task in files.packed(here):
        tasks.setdefault(task, []).append(size)
    assert sum(map(len, tasks.values())) == 4000 and sorted(tasks) == list(range(len(tasks)))
    assert [len(t) for t in tasks.values() if max(t) >= 50 << 20] == [1] * 4
    assert all(sum(t) <= files.TASK_BYTES for t in tasks.values() if max(t) < 50 << 20)
    assert files.packed([]) == []


def test_the_data_source_gives_the_same_rows(spark, tree):
    spark.dataSource.register(FolderSource)
    for more in ({}, {"ignore": "a1/**,**/f2*", "include": "a*/**,*.bin"}, {"partitions": "3", "dot": "true"}):
        got = spark.read.format("credsift").options(**more).load(str(tree))
        globs = lambda k, more=more: more[k].split(",") if k in more else None
        want = files.disk(spark, tree, globs("ignore") or (), globs("include"), "dot" in more)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    parts = FolderReader({"path": str(tree), "partitions": "8"}).partitions()
    assert len(parts) == 8 and sum(len(p.folders) for p in parts) == 71


def test_a_file_that_goes_is_a_row_with_its_error(spark, tree):
    (tree / "gone.txt").write_text("x")
    rows = files.listed(spark, tree)
    paths = rows.collect()
    (tree / "gone.txt").unlink()
    top = str(tree)
    got = files.read_all(spark.createDataFrame(paths, rows.schema), lambda p: open(f"{top}/{p}", "rb").read())
    assert [r.path for r in got.where("read_error is not null").collect()] == ["gone.txt"]
    assert got.where("path = 'bad.bin'").first().content == "��a"


def test_one_git_process_reads_the_index(spark, tmp_path):
    git = lambda *words: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *words], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    names = {"plain.txt": b"one", "with space\tand\nline.txt": b"two", "é.txt": b"", "large.bin": os.urandom(300_000), "old.txt": b"the same content as before " * 20}
    for name, body in names.items():
        (tmp_path / name).write_bytes(body)
    git("add", "old.txt")
    git("commit", "-q", "-m", "x")
    git("mv", "old.txt", "new.txt")
    git("add", "-A")
    (tmp_path / "plain.txt").write_bytes(b"changed afterwards")
    due = {**names, "new.txt": names["old.txt"]}
    del due["old.txt"]
    assert sorted(files.staged_paths(tmp_path)) == sorted(due)
    got = {r.path: r for r in files.staged(spark, tmp_path).collect()}
    assert got["plain.txt"].content == "one" and got["with space\tand\nline.txt"].content == "two" and got["é.txt"].content == "" and got["new.txt"].content == due["new.txt"].decode()
    reader = files.Blobs(str(tmp_path))
    blobs = dict(files.staged_blobs(tmp_path))
    assert [reader(blobs[n]) for n in due] == list(due.values())
    with pytest.raises(OSError, match="missing"):
        reader("0" * 40)
    assert reader(blobs["plain.txt"]) == b"one"
    reader.close()
