"""A git working tree as a source of changes: the driver asks git, the answers are small."""

import subprocess

from pyspark.sql import DataFrame, SparkSession

from textquarry.operators.changes import parse_patch


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def changes(spark: SparkSession, root: str, since: str = "HEAD") -> tuple[DataFrame, DataFrame]:
    """(files, ranges): old and new path of each changed file, untracked ones included, and the new lines that changed."""
    files, ranges = [], []
    for f in parse_patch(_git(root, "diff", "-U0", "-M", since)):
        files.append((f["old"], f["new"]))
        ranges += [(f["new"], a, b) for a, b in f["added"] if f["new"]]
    for path in _git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0"):
        if path:
            files.append((None, path))
            with open(f"{root}/{path}", "rb") as f:
                ranges.append((path, 1, max(1, f.read().count(b"\n"))))
    return spark.createDataFrame(files, "old string, new string"), spark.createDataFrame(ranges, "path string, first int, last int")


def snapshot(spark: SparkSession, root: str, revision: str, paths: list[str]) -> DataFrame:
    """The named files of a revision as (file_id, path, text): one process answers for all of them, absent ones are left out."""
    asked = "".join(f"{revision}:{p}\n" for p in paths).encode()
    got = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
    rows, at = [], 0
    for k, path in enumerate(paths):
        end = got.index(b"\n", at)
        head = got[at:end].rsplit(b" ", 2)
        at = end + 1
        if len(head) == 3 and head[1] == b"blob":
            size = int(head[2])
            rows.append((k, path, got[at : at + size].decode("utf-8", "replace")))
            at += size + 1
    return spark.createDataFrame(rows, "file_id long, path string, text string")
