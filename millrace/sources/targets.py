"""What a check is about: a project, a solution or loose files; and the accepted sources that it is compared with."""

from __future__ import annotations

import glob as globs
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import fingerprint, glob_regex
from millrace.sources.snapshots import loose_files

SOLUTIONS, PROJECTS = (".sln", ".slnx"), (".csproj",)


def resolve(path: str) -> str:
    """A solution or project file: the path itself, or the one solution, else the one project, of a folder."""
    if os.path.isfile(path):
        if not path.endswith((*SOLUTIONS, *PROJECTS)):
            raise ValueError(f"{path} is neither a solution nor a project")
        return path
    if not os.path.isdir(path):
        raise ValueError(f"{path} is not there")
    for ends in (SOLUTIONS, PROJECTS):
        found = sorted(f for f in os.listdir(path) if f.endswith(ends))
        if len(found) == 1:
            return os.path.join(path, found[0])
        if found:
            raise ValueError(f"{path} has several: {', '.join(found)}")
    raise ValueError(f"{path} has no solution and no project")


def expand(root: str, pattern: str) -> list[str]:
    """Files below a folder that match a glob, each once, in the order of UTF-16 units; links are not followed; none is an error."""
    test, out = re.compile(glob_regex(pattern).replace("\\z", "\\Z")), set()
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not os.path.islink(os.path.join(folder, f))]
        for name in names:
            full = os.path.join(folder, name)
            if not os.path.islink(full) and test.match(os.path.relpath(full, root).replace(os.sep, "/")):
                out.add(full)
    if not out:
        raise ValueError(f"no file matches {pattern}")
    return sorted(out, key=lambda p: p.encode("utf-16-be", "surrogatepass"))


def accepted_folder(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text, fingerprint) of the accepted files below a folder."""
    return loose_files(spark, root, pattern).select("path", "text", "fingerprint")


def accepted_revision(spark: SparkSession, repository: str, revision: str, pattern: str) -> DataFrame:
    """(path, text, fingerprint) of the files of a revision; read on the driver, one file after the other."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], check=True, capture_output=True).stdout
    test = re.compile(glob_regex(pattern).replace("\\z", "\\Z"))
    names = [n for n in git("ls-tree", "-r", "-z", "--name-only", revision, "--").decode().split("\0") if n and test.match(n)]
    rows = [(n, git("show", f"{revision}:{n}").decode("utf-8-sig")) for n in names]
    return spark.createDataFrame(rows, "path string, text string").withColumn("fingerprint", fingerprint(F.col("text")))


def several(patterns: list[str]) -> list[str]:
    """Files of several shell globs, each once, sorted."""
    return sorted({f for p in patterns for f in globs.glob(p, recursive=True)})
