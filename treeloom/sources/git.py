"""Files of a git commit, read from the object store without a checkout."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.columns import decode_text

FILES_PER_TASK = 500


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def commit_files(spark: SparkSession, repo: str, commit: str, glob: str = "*.java") -> DataFrame:
    """(path, text) of a commit's files. repo is a folder that all executors see; the driver only lists names."""
    names = []
    for line in _git(repo, "ls-tree", "-r", "-z", commit).decode("utf-8", "surrogateescape").split("\0"):
        head, _, path = line.partition("\t")
        if path and " blob " in head and fnmatch(path.rsplit("/", 1)[-1], glob):
            names.append((path, head.split(" ")[2]))
    listed = spark.createDataFrame(names, "path string, blob string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for batch in batches:
                contents = []
                for blob in batch["blob"]:
                    p.stdin.write(f"{blob}\n".encode())
                    p.stdin.flush()
                    size = int(p.stdout.readline().split()[2])
                    contents.append(p.stdout.read(size))
                    p.stdout.read(1)
                yield pd.DataFrame({"path": batch["path"], "content": contents})

    spread = listed.repartition(max(1, -(-len(names) // FILES_PER_TASK)))
    return spread.mapInPandas(read, "path string, content binary").select("path", decode_text(F.col("content")).alias("text"))
