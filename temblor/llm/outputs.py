"""Files that tasks write below a shared folder, under temporary names first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def opened(folder: str):
    """File system and path of a folder, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class Output:
    """A file written under a temporary name; ``commit`` gives it its own.

    The name follows from partition and number and the content from the rows,
    so a repeated task puts the same file in place again. Files of attempts
    that died keep their temporary names, which no manifest lists.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = opened(folder)
        self.path, self.temporary = f"{root}/{name}", f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset the data begins at."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def save_manifest(rows: DataFrame, folder: str) -> DataFrame:
    """Run the job behind ``rows`` (one per file), keep its answer, read it back."""
    rows.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def spread(manifest: DataFrame, most: int = 20_000) -> DataFrame:
    """One file per task, or a few where there are very many files."""
    return manifest.repartition(min(most, max(1, manifest.count())), F.xxhash64("file", F.lit(7)))
