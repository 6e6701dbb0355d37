"""Artifacts as files, published all together or not at all, by a Spark writer.

``df.write.format("artifacts").mode("append").save(folder)`` writes each row (``name``, ``value``) as one file. Executors
write to a hidden folder beside the final files; the driver moves these when every task has succeeded, keeps what stood in
their way until all are in place, and puts it back if a move fails. A failed job leaves nothing behind. The folder must
be one that all executors and the driver share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # staged file, name


class ArtifactWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = Path(folder.removeprefix("file://"))
        self.staging = self.folder / f".staged-{uuid.uuid4().hex}"
        self.staging.mkdir(parents=True)  # tasks that outlive an abort find it gone and fail

    def write(self, rows: Iterator[Row]) -> Written:
        task = TaskContext.get()
        own = self.staging / f"{task.partitionId()}-{task.taskAttemptId()}"
        files = []
        for n, row in enumerate(rows):
            if n == 0:
                own.mkdir()
            if not row.name or Path(row.name).name != row.name:
                raise ValueError(f"{row.name!r} is no file name")
            (own / str(n)).write_text(row.value or "", encoding="utf-8")
            files.append((str(own / str(n)), row.name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [f for m in messages if m for f in m.files]
        kept: list[tuple[Path, Path]] = []
        moved: list[Path] = []
        try:
            if len({name for _, name in moves}) < len(moves):
                raise ValueError("two artifacts have one name")
            for n, (staged, name) in enumerate(moves):
                final = self.folder / name
                if final.exists():
                    aside = self.staging / f"kept-{n}"
                    os.replace(final, aside)
                    kept.append((aside, final))
                os.replace(staged, final)
                moved.append(final)
        except BaseException:
            for final in moved:
                final.unlink()
            for aside, final in kept:
                os.replace(aside, final)
            raise
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])


def publish(df: DataFrame, folder: str) -> None:
    """Publish ``name, value`` of each row as a file in ``folder``."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(Artifacts)
    df.select("name", "value").write.format("artifacts").mode("append").save(folder)
