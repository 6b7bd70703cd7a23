"""Versioned tables: each generation is a folder with all its tables, and a pointer table names the one that counts."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class LostRace(RuntimeError):
    """Another writer published first."""


class Conflict(RuntimeError):
    """Another writer changed keys that this one changes, too."""


class Snapshots:
    """Generations under one root. A generation is written to a folder of its own name, and the file pointer/N, which names
    that folder, makes it generation N. The file is created only if it is not there yet, so of two writers of one
    generation the second fails; readers see a generation whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The published generation; 0 before the first."""
        path, files = self._file("pointer")
        if not files.exists(path):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def staged(self, tables: dict[str, DataFrame]) -> str:
        """Writes tables of a generation that is not published yet; its folder, for in_folder() and publish()."""
        folder = f"gen-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        return folder

    def in_folder(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{folder}/{name}")

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None, staged: str | None = None) -> int:
        """Writes the tables, beside those staged already, as the generation after `expected`, the one that they were made
        from (None: the current one); if that is not the current one, or another is published meanwhile, nothing is and
        this raises."""
        now = self.current() if expected is None else expected
        if self.current() != now:
            raise LostRace(f"generation {self.current()} was published after {now}")
        folder = staged or f"gen-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        path, files = self._file(f"pointer/{now + 1}")
        try:
            out = files.create(path, False)
        except Py4JJavaError as e:
            raise LostRace(f"generation {now + 1} was published by another writer") from e
        out.write(bytearray(json.dumps({"generation": now + 1, "folder": folder}), "utf-8"))
        out.close()
        return now + 1

    def commit(self, make: Callable[[int], tuple[dict[str, DataFrame], DataFrame]], tries: int = 5) -> int:
        """Publishes what make(generation) gives: the tables after a change of that generation, and (key) of the rows that
        it changes. Each generation keeps these keys.

        A writer that lost a race looks at the keys of the generations that came between. If none is its own, the change
        is made again of the newest one, so that both land; else this raises Conflict and nothing is published.
        """
        base = self.current()
        for _ in range(tries):
            tables, keys = make(base)
            try:
                return self.publish(tables | {"changed_keys": keys.select("key").distinct()}, expected=base)
            except LostRace:
                now = self.current()
                for other in range(base + 1, now + 1):
                    theirs = self.read("changed_keys", other)
                    if not keys.join(theirs, "key", "left_semi").isEmpty():
                        raise Conflict(f"generation {other} changed the same rows") from None
                base = now
        raise LostRace(f"lost {tries} races")

    @contextlib.contextmanager
    def pinned(self, generation: int | None = None) -> Iterator[int]:
        """Within, no prune() deletes the generation (None: the current one)."""
        generation = generation or self.current()
        path, files = self._file(f"pins/{generation}-{uuid.uuid4().hex}")
        files.create(path, False).close()
        try:
            if generation not in self.generations():
                raise RuntimeError(f"generation {generation} is gone")
            yield generation
        finally:
            files.delete(path, False)

    def generations(self) -> list[int]:
        path, files = self._file("pointer")
        return sorted(int(n) for s in files.listStatus(path) if (n := s.getPath().getName()).isdigit()) if files.exists(path) else []

    def prune(self, keep: int = 2, unpublished_seconds: float = 86_400) -> list[int]:
        """Deletes all but the newest `keep` generations and those that are pinned, and folders so old that were written but
        never published; returns the numbers that went."""
        path, files = self._file("pins")
        pins = {int(s.getPath().getName().split("-")[0]) for s in files.listStatus(path)} if files.exists(path) else set()
        found = self.generations()
        gone = [g for g in found[: max(0, len(found) - max(1, keep))] if g not in pins]
        for g in gone:
            folder = self.folder(g)
            files.delete(self._file(f"pointer/{g}")[0], False)  # nobody finds it from here on
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
        named = {self.folder(g).rsplit("/", 1)[1] for g in self.generations()}
        for s in files.listStatus(self._file("")[0]):
            name = s.getPath().getName()
            if name.startswith("gen-") and name not in named and s.getModificationTime() / 1000 < time.time() - unpublished_seconds:
                files.delete(s.getPath(), True)
        return gone

    def folder(self, generation: int | None = None) -> str:
        found = self.spark.read.schema("generation int, folder string").json(f"{self.root}/pointer/{generation or self.current()}").first()
        return f"{self.root}/{found.folder}"

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(generation)}/{name}")


def write_sorted(df: DataFrame, path: str, position: str, files: int) -> None:
    """Files that each hold a range of positions, so that a seek reads few of them."""
    df.repartitionByRange(files, position).sortWithinPartitions(position).write.mode("overwrite").parquet(path)
