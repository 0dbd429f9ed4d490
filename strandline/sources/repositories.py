"""[SRC-1, SRC-2, SRC-3, FLT-1] Many repositories below one folder as a Spark data source: a row for each file, read where the tasks run.

``root/<repo_id>/...`` are the files of a repository. A folder is dealt out as ``splits`` partitions by a hash of the path, so a repository
with a third of all files is many tasks. A task lists its folder, leaves out by name what the pushed filters on ``repo_id`` and ``suffix``
exclude, and only then opens what is left: a file that is filtered out is never opened. What cannot be read is a row with ``error``
and no content, so one broken repository fails no other.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from strandline.functions import text as T
from strandline.functions.retry import with_retry

FILES = "repo_id string, path string, suffix string, length long, content binary, error string"
#: The suffix of a row that says why a repository could not be listed; a file's begins with a dot or is empty.
UNLISTED = "!"
SPLITS = 4
#: Attempts at a read, and the least and the greatest wait before another, in seconds.
ATTEMPTS, WAIT = 3, (0.1, 2.0)


@dataclass
class Part(InputPartition):
    repo_id: str
    split: int


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    found, base = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
    return found, base.rstrip("/")


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.splits = options["path"], int(options.get("splits", SPLITS))
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities and lists on ``repo_id`` and ``suffix``; gives back all others, which Spark applies itself."""
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In, IsNotNull)) else ""
            if column not in ("repo_id", "suffix"):
                yield f
            elif not isinstance(f, IsNotNull):  # both columns always have a value
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.only[column] = self.only.get(column, wanted) & wanted

    def partitions(self) -> list[Part]:
        repos = self.only.get("repo_id")
        if repos is None:
            files, base = _open(self.root)
            found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
            repos = {x.base_name for x in found if x.type == fs.FileType.Directory}
        return [Part(r, s) for r in sorted(repos) for s in range(self.splits)] or [Part("", 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.repo_id:
            return
        files, base = _open(self.root)
        missing = ""
        top, suffixes = posixpath.join(base, part.repo_id), self.only.get("suffix")
        try:
            listed = with_retry(lambda: files.get_file_info(fs.FileSelector(top, recursive=True)), ATTEMPTS, WAIT)
        except FileNotFoundError:
            listed, missing = [], "No such repository"
        except OSError as e:
            listed, missing = [], str(e)
        if missing:
            if part.split == 0 and (suffixes is None or UNLISTED in suffixes):
                yield part.repo_id, None, UNLISTED, None, None, missing
        for info in listed:
            path = info.path[len(top) + 1 :]
            suffix = PurePosixPath(path).suffix
            if info.type != fs.FileType.File or (suffixes is not None and suffix not in suffixes) or zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.splits != part.split:
                continue
            content = error = None
            try:
                content = with_retry(lambda path=info.path: self._content(files, path), ATTEMPTS, WAIT)
            except OSError as e:
                error = str(e)
            yield part.repo_id, path, suffix, info.size, content, error

    @staticmethod
    def _content(files: fs.FileSystem, path: str) -> bytes:
        with files.open_input_stream(path) as stream:
            return stream.read()


class Repositories(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(dict(self.options))


def read_repositories(spark: SparkSession, root: str, splits: int = SPLITS) -> DataFrame:
    """[SRC-1] (repo_id, path, suffix, length, content, error) of the files of all repositories below ``root``."""
    spark.dataSource.register(Repositories)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when the plan is made; no other source is met by it
    return spark.read.format("repositories").option("splits", splits).load(root)


def source_files(spark: SparkSession, root: str, repos: list[str] | None = None, splits: int = SPLITS) -> DataFrame:
    """[SRC-1, SRC-2, FLT-1] (repo_id, path, language, content, file_hash, error) of the source files below ``root``, of ``repos`` alone
    where given. Files that are no UTF-8 are left out, as are those of no known language, which are not opened; a repository that
    cannot be listed, and a file that cannot be read, is a row with ``error``."""
    files = read_repositories(spark, root, splits)
    if repos is not None:
        files = files.where(F.col("repo_id").isin(repos))
    known = files.where(F.col("suffix").isin(*T.LANGUAGES, UNLISTED))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    found = known.select("repo_id", "path", T.language(F.col("path")).alias("language"), text.alias("content"), "error")
    return found.where("content is not null or error is not null").withColumn("file_hash", T.file_hash(F.col("content")))


def write_files(files: DataFrame, root: str) -> int:
    """Writes (source, path, content) as the files ``root/source/path``, where the tasks run; how many. A task that is run again writes the
    same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        made: set[str] = set()
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                path = posixpath.join(base, row["source"], row["path"])
                if (folder := posixpath.dirname(path)) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(path) as out:
                    out.write(row["content"])
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return files.select("source", "path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
