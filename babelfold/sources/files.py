"""Pages as files: a data source that writes many files a task and commits them,
and ids for the files of a folder.

Writing.  A task writes its rows as files into a folder of its own attempt under
``_temporary``.  When all tasks are done, the commit moves the folders of the
attempts that counted into place, one rename a task: a task that ran twice, or a
job that failed, puts nothing in place (tasks that are cut off may leave files in
the hidden folder).  Files end up as ``<path>/part-00000-<job>/<name>``; a name
must be unique in the table (:func:`unique_names`).

Reading.  A file's id is the 64-bit hash of its path.  Should paths share a hash,
all but the first of them get another, so no two files share an id.  Spark's file
sources skip empty files: they have no row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from babelfold.operators.hotkeys import join_unique, key_counts
from babelfold.operators.translate import ship_package
from babelfold.session import cut_lineage

FORMAT = "named_files"


def _file_system(path: str):
    """File system and path within it, of a plain path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    folder: str
    files: int


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows ``(name string, content binary)`` as files."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.job, self.overwrite = path.rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _file_system(self.path)
        part = TaskContext.get().partitionId()
        folder, n = f"{root}/_temporary/{self.job}/{part}-{uuid.uuid4().hex}", 0
        fs.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                if not name.is_valid or "/" in name.as_py() or name.as_py() in ("", ".", ".."):
                    raise ValueError(f"not a file name: {name}")
                with fs.open_output_stream(f"{folder}/{name.as_py()}") as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                n += 1
        return Written(part, folder, n)

    def commit(self, messages):
        from pyarrow.fs import FileType

        fs, root = _file_system(self.path)
        if self.overwrite:
            from pyarrow.fs import FileSelector
            for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
                if f.type == FileType.Directory and f.base_name.startswith("part-"):
                    fs.delete_dir(f.path)
        for m in messages:
            if m is not None and m.files:
                fs.move(m.folder, f"{root}/part-{m.part:05d}-{self.job[:8]}")
        self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        self._clear(*_file_system(self.path))

    def _clear(self, fs, root):
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/_temporary/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.job}")


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("overwrite").save(path)``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return NamedFilesWriter(self.options["path"], overwrite)


def unique_names(files: DataFrame, name: str = "name", key: str = "page_id") -> DataFrame:
    """``files`` with names that no two rows share: where a name occurs more than once,
    each of its rows gets its key before the extension (keys are unique)."""
    counts = key_counts(files, name)
    marked = join_unique(files, counts.filter("n > 1").select(name, F.lit(True).alias("__shared")), name, counts=counts)
    stem, ext = F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?\z", 1), F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?\z", 2)
    own = F.concat(stem, F.lit("_"), F.col(key).cast("string"), ext)
    return marked.withColumn(name, F.when(F.col("__shared"), own).otherwise(F.col(name))).drop("__shared")


def write_files(files: DataFrame, path: str) -> None:
    """Rows ``(name, content)`` as files under ``path``, in place of those of an earlier call."""
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")) \
        .write.format(FORMAT).mode("overwrite").save(path)


def path_ids(paths: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """``(path, page_id)`` for ``paths(path)``: the hash of the path, or of path and a
    counter where the hash is taken.  The paths of a taken hash are the only rows that
    are kept aside (with 64 bits, none in all likelihood)."""
    ids = paths.select("path", hashed(F.col("path")).alias("page_id"))
    turn = 0
    while True:
        again = ids.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).filter("n > 1")
        if again.isEmpty():
            return ids
        turn += 1
        # of each taken id the first path keeps it, the others hash again with a counter
        moved = ids.join(again, "page_id").filter("path <> first").select("path", F.lit(True).alias("moved"))
        retry = hashed(F.concat("path", F.lit(f"\x00{turn}")))
        ids = cut_lineage(ids.join(moved, "path", "left").select("path", F.when(F.col("moved"), retry).otherwise(F.col("page_id")).alias("page_id")))


def read_html_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """Folder of HTML files -> ``(path, page_id, html, error_class, n_bytes)``.

    Files are read whole as bytes; bytes that are not valid UTF-8 give a row
    with ``error_class='file'`` and NULL html instead of failing the job.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path_glob)
    txt = F.try_validate_utf8(F.col("content").cast("string"))
    # the ids need the paths alone (the contents aren't read for it) and, with no hash taken twice, no join
    taken = df.select("path").groupBy(F.xxhash64("path")).count().filter("count > 1")
    if taken.isEmpty():
        df = df.withColumn("page_id", F.xxhash64("path"))
    else:
        df = df.join(path_ids(df.select("path")), "path")
    return df.select("path", "page_id", txt.alias("html"), F.when(txt.isNull(), F.lit("file")).alias("error_class"),
                     F.col("length").alias("n_bytes"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)
