"""Folders and small files on whatever file system Spark can reach, through Hadoop's own interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that isn't there yet; False if another was first."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def move_into(self, source: str, target: str) -> None:
        """Move the files of a folder into another, which is made if it's missing."""
        fs, to = self._at(target)
        fs.mkdirs(to)
        for s in fs.listStatus(self._at(source)[1]):
            if not fs.rename(s.getPath(), self._jvm.org.apache.hadoop.fs.Path(to, s.getPath().getName())):
                raise OSError(f"{s.getPath()} couldn't be moved to {target}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
