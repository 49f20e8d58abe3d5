"""Small files of a database, through Hadoop's file systems or, for local paths, the operating system."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        local = self.root.removeprefix("file://") if self.root.startswith("file:") else self.root
        scheme = "" if "://" not in self.root else self.root.split("://", 1)[0]
        self.local = local if scheme in ("", "file") else None
        if self.local is None:
            jvm = spark._jvm
            self.path = jvm.org.apache.hadoop.fs.Path
            self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def uri(self, name: str) -> str:
        return f"file://{os.path.abspath(self.local)}/{name}" if self.local is not None else f"{self.root}/{name}"

    def _of(self, name: str):
        return os.path.join(self.local, name) if self.local is not None else self.path(f"{self.root}/{name}")

    def make(self, name: str) -> None:
        if self.local is not None:
            os.makedirs(self._of(name), exist_ok=True)
        else:
            self.fs.mkdirs(self._of(name))

    def exists(self, name: str) -> bool:
        return os.path.exists(self._of(name)) if self.local is not None else self.fs.exists(self._of(name))

    def names(self, name: str) -> list[str]:
        if self.local is not None:
            return sorted(os.listdir(self._of(name)))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._of(name)))

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(self._of(name), encoding="utf-8") as f:
                return f.read()
        stream = self.fs.open(self._of(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if it exists already. Its existence with all its content is the commit point."""
        if self.local is not None:
            temporary = f"{self._of(name)}.{os.getpid()}.tmp"
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, self._of(name))  # fails where the name exists
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
        temporary, target = self.path(f"{self.root}/{name}.{os.getpid()}.tmp"), self._of(name)
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(temporary, target):
            self.fs.delete(temporary, False)
            return False
        return True

    def remove(self, name: str) -> None:
        if self.local is not None:
            import shutil

            shutil.rmtree(self._of(name), ignore_errors=True)
        else:
            self.fs.delete(self._of(name), True)
