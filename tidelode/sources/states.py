"""Small states under a folder, a JSON file for each version, published whole by a rename.

A version's file is written beside its place and then moved there: readers see the old version, the new
one or both, never a part. On file systems without an atomic rename the move is as good as their own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tidelode.schema import DataError


class States:
    """Versions (integers, of any order of writing) of a JSON state under path."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm, self._gateway = path.rstrip("/"), spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @staticmethod
    def _name(version: int) -> str:
        return f"version={version}.json"

    def versions(self) -> list[int]:
        """All versions, ascending."""
        if not self._fs.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("version=") and n.endswith(".json"))

    def get(self, version: int) -> dict:
        place = self._at(self._name(version))
        if not self._fs.exists(place):
            raise FileNotFoundError(f"{self.path}, version {version}")
        data = self._fs.open(place)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()
        return json.loads(text)

    def latest(self, before: int | None = None) -> tuple[int, dict] | None:
        """The greatest version (under before) and its state."""
        found = [v for v in self.versions() if before is None or v < before]
        return (found[-1], self.get(found[-1])) if found else None

    def put(self, version: int, state: dict) -> None:
        """Write a version, in place of one of that number."""
        self._publish(version, state, overwrite=True)

    def append(self, state: dict) -> int:
        """Write the next version; of writers at the same time each gets its own."""
        for _ in range(100):
            version = (self.versions() or [0])[-1] + 1
            if self._publish(version, state, overwrite=False):
                return version
        raise DataError(f"{self.path}: other writers are always faster")

    def _publish(self, version: int, state: dict, overwrite: bool) -> bool:
        text = json.dumps(state, default=list)
        beside, place = self._at(f"_{uuid.uuid4().hex}"), self._at(self._name(version))
        self._fs.mkdirs(self._at(""))
        out = self._fs.create(beside)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else self._fs.getUri(), self._conf)
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = rename.getEnumConstants()[1 if overwrite else 0]
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(place), how)
        except Exception as e:  # py4j wraps what the file system throws
            self._fs.delete(beside, False)
            if not overwrite and "FileAlreadyExists" in str(e):
                return False
            raise
        return True
