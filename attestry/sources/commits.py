"""Versions of a folder: one JSON file each, made in one step that fails where another writer was first."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def latest(self) -> int:
        """The latest version, 0 before the first."""
        if not self.fs.exists(self.path(self.folder)):
            return 0
        names = [re.fullmatch(r"v(\d+)\.json", s.getPath().getName()) for s in self.fs.listStatus(self.path(self.folder))]
        return max([int(n[1]) for n in names if n], default=0)

    def read(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/v{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> bool:
        """Whether ``version`` is now this one; False if another writer made it."""
        self.fs.mkdirs(self.path(self.folder))
        temporary, final = self.path(f"{self.folder}/_tmp-{uuid.uuid4().hex}"), self.path(f"{self.folder}/v{version}.json")
        stream = self.fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() != "file":
                return self.fs.rename(temporary, final)  # doesn't overwrite
            os.link(temporary.toUri().getPath(), final.toUri().getPath())  # a local rename would
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(temporary, False)
