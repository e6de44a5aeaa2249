"""Small files and renames on any store that Hadoop reaches."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import FourfoldError


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder of the session (spark.checkpoint.dir). Where it is unset, one of our
    own on a single machine; on a cluster that is an error, since a machine's own folder is lost with it."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise FourfoldError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="fourfold-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def read(self, at: str) -> str:
        stream = self._fs.open(self._path(at))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, at: str, text: str) -> bool:
        """Write a new file in one step; False if there is one already."""
        part = f"{at}.{self._jvm.java.util.UUID.randomUUID().toString()}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(at) or not self._fs.rename(self._path(part), self._path(at)):
            self._fs.delete(self._path(part), False)
            return False
        return True

    def names(self, at: str) -> list[str]:
        if not self.exists(at):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(at)))

    def delete(self, at: str) -> None:
        self._fs.delete(self._path(at), True)

    def mkdirs(self, at: str) -> None:
        self._fs.mkdirs(self._path(at))
