"""Tables whose state is published whole: a load writes the next state to a folder of its own, then moves one pointer file.

root/_current names the folder of the state and the number of the batch that made it. It is written beside and renamed over the old one, in one step where the
file system can (local disks, HDFS), so a reader sees the old state or the new one and never a part. A load whose batch is not beyond the pointer's does nothing: a batch that runs
again, after a success or after it was killed between its data and the pointer, leaves one right table. One load at a time writes a table. The pointer also names the states
before, `keep` in all, so that a reader that began on one can end; other folders of states, such as a killed load has left, go with the next load.

Defined results: a table without a pointer doesn't exist (reading raises; the first load gets None for its base); a batch's number is 0 or more; a load whose step
raises leaves the pointer as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"
_FOLDER = "state-{batch:020d}-{mark}"


class Published:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._fs = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path("").getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._path("").makeQualified(self._files.getUri(), self._files.getWorkingDirectory()).toUri(), conf)

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    def pointer(self) -> dict | None:
        """batch and folder of the current state, and the folders that are kept."""
        at = self._path(_POINTER)
        if not self._files.exists(at):
            return None
        lines = self._files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8"))
        finally:
            lines.close()

    def _point(self, batch: int, folder: str) -> None:
        kept = [folder, *(self.pointer() or {"kept": []})["kept"]][: max(1, self.keep)]
        beside = self._path(f"{_POINTER}-{uuid.uuid4().hex}")
        out = self._files.create(beside, False)
        out.write(json.dumps({"batch": batch, "folder": folder, "kept": kept}).encode())
        out.close()
        over = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        over[0] = self._fs.Options.Rename.OVERWRITE
        self._context.rename(beside, self._path(_POINTER), over)

    def read(self) -> DataFrame:
        now = self.pointer()
        if now is None:
            raise ValueError(f"no table at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{now['folder']}")

    def batch(self) -> int:
        """The number of the last batch that was published; -1 if there is none."""
        now = self.pointer()
        return -1 if now is None else now["batch"]

    def load(self, batch: int, step: Callable[[DataFrame | None], DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> bool:
        """Publish what step makes of the current state (None: there is none) as that of the batch; whether it wasn't published before. write puts a state into a folder."""
        if batch < 0:
            raise ValueError("a batch has a number of 0 or more")
        if batch <= self.batch():
            return False
        folder = _FOLDER.format(batch=batch, mark=uuid.uuid4().hex[:12])
        (write or (lambda df, path: df.write.parquet(path)))(step(None if self.batch() < 0 else self.read()), f"{self.root}/{folder}")
        self._point(batch, folder)
        self._tidy()
        return True

    def _tidy(self) -> None:
        kept = self.pointer()["kept"]
        for x in self._files.listStatus(self._path("")):
            name = x.getPath().getName()
            if x.isDirectory() and name.startswith("state-") and name not in kept:
                self._files.delete(x.getPath(), True)
