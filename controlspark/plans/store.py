"""Append-only tables in a folder that all machines share, with numbered commits.

A commit's rows are written first, to a folder of their own that nobody reads;
then ``commits/<number>`` appears at once and whole: it is written aside and
linked (local file system) or renamed (HDFS) to its name, which fails if another
writer has that number. It names the folders of every table, so a read opens one
commit. A lost executor, a failed job or a crash between leaves nothing but
unread files. Rows that change are appended as new versions; ``current`` reads
the last version of each key. A table of many folders is written as one again.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table from which the next commit writes them as one.
MANY = 24


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path(f"{self.root}/commits")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def head(self) -> int:
        """The number of the last commit; 0 if there is none."""
        names = (f.getPath().getName() for f in self.fs.listStatus(self._path(f"{self.root}/commits")))
        return max((int(x) for x in names if x.isdigit()), default=0)

    def folders(self, head: int) -> dict[str, list[str]]:
        if not head:
            return {}
        stream = self.fs.open(self._path(f"{self.root}/commits/{head:010d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, schema: str, head: int | None = None) -> DataFrame:
        """The rows of a table as of a commit; of the last one unless another is named."""
        own = self.folders(self.head() if head is None else head).get(name, [])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{x}" for x in own]) if own else self.spark.createDataFrame([], schema)

    def current(self, name: str, schema: str, keys: list[str], head: int | None = None) -> DataFrame:
        """Of each key the version that was appended last (column seq)."""
        rows = self.read(name, schema, head)
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")

    def commit(self, head: int, tables: dict[str, DataFrame]) -> bool:
        """Adds the rows right after commit ``head``; False, with nothing added, if another writer came first."""
        name, now = uuid.uuid4().hex, self.folders(head)
        for table, rows in tables.items():
            old = now.get(table, [])
            if len(old) >= MANY:
                rows = self.spark.read.schema(rows.schema).parquet(*[f"{self.root}/data/{x}" for x in old]).unionByName(rows).coalesce(8)
                old = []
            rows.write.parquet(f"{self.root}/data/{name}/{table}")
            now[table] = [*old, f"{name}/{table}"]
        aside, target = f"{self.root}/commits/.{name}", f"{self.root}/commits/{head + 1:010d}"
        out = self.fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if self._publish(aside, target):
            return True
        self.fs.delete(self._path(f"{self.root}/data/{name}"), True)
        return False

    def _publish(self, aside: str, target: str) -> bool:
        if self.fs.getUri().getScheme() != "file":
            return bool(self.fs.rename(self._path(aside), self._path(target)))
        local = lambda x: self._path(x).toUri().getPath()
        try:
            os.link(local(aside), local(target))  # fails where the name is taken
        except FileExistsError:
            return False
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(local(aside))
                os.unlink(os.path.join(os.path.dirname(local(aside)), f".{os.path.basename(local(aside))}.crc"))
        return True

    def change(self, make: Callable[[int], dict[str, DataFrame] | None]) -> int:
        """Commits what ``make`` says for the last commit, again for a later one if another writer comes first; the commit's number. None changes nothing."""
        while True:
            head = self.head()
            tables = make(head)
            if not tables:
                return head
            if self.commit(head, tables):
                return head + 1
