"""One grid filled by several drivers: claims, leases and a manifest.

The ledger of a grid lives beside its results, on storage all drivers share, as small
files that are only ever created, never changed:

* ``claims/<cell>/<attempt>``: who works on a cell, and until when. The first attempt of a
  cell is 1; when a claim's lease is over, anyone may create the next attempt. A file is
  put only where none is, so of several drivers one gets each attempt.
* ``manifest/<cell>``: the attempt whose results count, put when they are all written. Of
  two attempts at a cell the first to commit counts; the other's files are never read.

An attempt writes to folders of its own name, so a driver that was believed dead cannot
overwrite anything. Readers go by the manifest: they see whole cells, and each once. A
driver that dies loses the cells it has claimed and not committed, until the lease is over.
Leases are compared with the reader's clock; they should be long beside clock differences.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


class Ledger:
    """The ledger under ``path``; ``lease`` is how long a claim holds, in seconds."""

    def __init__(self, spark: SparkSession, path: str, lease: float, owner: str | None = None):
        self.jvm, self.path, self.lease = spark._jvm, path.rstrip("/"), lease
        self.owner = owner or uuid.uuid4().hex[:12]
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _put(self, text: str, *parts: str) -> bool:
        """Create a file with ``text`` unless it is there; whether this call created it.

        The text is written aside first and linked under its name in one step on a local
        disk; elsewhere the file system's create-without-overwrite decides, and a file that
        is still empty counts as put, by an unknown owner.
        """
        from py4j.protocol import Py4JJavaError

        target = self._at(*parts)
        self.fs.mkdirs(target.getParent())
        if self.fs.getUri().getScheme() == "file":
            name = target.toUri().getPath()
            with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(name), prefix="put") as aside:
                aside.write(text)
                aside.flush()
                try:
                    os.link(aside.name, name)
                except FileExistsError:
                    return False
            return True
        try:
            stream = self.fs.create(target, False)
        except Py4JJavaError as e:
            if "Exist" not in str(e.java_exception):
                raise
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _read(self, *parts: str) -> str:
        stream = self.fs.open(self._at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _names(self, *parts: str) -> list[str]:
        where = self._at(*parts)
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return [n for n in names if not n.startswith((".", "put"))]

    def committed(self) -> dict[str, int]:
        """Cells whose results count, with their attempt."""
        return {cell: int(text) for cell in self._names("manifest") if (text := self._read("manifest", cell))}

    def claim(self, cell: str) -> int | None:
        """The attempt at ``cell`` that is this driver's, or None while another's holds."""
        attempts = [int(n) for n in self._names("claims", cell)]
        last = max(attempts, default=0)
        if last:
            said = self._read("claims", cell, str(last))
            until = float(said.split()[1]) if said else time.time()
            if time.time() < until:
                return None
        text = f"{self.owner} {time.time() + self.lease!r}"
        return last + 1 if self._put(text, "claims", cell, str(last + 1)) else None

    def commit(self, cell: str, attempt: int) -> bool:
        """Make the results of an attempt those of its cell; False if another's are."""
        return self._put(str(attempt), "manifest", cell)
