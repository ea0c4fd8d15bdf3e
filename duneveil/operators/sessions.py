"""Sessions: the tables that a run writes on its way lie in one folder, and go with it.

While a session is open, every written() table goes to the session's folder.  Ending it deletes the folder with all originals,
at once, unless another holder still reads from it: then the last holder's release deletes it.  A session that nobody ends, as
its driver was lost, is found by its expiry and swept.  What must stay (a twin, its report) is stored elsewhere before.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import tables

EXPIRES_AFTER = 24 * 3600.0


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _files(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


@dataclass(frozen=True)
class Session:
    """One folder of written tables.  _expires holds its end of life, _ended that it is over, _holders who still reads."""

    spark: SparkSession
    name: str

    @property
    def folder(self) -> str:
        return f"{tables.shared_dir(self.spark)}/sessions/{self.name}"

    def hold(self, holder: str) -> None:
        """From now on `holder` reads the session's tables, until it releases them."""
        if self.over():
            raise ValueError("the session has ended")
        write_text(self.spark, f"{self.folder}/_holders/{holder}", "")

    def release(self, holder: str) -> None:
        delete(self.spark, f"{self.folder}/_holders/{holder}")
        if self.over():
            self._drop()

    def over(self) -> bool:
        return read_text(self.spark, f"{self.folder}/_expires") is None or read_text(self.spark, f"{self.folder}/_ended") is not None

    def end(self) -> bool:
        """Delete the originals; False if a holder keeps them for now."""
        if read_text(self.spark, f"{self.folder}/_expires") is None:
            return True
        write_text(self.spark, f"{self.folder}/_ended", "")
        return self._drop()

    def _drop(self) -> bool:
        if names_in(self.spark, f"{self.folder}/_holders"):
            return False
        delete(self.spark, self.folder)
        return True


def begin(spark: SparkSession, seconds: float = EXPIRES_AFTER, now: float | None = None) -> Session:
    out = Session(spark, uuid.uuid4().hex)
    write_text(spark, f"{out.folder}/_expires", repr((time.time() if now is None else now) + seconds))
    return out


@contextmanager
def using(session: Session) -> Iterator[Session]:
    """Tables written inside go to the session's folder."""
    before = tables.writes_to.set(f"{session.folder}/tables")
    try:
        yield session
    finally:
        tables.writes_to.reset(before)


def sweep(spark: SparkSession, now: float | None = None) -> list[str]:
    """End the sessions whose time is over, whoever holds them, and return their names."""
    at, gone = (time.time() if now is None else now), []
    for name in names_in(spark, f"{tables.shared_dir(spark)}/sessions"):
        session = Session(spark, name)
        until = read_text(spark, f"{session.folder}/_expires")
        if until is None or float(until) <= at:
            delete(spark, session.folder)
            gone.append(name)
    return gone
