"""Row tokens: sealed references to original rows that a recipient can neither read, alter nor forge.

A token is "NZ-" and base32 of: key version (1 byte), share fingerprint (3), tag (16), sealed bytes.  Sealing is
deterministic: the tag is HMAC-SHA256 of the reference and of what it is bound to, and keys the stream that covers
the reference.  The key stays in the closure of an Arrow function and is in no plan.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import ROW, written

PREFIX = "NZ-"
TOKEN_COLUMN = "record_token"
REFERENCE = "__ref"
STATUSES = ("verified", "duplicate", "missing", "invalid", "foreign", "old_key")
TAG, FINGERPRINT, MAX_DIGITS, MAX_TABLES = 16, 3, 38, 128
TOKEN_SHAPE = rf"^\s*{PREFIX}[A-Z2-7]{{16,400}}\s*$"


class TokenError(ValueError):
    """The token isn't one of this share."""


# ---------------------------------------------------------------- references


def pack(table: int, key: str) -> bytes:
    """A table's number and a row's key; short numbers without a leading zero are packed as numbers."""
    if not 0 <= table < MAX_TABLES:
        raise ValueError("too many tables")
    if key.isascii() and key.isdigit() and len(key) <= MAX_DIGITS and (key == "0" or key[0] != "0"):
        n = int(key)
        return bytes((table | 128,)) + n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
    return bytes((table,)) + key.encode()


def unpack(packed: bytes) -> tuple[int, str]:
    return packed[0] & 127, str(int.from_bytes(packed[1:], "big")) if packed[0] & 128 else packed[1:].decode()


# ---------------------------------------------------------------- sealing


@dataclass(frozen=True)
class Sealer:
    """Seals for one share of one dataset; master is None where the key version is gone."""

    share: str
    dataset: str
    version: int
    master: bytes | None

    def _key(self, use: str) -> bytes:
        if self.master is None:
            raise TokenError("the key is gone")
        return hmac.new(self.master, f"{use}|{self.dataset}".encode(), hashlib.sha256).digest()

    @cached_property
    def _keys(self) -> tuple[bytes, bytes]:
        """Of tags and of streams; the same for all rows."""
        return self._key("tag"), self._key("stream")

    @cached_property
    def header(self) -> bytes:
        return bytes((self.version,)) + hashlib.sha256(f"share|{self.share}".encode()).digest()[:FINGERPRINT]

    def _tag(self, packed: bytes) -> bytes:
        bound = f"{self.share}|{self.dataset}|{self.version}|".encode()
        return hmac.digest(self._keys[0], bound + packed, "sha256")[:TAG]

    def _cover(self, tag: bytes, data: bytes) -> bytes:
        key, stream = self._keys[1], b""
        while len(stream) < len(data):
            stream += hmac.digest(key, tag + bytes((len(stream) // 32,)), "sha256")
        return bytes(a ^ b for a, b in zip(data, stream, strict=False))

    def seal(self, packed: bytes) -> str:
        tag = self._tag(packed)
        return PREFIX + base64.b32encode(self.header + tag + self._cover(tag, packed)).decode().rstrip("=")

    def opened(self, token: str) -> tuple[str, bytes | None]:
        """(status, reference): verified, or why it isn't; duplicates are not told here."""
        body = token.strip().upper().removeprefix(PREFIX)
        try:
            raw = base64.b32decode(body + "=" * (-len(body) % 8))
        except ValueError:
            return "invalid", None
        if base64.b32encode(raw).decode().rstrip("=") != body or len(raw) < 1 + FINGERPRINT + TAG + 2:
            return "invalid", None
        if raw[1 : 1 + FINGERPRINT] != self.header[1:]:
            return "foreign", None
        if raw[0] != self.version:
            return "invalid", None
        if self.master is None:
            return "old_key", None
        tag, sealed = raw[1 + FINGERPRINT : 1 + FINGERPRINT + TAG], raw[1 + FINGERPRINT + TAG :]
        packed = self._cover(tag, sealed)
        return ("verified", packed) if hmac.compare_digest(tag, self._tag(packed)) else ("invalid", None)

    def open(self, token: str) -> tuple[int, str]:
        """(table, key), or TokenError."""
        status, packed = self.opened(token)
        if packed is None:
            raise TokenError(status)
        return unpack(packed)


def seal_column(sealer: Sealer, table: int):
    """A Column function: a row's key -> its token."""

    @F.pandas_udf("string")
    def seal(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else sealer.seal(pack(table, k)))

    return seal


def open_column(sealer: Sealer):
    """A Column function: a token -> (status, table, key, reference in hexadecimal)."""

    @F.pandas_udf("status string, table_no int, row_key string, reference string")
    def open_(tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for t in tokens:
            status, packed = sealer.opened(t) if t is not None else ("missing", None)
            try:
                table, key = unpack(packed) if packed else (None, None)
            except UnicodeDecodeError:
                status, packed, table, key = "invalid", None, None, None
            rows.append((status, table, key, packed.hex() if packed else None))
        return pd.DataFrame(rows, columns=["status", "table_no", "row_key", "reference"]).astype({"table_no": "Int32"})

    return open_


# ---------------------------------------------------------------- tables


def add_references(df: DataFrame, key_column: str | None) -> DataFrame:
    """df with REFERENCE: the row's key where there is a key column, else its place from 1."""
    own = F.col(f"`{key_column}`") if key_column else (F.col(ROW) + 1).cast("string")
    return df.withColumn(REFERENCE, own.cast("string"))


def usable_key(df: DataFrame, key_column: str | None) -> str | None:
    """key_column if it is unique and never null."""
    if key_column is None:
        return None
    value = F.col(f"`{key_column}`")
    worst = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls")).first()
    return key_column if (worst["n"] or 0) <= 1 and not worst["nulls"] else None


def for_share(tables: dict[str, DataFrame], sealer: Sealer) -> dict[str, DataFrame]:
    """The tables that a recipient gets: the token first, the reference gone."""
    out = {}
    for k, (name, df) in enumerate(tables.items()):
        token = seal_column(sealer, k)(F.col(REFERENCE)).alias(TOKEN_COLUMN)
        out[name] = df.select(ROW, token, *(F.col(f"`{c}`") for c in df.columns if c not in (ROW, REFERENCE)))
    return out


def classified(rows: DataFrame, token: Column, sealer: Sealer, n_tables: int, order: str = ROW) -> DataFrame:
    """rows with status, table_no, row_key: missing, invalid, foreign, old_key, duplicate (a reference seen in an
    earlier row) or verified."""
    text = F.trim(token.cast("string"))
    empty = text.isNull() | (text == "")
    shaped = F.when(F.upper(text).rlike(TOKEN_SHAPE), text)
    out = rows.withColumn("_shape", F.when(empty, "missing").when(shaped.isNull(), "invalid")).withColumn("_open", open_column(sealer)(shaped))
    known = (F.col("_open.status") == "verified") & (F.col("_open.table_no") < n_tables)
    out = out.withColumn("_ref", F.when(F.col("_shape").isNull() & known, F.col("_open.reference")))
    out = written(out, "opened")  # it is read for its first rows and for itself, and tokens are opened once
    first = out.filter("_ref IS NOT NULL").groupBy(F.col("_ref").alias("_r")).agg(F.min(order).alias("_first"))
    out = out.join(first, F.col("_ref") == F.col("_r"), "left")
    seen = F.when(F.col("_ref").isNotNull(), F.when(F.col(order) == F.col("_first"), "verified").otherwise("duplicate"))
    opened = F.when(F.col("_open.status") == "verified", "invalid").otherwise(F.col("_open.status"))
    status = F.coalesce("_shape", seen, opened)
    return out.withColumns({"status": status, "table_no": F.col("_open.table_no"), "row_key": F.col("_open.row_key")}).drop("_shape", "_open", "_ref", "_r", "_first")


def first_of(df: DataFrame, keys: list[str], order: str = ROW) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")
