"""Many (document, key) pairs in few rows: packed numpy arrays that are dealt out by bucket.

A row of one bucket holds the documents' ids as differences, how many keys each has, and the keys. Bytes of equal
weight are stored together, so that the shuffle's compression takes most of the ids and counts away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that a task gathers before it deals them out.
BUFFER = 1 << 21


def planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(data: bytes | pa.Buffer, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids, one for each key, as (differences of the ids that follow each other, how often each)."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(ids))).astype(np.int32)
    return planes(np.diff(ids[at], prepend=np.int64(0))), planes(counts)


def unpack_ids(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.cumsum(unplanes(ids, np.int64)), unplanes(counts, np.int32))


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns' values in it) for every bucket present."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, cuts[1:]):
        yield int(bucket[a]), *(c[a:b] for c in columns)


def home(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document, as home_column() has it."""
    u = ids.view(np.uint64)
    for s in (np.uint64(7), np.uint64(17), np.uint64(31)):
        u = u ^ (u >> s)
    return (u >> np.uint64(1)).astype(np.int64) % n


def home_column(doc_id: Column, n: int) -> Column:
    u = doc_id
    for s in (7, 17, 31):
        u = u.bitwiseXOR(F.shiftrightunsigned(u, s))
    return F.coalesce(F.shiftrightunsigned(u, 1) % n, F.lit(0)).cast("int")


def batch_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


class Found:
    """A set of (document, key) pairs with a flag each; asked for many pairs at once."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.codes = self.flags = None

    @staticmethod
    def code(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        from webgauge.llm.textarrays import mix

        return mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ keys

    def add(self, ids: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> None:
        self.parts.append((self.code(ids, keys), flags))
        self.codes = None

    def look(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The flag of each pair, 0 if it isn't there."""
        if self.codes is None:
            codes = np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in self.parts)])
            flags = np.concatenate([np.zeros(0, np.uint8), *(f for _, f in self.parts)])
            order = np.argsort(codes)
            codes, flags = codes[order], flags[order]
            at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            self.codes, self.flags = codes[at], (np.bitwise_or.reduceat(flags, at) if len(at) else flags)
            self.parts = [(self.codes, self.flags)]
        if not len(self.codes):
            return np.zeros(len(ids), np.uint8)
        code = self.code(ids, keys)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.flags[at], 0).astype(np.uint8)
