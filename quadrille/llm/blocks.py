"""Packed blocks: many (key, owner) pairs in a few rows of bytes, for shuffles of hashes.

A task packs its pairs into one row per bucket of keys; a bucket's rows meet in one task, where
numpy sorts and compares them. Before packing, pairs that need not travel are settled in the task,
so a key sends at most one pair per packed chunk, however many rows hold it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession


def bucket_count(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets to deal packed keys into: several per shuffle partition, so that partitions even out."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the top bits, so that a bucket is a range of keys: sorting by key sorts by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, and the differences in as few whole bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=keys[:1])
    gaps[0] = 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width]  # little-endian
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(planes).tobytes()


def unpack(block: bytes) -> np.ndarray:
    if not block:
        return np.zeros(0, np.uint64)
    width = block[0]
    first = np.frombuffer(block, np.uint64, 1, 1)[0]
    planes = np.frombuffer(block, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(planes), 8), np.uint8)
    gaps[:, :width] = planes
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) + first


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers of any order: an offset, and what is above it in as few whole bytes as the largest needs; equal ones as one and their count."""
    if not len(x):
        return b""
    x = x.astype(np.int64)
    least = int(x.min())
    above = (x - least).view(np.uint64)
    width = (int(above.max()).bit_length() + 7) // 8
    if not width:
        return bytes([0]) + np.array([least, len(x)], np.int64).tobytes()
    return bytes([width]) + np.int64(least).tobytes() + np.ascontiguousarray(above.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueeze(block: bytes) -> np.ndarray:
    if not block:
        return np.zeros(0, np.int64)
    width = block[0]
    least = np.frombuffer(block, np.int64, 1, 1)[0]
    if not width:
        return np.full(int(np.frombuffer(block, np.int64, 1, 9)[0]), least)
    planes = np.frombuffer(block, np.uint8, offset=9).reshape(-1, width)
    above = np.zeros((len(planes), 8), np.uint8)
    above[:, :width] = planes
    return above.view(np.uint64).ravel().view(np.int64) + least


def joined(table, name: str, read) -> np.ndarray:
    """A binary column's blocks, read and put together."""
    return np.concatenate([read(x.as_py() or b"") for x in table.column(name)] or [read(b"")])
