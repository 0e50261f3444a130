"""Arrays of numbers packed into binary values, so that a shuffle moves few rows and no padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def pack(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, plane by plane, so that high bytes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpack(raw: bytes, size: int) -> np.ndarray:
    """The numbers of ``pack``."""
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").reshape(-1)


def join(*parts: bytes) -> bytes:
    """Several values in one."""
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def split(raw: bytes, n: int) -> list[bytes]:
    """The n values of ``join``."""
    at = [4 * n]
    for size in np.frombuffer(raw[: 4 * n], "<u4").tolist():
        at.append(at[-1] + size)
    return [raw[at[i] : at[i + 1]] for i in range(n)]


def values(batches):
    """(part, bytes) of each row of batches of (part, data), then (None, None)."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), (x.as_buffer().to_pybytes() for x in batch.column(1)))
    yield None, None


#: Bytes of text for each range of keys, and the most ranges for each shuffle partition.
RANGE_BYTES, MOST = 1 << 22, 16


def ranges(spark: SparkSession, n_bytes: int) -> int:
    """How many ranges of keys suit a corpus of so many bytes of text."""
    return int(max(1, min(-(-n_bytes // RANGE_BYTES), MOST * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``part`` dealt by part, the rows of a part together and in ``order``.

    A batch makes a row for each range that it reaches. Ranges follow the bytes of the corpus, not the shuffle partitions,
    so a small corpus makes few rows however many partitions there are.
    """
    return rows.repartition("part").sortWithinPartitions("part", *order)
