"""What the operators of this folder share: tables, lineage cuts, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; every executor must see it, so nothing else will do."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where a result is read more than once; a lost executor then costs a
    reread of files, not a recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sigmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in all rows; sizes partitions and groups."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def blocks_for(size: int, per_block: int, least: int = 1) -> int:
    return max(least, -(-size // per_block))


def block_of(col: str, n: int):
    """A number below n that depends on the value of `col` alone."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z (and no other letter) in lower case: bytes.lower does just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def planes(a: np.ndarray) -> bytes:
    """An array, column by column, as all its first bytes, then all its second ones, and so on: sorted keys and small counts then compress well."""
    a = np.ascontiguousarray(a.T)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype: np.dtype, columns: int = 1) -> np.ndarray:
    """What `planes` was given; rows of `columns` numbers if there is more than one."""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype)
    return a.ravel() if columns == 1 else a.reshape(columns, -1).T


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


FACTOR = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd factor and of its inverse, modulo 2^64."""
    if n > len(_powers[0]):
        for k, base in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive codes; empty if there are fewer.

    Differences of one running sum, so the cost doesn't depend on n.
    """
    m = len(codes) - n + 1
    if m <= 0 or n == 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(codes))
    with np.errstate(over="ignore"):
        total = np.cumsum(codes * up[: len(codes)])
        x = total[n - 1 :].copy()
        x[1:] -= total[: m - 1]
        x *= down[:m]
    return mix(x)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, and one that is the same for A and a.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
#: Bytes of text whose words are hashed at once.
AT_ONCE = 1 << 18


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64 bits for each word data[start:end], by a running sum over all bytes."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        part = data[base : int(ends[to - 1])]
        up, down = powers(len(part))
        first, last = starts[at:to] - base, ends[at:to] - base
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(number[part] * up[: len(part)], out=total[1:])
            out[at:to] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        at = to
    return out


def coded(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, codes of all these words) for runs of rows of a string column; null is empty.

    A word is what stands between ASCII white space; its code is a 64-bit hash,
    with `lower` of the word with A-Z in lower case. Whole runs of rows are
    hashed together, so a word costs no Python call.
    """
    before = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(chunk):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1)
            part, borders = data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            inside = ~SPACE[part]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = borders[:-1][borders[:-1] < borders[1:]]
            first[begins] = inside[begins]
            finals = borders[1:][borders[:-1] < borders[1:]] - 1
            last[finals] = inside[finals]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            yield before + row, np.diff(np.searchsorted(starts, borders)), _hashed(part, starts, ends, LOWER if lower else BYTE)
            row = to
        before += len(chunk)


def codes_of(text: str | None, lower: bool = False) -> np.ndarray:
    """The codes of the words of one text."""
    return next(coded(pa.array([text], pa.string()), lower))[2]
