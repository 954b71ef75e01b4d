"""Flat-array views of many texts: one code-point array for a batch, with document offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX_1, MIX_2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser of a uint64 array (wraps silently)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the offsets of the texts (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def chunks(texts: Sequence[str], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``mask`` that don't cross a text's edge."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    edge = offsets[:-1][offsets[:-1] < len(mask)]
    before[edge] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    after[edge[edge > 0] - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] : starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values``; spans don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = ragged(starts, lengths)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        mixed = mix(values[at].astype(np.uint64) + (inner.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        return mix(np.add.reduceat(mixed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


BASE = int(GOLDEN) | 1
INVERSE = pow(BASE, -1, 1 << 64)
TOP = np.uint64((1 << 64) - 1)


def window_hash(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` code points (``len(points) - size + 1`` of them), from prefix sums."""
    n = len(points)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.full(n, np.uint64(BASE))
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(77)) * power, out=sums[1:])
        power[:] = np.uint64(INVERSE)
        power[0] = 1
        np.cumprod(power, out=power)
        return mix((sums[size:] - sums[:-size]) * power[: n - size + 1])


def slide(values: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` values, in two passes."""
    n = len(values)
    fill = TOP if f is np.minimum else np.uint64(0)
    blocks = np.concatenate([values, np.full(-n % width, fill)]).reshape(-1, width)
    prefix = f.accumulate(blocks, axis=1).ravel()
    suffix = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(suffix[: n - width + 1], prefix[width - 1 : n])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as disjoint spans in order; touching spans become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[first], ends[np.r_[first[1:], len(starts)] - 1]


def equal_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal sorted keys."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return start, np.r_[start[1:], len(keys)].astype(np.int64)


def whole_runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """The rows of batches sorted by an integer column, cut only between its values, so that a task holds no more than
    a batch and one value's rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(name)).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(name)[-1].as_py() != keys[-1]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def may_hold(keys: DataFrame, bits: int = 1 << 25):
    """A test on ``xxhash64(key)`` that is true for all the keys and few others, so that a join with them shuffles few
    rows. It is one bit array of fixed size (4 MB whatever the number of keys), filled by an aggregation."""
    spots = keys.select(F.pmod(F.xxhash64("key"), F.lit(bits)).alias("spot"))
    filled = spots.groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        spot = np.mod(hashes.to_numpy(), bits)
        return pd.Series((words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return test
