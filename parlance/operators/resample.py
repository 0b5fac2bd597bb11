"""Poisson bootstrap sums of all draws in one pass: each group is one row with an array of draws."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distribution function of a Poisson number with mean 1.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
#: Rows whose weights are drawn at once.
CHUNK = 256
PRIME = (1 << 31) - 1


def _least(p: float) -> int:
    """The least number below PRIME that is p or more as a fraction of it."""
    return next(r for r in range(int(p * PRIME) - 2, PRIME) if r / PRIME >= p)


_STEPS = [np.uint32(_least(p)) for p in POISSON]


def _md5(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def multipliers(draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Per draw the line that sends a row's seed to its number; both from md5 of the draw."""
    a = np.array([1 + _md5(f"a{d}") % (PRIME - 1) for d in range(1, draws + 1)], np.int64)
    return a, np.array([_md5(f"b{d}") % PRIME for d in range(1, draws + 1)], np.int64)


def seed(*parts: Column) -> Column:
    """A row's seed: md5 of the parts, below PRIME."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(PRIME)


def weights(seeds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows x draws Poisson(1) numbers: (seed a + b) mod PRIME as a fraction, pairwise independent between rows."""
    x = seeds[:, None] * a[None, :] + b[None, :]
    # PRIME is 2^31 - 1, so high and low bits add up to the same remainder, or to that and PRIME
    r = ((x & PRIME) + (x >> 31)).astype(np.uint32)
    r = np.minimum(r, r - np.uint32(PRIME))
    out = np.zeros(r.shape, np.uint8)
    for step in _STEPS:
        out += (r >= step).view(np.uint8)
    return out


def _weighted(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per value and draw the weighted sum of the rows; in doubles where they hold every sum exactly."""
    most = np.abs(values.astype(np.float64)).max(initial=0)
    if most * len(POISSON) * len(values) < 1 << 53:
        return np.rint(values.T.astype(np.float64) @ w.astype(np.float64)).astype(np.int64)
    return values.T @ w.astype(np.int64)


def drawn_sums(rows: DataFrame, keys: list[str], values: list[str], identity: list[Column], draws: int) -> DataFrame:
    """(keys, values): per group and value an array with the weighted sum of each draw.

    A row's weights depend on ``identity`` alone. Tasks add up their rows' weights and send one row for
    each group they hold, so what is shuffled grows with groups and tasks, not with rows times draws.
    Keys are strings; values are whole numbers and null counts as 0. Groups are few (parties by items).
    """
    a, b = multipliers(draws)
    small = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.coalesce(F.col(v).cast("long"), F.lit(0).cast("long")).alias(v) for v in values], seed(*identity).alias("_seed"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            code, kinds = np.zeros(batch.num_rows, np.int64), []
            for k in keys:
                column = batch.column(k).dictionary_encode()
                kinds.append([*column.dictionary.to_pylist(), None])
                code = code * len(kinds[-1]) + column.indices.fill_null(len(kinds[-1]) - 1).to_numpy(zero_copy_only=False)
            seeds = batch.column("_seed").to_numpy(zero_copy_only=False)
            table = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values], 1)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            for start, stop in zip(starts, [*starts[1:], len(order)]):
                rest, key = int(code[order[start]]), ()
                for names in reversed(kinds):
                    rest, at = divmod(rest, len(names))
                    key = (names[at], *key)
                for at in range(start, stop, CHUNK):
                    where = order[at : min(at + CHUNK, stop)]
                    got = _weighted(table[where], weights(seeds[where], a, b))
                    sums[key] = sums[key] + got if key in sums else got
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(len(keys))]
        columns += [pa.array([s[j].tolist() for s in sums.values()], pa.list_(pa.int64())) for j in range(len(values))]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, *values])

    schema = ", ".join([f"`{k}` string" for k in keys] + [f"`{v}` array<bigint>" for v in values])
    zero = F.array_repeat(F.lit(0).cast("long"), draws)
    total = lambda v: F.aggregate(F.collect_list(v), zero, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))  # noqa: E731  one array a task
    return small.mapInArrow(add, schema).groupBy(*keys).agg(*[total(v).alias(v) for v in values])


def by_draw(sums: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per draw (from 1) and group."""
    return sums.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("draw", "_s")).select((F.col("draw") + 1).alias("draw"), *keys, *[F.col("_s")[v].alias(v) for v in values])


def draws_sql(draws: int) -> str:
    """dr (draw, a, b): the twin of ``multipliers``."""
    code = lambda x: f"('0x' || substr(md5('{x}' || draw), 1, 8))::BIGINT"
    return f"dr AS MATERIALIZED (SELECT draw, 1 + {code('a')} % {PRIME - 1} AS a, {code('b')} % {PRIME} AS b FROM range(1, {draws + 1}) t(draw))"


def seed_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT % {PRIME}"


def weight_sql(seed: str) -> str:
    """The weight of a row with this seed in the draw of ``dr``."""
    u = f"((({seed} * a + b) % {PRIME}) / {PRIME}::DOUBLE)"
    return "(" + " + ".join(f"({u} >= {p})::INTEGER" for p in POISSON) + ")"
