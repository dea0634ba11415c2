"""Discrete Fourier transform of series too long for one task.

Bluestein's chirp transform turns a DFT of any length n into a convolution of length m, a power of two; the transforms
of length m = rows * cols are taken in two grouped steps of about sqrt(m) values each (Cooley and Tukey), so every task
holds only short rows of the matrix and the shuffles between them are by (series, row) or (series, column).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMA = "id long, n long, i long, re double, im double"


def _complex(t: pa.Table) -> np.ndarray:
    return t["re"].to_numpy() + 1j * t["im"].to_numpy()


def _table(like: pa.Table, index: np.ndarray, z: np.ndarray) -> pa.Table:
    return pa.table({
        "id": np.full(len(z), like["id"][0].as_py(), "int64"),
        "n": np.full(len(z), like["n"][0].as_py(), "int64"),
        "i": index.astype("int64"),
        "re": np.ascontiguousarray(z.real),
        "im": np.ascontiguousarray(z.imag),
    })


def _shape(n: int) -> tuple[int, int]:
    bits = int(2 * n - 2).bit_length()
    rows = 1 << (bits // 2)
    return rows, (1 << bits) // rows


def _columns_sql() -> Column:
    """Columns of the matrix: ``2**(bits - bits div 2)`` with ``bits`` = binary digits of 2n-2."""
    bits = F.length(F.bin(2 * F.col("n") - 2))
    return F.pow(F.lit(2), bits - F.floor(bits / 2)).cast("long")


def _rows_sql() -> Column:
    bits = F.length(F.bin(2 * F.col("n") - 2))
    return F.pow(F.lit(2), F.floor(bits / 2)).cast("long")


def _chirp(i: np.ndarray, n: int, sign: int) -> np.ndarray:
    """``exp(sign i pi i**2 / n)`` with the square reduced exactly modulo 2n."""
    i = i.astype("int64")
    if n < 1 << 31:
        square = (i * i) % (2 * n)
    else:
        square = np.array([v * v % (2 * n) for v in i.tolist()], "float64")
    return np.exp(sign * 1j * np.pi * (square / n))


def _transform(df: DataFrame, inverse: bool) -> DataFrame:
    """Length-m transform of sparse (id, n, i, re, im); indices that are absent count as zero."""
    sign = 1 if inverse else -1

    def down(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        rows, cols = _shape(n)
        i = t["i"].to_numpy()
        x = np.zeros(rows, complex)
        x[i // cols] = _complex(t)
        col = int(i[0] % cols)
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        k1 = np.arange(rows)
        y = y * np.exp(sign * 2j * np.pi * ((k1 * col) / (rows * cols)))
        return _table(t, k1 * cols + col, y)

    def across(t: pa.Table) -> pa.Table:
        rows, cols = _shape(t["n"][0].as_py())
        i = t["i"].to_numpy()
        x = np.zeros(cols, complex)
        x[i % cols] = _complex(t)
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        return _table(t, int(i[0] // cols) + rows * np.arange(cols), y)

    column = F.col("i") % _columns_sql()
    row = F.floor(F.col("i") / _columns_sql())
    first = df.groupBy("id", column.alias("c")).applyInArrow(lambda t: down(t), _SCHEMA)
    return first.groupBy("id", row.alias("r")).applyInArrow(lambda t: across(t), _SCHEMA)


def long_half_spectrum(samples: DataFrame) -> DataFrame:
    """(id, t, x) -> (id, k, n, a), a = |DFT| for k = 0 .. n div 2."""
    sizes = samples.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    # n travels with every row; parts of the positions spread the rows of a long series over the join
    parts = 256
    spread = sizes.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sized = samples.withColumn("p", (F.col("t") % parts).cast("int")).join(spread, ["id", "p"])

    def modulate(t: pa.RecordBatch, sign: int) -> pa.RecordBatch:
        i, n = t["i"].to_numpy(), t["n"].to_numpy()
        z = _complex(t)
        for size in np.unique(n):
            at = n == size
            z[at] *= _chirp(i[at], int(size), sign)
        return pa.RecordBatch.from_pydict({"id": t["id"], "n": t["n"], "i": t["i"], "re": z.real.copy(), "im": z.imag.copy()})

    def chirped(df: DataFrame, sign: int) -> DataFrame:
        return df.mapInArrow(lambda it: (modulate(t, sign) for t in it if t.num_rows), _SCHEMA)

    zero = F.lit(0.0)
    signal = chirped(sized.select("id", "n", F.col("t").alias("i"), F.col("x").alias("re"), zero.alias("im")), -1)
    # the chirp filter exp(+i pi j*j / n) for |j| < n, wrapped around m; generated in steps, so rows stay small
    step = 1 << 12
    starts = sizes.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step))).alias("s"))
    stop = F.least(F.col("s") + step, F.col("n")) - 1
    j = starts.repartition("id", "s").select("id", "n", F.explode(F.sequence(F.col("s"), stop)).alias("i"))
    ones = j.select("id", "n", "i", F.lit(1.0).alias("re"), zero.alias("im"))
    half = chirped(ones, 1)
    size = _rows_sql() * _columns_sql()
    wrapped = half.filter("i > 0").withColumn("i", size - F.col("i"))
    chirp = half.unionByName(wrapped.select("id", "n", "i", "re", "im"))

    a = _transform(signal, False).alias("a")
    b = _transform(chirp, False).alias("b")
    re = F.col("a.re") * F.col("b.re") - F.col("a.im") * F.col("b.im")
    im = F.col("a.re") * F.col("b.im") + F.col("a.im") * F.col("b.re")
    product = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.i") == F.col("b.i"))).select(
        "a.id", "a.n", "a.i", re.alias("re"), im.alias("im")
    )
    out = _transform(product, True).filter(F.col("i") <= F.floor(F.col("n") / 2))
    return out.select("id", F.col("i").alias("k"), "n", F.hypot("re", "im").alias("a"))
