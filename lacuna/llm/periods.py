"""Periodic runs of words: stretches that repeat one and the same sequence, found by probing a harmonic grid.

A run is a stretch of words with smallest period p (words p apart are equal), at least ``least`` words and ``exponent`` periods long,
that no neighbour extends. For every period p up to n / exponent the words at the grid points jp and (j + 1)p are compared: all periods
together are n (1 + 1/2 + 1/3 + ...) probes, taken as arrays. A run of e periods spans e - 1 equal neighbours on its period's grid, so
only where e - 1 probes in a row hold is a stretch extended to both sides, by comparing chunks of the words with the words p further on.

Grid points in found runs are skipped: those that a run of the same period reaches, and stretches of probes that lie within a run of a
smaller period q. A run of p there would share p + q words with it, so both had the period gcd(p, q), and p wouldn't be the smallest. This
keeps a text of one repeated word at its probes.

A document is the unit of work; a task holds the word numbers of one, 8 bytes a word, and a block of its probes.

Cases. Null or empty text: no words, no run. Null doc_id: a row like any other. Repeated rows: a row each. An empty table: no row. Words
are runs of anything but space and tab to carriage return, compared by bytes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import WS

#: Shortest run in words, and in periods.
LEAST, EXPONENT = 6, 4
#: Probes that are held at once.
BLOCK = 1 << 18


def _chunked(a: np.ndarray, i: int, p: int, step: int) -> int:
    """How many of the words at i, i + step, i + 2 step, ... equal the words p further on; chunks double while all are equal."""
    n, chunk = 0, 32
    while True:
        if step > 0:
            x = a[i + n : min(i + n + chunk, len(a) - p)]
            y = a[i + n + p : i + n + p + len(x)]
        else:
            low = max(i - n - chunk + 1, 0)
            x, y = a[low : i - n + 1][::-1], a[low + p : i - n + 1 + p][::-1]
        if not len(x):
            return n
        same = x == y
        if not same.all():
            return n + int(same.argmin())
        n += len(x)
        chunk = min(2 * chunk, 1 << 16)


class _Found:
    """Found runs, and which stretches lie within one."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self.starts = self.reach = np.zeros(0, np.int64)
        self.fresh = 0

    def settle(self) -> None:
        """From now on ``within`` knows of the runs found so far."""
        if self.fresh != len(self.runs):
            spans = np.array([(s, s + n) for s, n, _ in self.runs], np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            self.starts, self.reach = spans[:, 0], np.maximum.accumulate(spans[:, 1])
            self.fresh = len(self.runs)

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether one run holds words low to high, both included."""
        if not len(self.starts):
            return np.zeros(len(low), bool)
        at = np.searchsorted(self.starts, low, "right") - 1
        return (at >= 0) & (self.reach[np.maximum(at, 0)] > high)


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all words before each place, each times a power of its place, modulo 2^64; and the powers."""
    with np.errstate(over="ignore"):
        z = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), 0x5851F42D4C957F2D, np.uint64))])
        return np.concatenate([[np.uint64(0)], np.cumsum(z * powers[:-1], dtype=np.uint64)]), powers


def _grids(n: int, exponent: int, block: int):
    """Periods and their grid points that have ``exponent`` - 1 further ones below n, in blocks of about ``block``."""
    p = 1
    while p <= n // exponent:
        q = min(n // exponent, p + max(1, block // (n // p)) - 1)
        periods = np.arange(p, q + 1)
        counts = (n - 1) // periods - (exponent - 1) + 1
        counts = np.maximum(counts, 0)
        of = np.repeat(periods, counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield of, of * nth
        p = q + 1


def find_runs(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period. exponent: 3 or more, as
    shorter runs may lie across others."""
    if exponent < 3:
        raise ValueError("runs are looked for from 3 periods on")
    n, found = len(words), _Found()
    sums, powers = _sums(words)
    for of, at in _grids(n, exponent, block):
        alive = words[at] == words[at + of]
        for k in range(1, exponent - 1):  # the next probes of the grid, of those that are left
            of, at = of[alive], at[alive]
            alive = words[at + k * of] == words[at + (k + 1) * of]
        of, at = of[alive], at[alive]
        if not len(of):
            continue
        found.settle()
        # the words between the probes: their sums differ unless all are equal, but for chance; what is left is compared word by word
        last, span = at + (exponent - 2) * of, at + of
        alive = (sums[last + of] - sums[span] == (sums[last] - sums[at]) * powers[of]) & ~found.within(at, last + of)
        of, at = of[alive], at[alive]
        if not len(of):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            p = int(of[a])
            points = at[a:b]
            found.settle()
            points = points[~found.within(points, points + (exponent - 1) * p)].tolist()
            i = 0
            while i < len(points):
                x = points[i]
                end = x + _chunked(words, x, p, 1)
                start = x - _chunked(words, x - 1, p, -1) if x else 0
                length = end - start + p
                # probes may hold by chance beyond the stretch, so it may still be one of a smaller period
                if length >= max(least, exponent * p) and not found.within(np.array([start]), np.array([start + length - 1]))[0]:
                    found.runs.append((start, length, p))
                i = max(i + 1, bisect_left(points, end))
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def numbered(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list, runs) -> list:
    """The words but those that a run has after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        gone[start + p] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _per_text(least: int, exponent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for text in part.column("text").to_pylist():
                    words = (text or "").encode().split()  # bytes split at space and tab to carriage return alone
                    runs = find_runs(numbered(words), least, exponent) if len(words) >= least else []
                    rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs) if runs else words).decode()))
                n, runs, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, _RUN), pa.array(kept, pa.string())], schema=schema)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row a document: doc_id, n_words, runs (array of start, length, period in words, by start, then period) and collapsed, the words
    joined by one space without what any run repeats after its first period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_per_text(least, exponent), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by the CRC-32 of doc_id, repeats a stretch to its end, as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), rf"[{WS}]+"), "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("l")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = F.col("best")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", F.array_max(ranked)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["s"]).alias("start"), best["l"].alias("length"), (-best["p"]).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"), sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
