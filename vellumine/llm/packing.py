"""Filling fixed-capacity containers: length combinations weighted by non-negative least squares.

Only the histogram of lengths (at most one row per length up to the capacity) reaches the driver.  Shallow combinations of
lengths that fill a window just below the capacity are the columns of a matrix; non-negative least squares finds repeat
counts that reproduce the histogram, rounding makes them whole, and the residual is packed greedily, again as
(combination, repeats) runs.  Rows then find their container by their rank within their length: no row is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.ranks import ranked
from vellumine.session import written

Pattern = tuple[dict[int, int], int]


def combinations(lengths: np.ndarray, capacity: int, window: int, depth: int = 12) -> list[dict[int, int]]:
    """Combinations k x a + m x b (+ c) of known lengths whose sum lies in [capacity - window, capacity].

    For every length a, up to `depth` times or as often as it fits, the gap is closed by up to three equal lengths, the last
    one by a length of its own, or by two different ones: at most 8 (depth + 1) combinations a length, over all lengths.
    """
    known = np.zeros(capacity + 1, dtype=bool)
    known[lengths] = True
    below = np.maximum.accumulate(np.where(known, np.arange(capacity + 1), -1)).tolist()  # the largest known length up to each value
    found: dict[tuple, dict[int, int]] = {}

    def add(*parts: tuple[int, int]) -> None:
        if capacity - window <= sum(n * k for n, k in parts):
            pattern: dict[int, int] = {}
            for n, k in parts:
                pattern[n] = pattern.get(n, 0) + k
            found.setdefault(tuple(sorted(pattern.items())), pattern)

    for a in lengths.tolist():
        most = capacity // a
        for k in {*range(1, min(depth, most) + 1), most}:
            gap = capacity - k * a
            add((a, k))
            for m in (1, 2, 3):
                b = below[gap // m]
                if b > 0:
                    add((a, k), (b, m))
                    c = below[gap - m * b]
                    if c > 0:
                        add((a, k), (b, m), (c, 1))
            if gap > 1:
                for part in (gap // 3, gap // 5):
                    half = below[max(part, 1)]
                    if half > 0 and (c := below[gap - half]) > 0:
                        add((a, k), (half, 1), (c, 1))
    return list(found.values())


def solve_repeats(patterns: list[dict[int, int]], counts: np.ndarray, capacity: int, rounds: int = 200) -> np.ndarray:
    """Repeats x >= 0 minimising |A x - counts|, by multiplicative updates (they keep x non-negative).

    They start from the histogram, weighted by how well a combination fills, and so end near the best filling solution.
    """
    cols = np.fromiter((j for j, p in enumerate(patterns) for _ in p), dtype=np.int64)
    rows = np.fromiter((n for p in patterns for n in p), dtype=np.int64)
    vals = np.fromiter((k for p in patterns for k in p.values()), dtype=np.float64)
    size = len(patterns)
    target = np.bincount(cols, vals * counts[rows], size)
    waste = capacity - np.bincount(cols, vals * rows, size)
    x = np.exp(-8.0 * waste / max(1.0, float(waste.max(initial=1.0))))
    x *= np.bincount(cols, vals * counts[rows], size) / np.maximum(np.bincount(cols, vals * np.bincount(rows, vals * x[cols], len(counts))[rows], size), 1e-12)
    for _ in range(rounds):
        fit = np.bincount(rows, vals * x[cols], len(counts))
        x *= target / np.maximum(np.bincount(cols, vals * fit[rows], size), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int, window: int | None = None, passes: int = 30) -> list[Pattern]:
    """(combination, repeats) runs that use up the histogram of lengths from 1 to `capacity` exactly; what the solver leaves is packed greedily.

    A pass solves for the repeats, rounds them, and leaves the rest to the next pass, as long as passes place a hundredth of the items left.
    """
    runs, left = solved(histogram, capacity, window, passes)
    return [*runs, *greedy(left, capacity)]


def solved(histogram: dict[int, int], capacity: int, window: int | None = None, passes: int = 30) -> tuple[list[Pattern], np.ndarray]:
    """The runs of the solver, and how many items of each length they leave."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        left[n] = c
    runs: list[Pattern] = []
    if left[capacity]:
        runs.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    window = max(1, capacity // 64) if window is None else window
    for _ in range(passes):
        lengths, before = np.flatnonzero(left), int(left.sum())
        patterns = combinations(lengths, capacity, window) if before else []
        if not patterns:
            break
        x = solve_repeats(patterns, left.astype(np.float64), capacity)
        carry = 0.0  # what rounding leaves of a combination goes to the next one of the same longest length
        longest = [max(p) for p in patterns]
        room = [capacity - sum(n * k for n, k in p.items()) for p in patterns]
        for j in sorted(range(len(patterns)), key=lambda j: (-longest[j], room[j])):
            p = patterns[j]
            carry += float(x[j])
            repeats = min([round(carry), *(int(left[n]) // k for n, k in p.items())])
            if repeats > 0:
                for n, k in p.items():
                    left[n] -= k * repeats
                runs.append((p, repeats))
                carry -= repeats
            carry = min(carry, 1.0)
        if before - int(left.sum()) < 0.01 * before:
            break
    return runs, left


def greedy(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Runs that pack what is left, the longest item that fits first; each run uses up a length or repeats as often as it can."""
    left, runs = left.copy(), []
    while (rest := np.flatnonzero(left)).size:
        pattern, room = {}, capacity
        while room:
            fits = rest[: np.searchsorted(rest, room, side="right")]
            n = next((int(v) for v in fits[::-1] if left[v] > pattern.get(int(v), 0)), None)
            if n is None:
                break
            k = min(room // n, int(left[n]) - pattern.get(n, 0))
            pattern[n] = pattern.get(n, 0) + k
            room -= n * k
        repeats = min(int(left[n]) // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * repeats
        runs.append((pattern, repeats))
    return runs


def pack(df: DataFrame, ident: str, size: str, capacities: dict[str, int], window: int | None = None) -> DataFrame:
    """Container of every item for every profile: profile, capacity, `ident`, piece, pieces, `size` (of the piece), container.

    An item larger than the capacity is cut into full containers and one remainder, which is packed like an item; no other
    item is cut.  Items of size 0 take no room and lie in container 0.  Null ids and null or negative sizes are no items; a
    repeated `ident` is one item (its largest size counts).  An empty table gives an empty result.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be at least 1")
    spark = df.sparkSession
    profiles = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for p, c in capacities.items()]))
    items = df.select(F.col(ident).alias("i"), F.col(size).cast("long").alias("n")).where("i is not null and n >= 0").groupBy("i").agg(F.max("n").alias("n"))
    items = items.select("i", "n", profiles.alias("p")).select("i", "n", "p.*")
    items = items.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity")))).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces"))))
    items = items.withColumn("n", F.least(F.col("capacity"), F.col("n") - (F.col("piece") - 1) * F.col("capacity")))
    items = written(items, "pack-items")
    counts: dict[str, dict[int, int]] = {p: {} for p in capacities}
    for r in items.where("n > 0").groupBy("profile", "n").agg(F.count(F.lit(1)).alias("c")).collect():  # at most one row per length up to a capacity
        counts[r.profile][r.n] = r.c
    segments = []
    for profile, histogram in counts.items():
        base, used = 0, dict.fromkeys(histogram, 0)
        slots: dict[int, tuple[list, list, list]] = {n: ([], [], []) for n in histogram}
        for pattern, repeats in plan(histogram, capacities[profile], window):
            for n, k in pattern.items():
                starts, each, bases = slots[n]
                starts.append(used[n])
                each.append(k)
                bases.append(base)
                used[n] += k * repeats
            base += repeats
        segments += [(profile, n, *lists) for n, lists in slots.items()]
    slots_df = spark.createDataFrame(segments, "profile string, n long, starts array<long>, each array<long>, bases array<long>")
    rows = ranked(items.where("n > 0"), ["profile", "n"], F.struct("i", "piece"))
    rows = rows.join(F.broadcast(slots_df), ["profile", "n"])  # bounded by the capacities: a row per length
    at = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    rows = rows.withColumn("at", at).withColumn("container", F.expr("bases[at - 1] + (rank - starts[at - 1]) div each[at - 1]"))
    cols = ["profile", "capacity", F.col("i").alias(ident), F.col("piece").cast("int").alias("piece"), F.col("pieces").cast("int").alias("pieces"), F.col("n").alias(size), "container"]
    return rows.select(*cols).unionByName(items.where("n = 0").withColumn("container", F.lit(0).cast("long")).select(*cols))
