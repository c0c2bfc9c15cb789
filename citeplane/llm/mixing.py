"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words. A document of a source with ratio r = target / size of the source is taken
floor(r) times, and once more with inclusion probability r - floor(r). The cube method turns these probabilities into
decisions: it moves them along the null space of the constraints (words and number of documents, for each source)
until each of the moved ones is 0 or 1, so that both totals stay as they were. With two constraints at most two
documents stay undecided. Sources are cut into blocks by hash; what a block leaves undecided goes on to the next
round, where fewer and fewer blocks remain, and the last block of a source lands: of the roundings of its two
undecided documents, that of the words nearest to the target is taken, and then a taken document of the block changes
places with one that is not, SWAPS times at most, where that brings the words nearer; their number stays.

Defined cases: null text has size 0; null source is a source of its own and comes last; documents of size 0 count as
documents and take no words; repeated rows are separate units; equal hashes are ordered by doc_id and size; directions
come from a fixed hash, so reruns agree; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch

WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a block.
BLOCK = 4096
#: Most exchanges of the landing.
SWAPS = 4
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target of each source: share of all words by weight, at most cap times its size, the excess dealt again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    rest, open_ = share * sum(size.values()), list(weight)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total >= cap * size[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * size[s]
            open_.remove(s)
        rest -= sum(out[s] for s in over)
    return out


def flight(units: Iterable[tuple[float, float, int]]) -> Iterator[tuple[int, float]]:
    """(position, probability) of each unit (probability, size, hash), in any order, all but two of them 0 or 1.

    Three undecided units at a time: the vector orthogonal to (1, 1, 1) and to their sizes is a direction that keeps
    both totals; it is followed, one way or the other, until one of them is decided.
    """
    held: list[list] = []
    for at, (p, size, seed) in enumerate(units):
        if p <= EPS or p >= 1 - EPS:
            yield at, float(round(p))
            continue
        held.append([at, p, size, seed])
        while len(held) == 3:
            (_, p0, x0, s0), (_, p1, x1, s1), (_, p2, x2, s2) = held
            u = (x1 - x2, x2 - x0, x0 - x1)
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for q, v in zip((p0, p1, p2), u):
                if v > 0:
                    up, down = min(up, (1 - q) / v), min(down, q / v)
                elif v < 0:
                    up, down = min(up, -q / v), min(down, -(1 - q) / v)
            draw = ((s0 * 0x9E3779B97F4A7C15 + s1 * 0xD1342543DE82EF95 + s2 * 0x2545F4914F6CDD1D) >> 11 & (1 << 53) - 1) / (1 << 53)
            step = up if draw < down / (up + down) else -down
            kept = []
            for unit, v in zip(held, u):
                unit[1] = min(1.0, max(0.0, unit[1] + step * v))
                if unit[1] <= EPS or unit[1] >= 1 - EPS:
                    yield unit[0], float(round(unit[1]))
                else:
                    kept.append(unit)
            held = kept
    for at, p, _, _ in held:
        yield at, p


def landing(p: list[float], sizes: list[float]) -> list[float]:
    """The rounding of at most two undecided units that stays nearest to their words, then to their number."""
    ways: list[list[float]] = [[]]
    for _ in p:
        ways = [w + [x] for w in ways for x in (0.0, 1.0)]
    return min(ways, key=lambda w: (abs(sum((x - q) * s for x, q, s in zip(w, p, sizes))), abs(sum(w) - sum(p)), w))


def exchanged(p: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decisions p of units of probabilities before, with exchanges that bring their words nearer to what was expected."""
    p, free = p.copy(), (before > EPS) & (before < 1 - EPS)
    for _ in range(SWAPS):
        over = float(((p - before) * size).sum())
        taken, not_ = np.flatnonzero(free & (p == 1)), np.flatnonzero(free & (p == 0))
        if not len(taken) or not len(not_):
            break
        not_ = not_[np.argsort(size[not_], kind="stable")]
        want = size[taken] - over
        at = np.searchsorted(size[not_], want)
        near = np.clip(np.stack([at - 1, at]), 0, len(not_) - 1)
        miss = np.abs(size[not_][near] - want)
        which, i = np.unravel_index(int(miss.argmin()), miss.shape)
        if miss[which, i] >= abs(over) - EPS:
            break
        p[taken[i]], p[not_[near[which, i]]] = 0.0, 1.0
    return p


def _round(last: bool):
    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seed", "doc_id", "size"], kind="stable", ignore_index=True)
        before = rows["p"].to_numpy(float)
        p = before.tolist()
        for at, x in flight(zip(p, rows["size"].astype(float).tolist(), rows["seed"].tolist())):
            p[at] = x
        if last:
            left = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
            for i, x in zip(left, landing([p[i] for i in left], [float(rows["size"][i]) for i in left])):
                p[i] = x
            p = exchanged(np.round(p), before, rows["size"].to_numpy(float))
        rows["p"] = p
        return rows

    return decide


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and copies: how often the mix takes the document.

    Only ids and sizes are shuffled. The driver gets one row for each source.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    units = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = scratch.keep(units, "units")
    per = [(r["source"], r["size"], r["n"]) for r in units.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()]
    goal = targets([(s, n) for s, n, _ in per], weights, share, cap)
    known = spark.createDataFrame([(s, size, float(goal[s]), goal[s] / size if size else 0.0, max(1, math.ceil(n / block))) for s, size, n in per], "s string, source_size long, target double, ratio double, blocks int")
    seed = F.xxhash64(F.lit(20), "doc_id")
    state = units.join(F.broadcast(known) if len(per) <= 10_000 else known, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "source", "size", "source_size", "target", F.floor("ratio").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"), F.shiftrightunsigned(seed, 1).alias("seed"), "blocks", F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.col("blocks")).cast("int").alias("block"))
    most, turn, done = max((math.ceil(n / block) for _, _, n in per), default=1), 0, []
    while True:
        last = most <= 1
        state = state.groupBy("source", "block").applyInPandas(_round(last), state.schema)
        if last:
            done.append(state)
            break
        state = scratch.keep(state, f"round{turn}")
        fraction = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(state.where(~fraction))
        most, turn = min(most - 1, math.ceil(2 * most / block)), turn + 1  # fewer blocks in each round
        state = state.where(fraction).withColumn("block", F.pmod(F.xxhash64(F.lit(22 + turn), "doc_id"), F.lit(max(1, most))).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.round("p")).cast("long").alias("copies"))
