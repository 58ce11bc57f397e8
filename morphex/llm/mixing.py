"""Mixing sources to target weights: which documents, how often, and in which order.

A mix is a sequence of blocks of BLOCK tokens. By Pfair scheduling block i of a source with share w is released
at i / w and due at (i + 1) / w; at each step the released block that is due first is taken. At every point of
the sequence each source then lags or leads its share by less than a block. A source's documents follow each
other in a fixed pseudo-random order, as many times as its share demands, and belong to the block in which they
begin. A long mix is cut into frames of about FRAME_BLOCKS blocks, in which every source has its share rounded so that
it never strays a block at a frame's end; frames are scheduled by the tasks that place documents, each on its own, so
the driver holds no schedule and across frames a source strays by less than two blocks.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import with_positions

#: Tokens of a block, whatever the size of the data, and about how many blocks a frame has.
BLOCK = 512
FRAME_BLOCKS = 20_000
#: Sources of a mix are counted out on the driver; more than this is an error.
MOST_SOURCES = 10_000


def schedule(blocks: list[int], shares: list[float]) -> list[tuple[int, int]]:
    """(source, block) in order: earliest deadline first among released blocks. Windows follow from ``shares``."""
    w = [Fraction(s).limit_denominator(10**9) for s in shares]
    total = sum(w) or Fraction(1)
    w = [x / total for x in w]
    # a float pair orders almost all cases; the source number breaks ties the same way every time
    waiting = [(0.0, s, 0) for s in range(len(blocks)) if blocks[s] and w[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[float, int, int]] = []
    order: list[tuple[int, int]] = []
    time = 0
    while waiting or ready:
        if not ready and waiting[0][0] > time:
            time = math.ceil(waiting[0][0] - 1e-9)
        while waiting and waiting[0][0] <= time + 1e-9:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((i + 1) / w[s]), s, i))
        _, s, i = heapq.heappop(ready)
        order.append((s, i))
        time += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (float(math.floor((i + 1) / w[s])), s, i + 1))
    return order


@lru_cache(maxsize=256)
def frame_places(quotas: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Place in its frame of every block of each source, with so many blocks of each."""
    places = tuple(np.zeros(q, np.int64) for q in quotas)
    for at, (s, i) in enumerate(schedule(list(quotas), [float(q) for q in quotas])):
        places[s][i] = at
    return places


@lru_cache(maxsize=4096)
def _begun(frame: int, frames: int, blocks: tuple[int, ...]) -> tuple[int, ...]:
    """Blocks of each source before ``frame``: its share rounded up or down, so that they sum to the rounded whole.

    A source with a block in every frame may be rounded either way and never falls back; the sparse ones are rounded on their own.
    """
    done = [frame * n // frames if n >= frames else (2 * frame * n + frames) // (2 * frames) for n in blocks]
    extra = (2 * frame * sum(blocks) + frames) // (2 * frames) - sum(done)
    up = sorted((s for s, n in enumerate(blocks) if n >= frames and frame * n % frames), key=lambda s: (-(frame * blocks[s] % frames), s))
    for s in up[: max(0, extra)]:
        done[s] += 1
    return tuple(done)


def slots_of(source: int, block: np.ndarray, blocks: tuple[int, ...]) -> np.ndarray:
    """Place in the whole mix of blocks of a source; ``blocks``: how many blocks each source has."""
    if not len(block):
        return np.zeros(0, np.int64)
    frames = max(1, round(sum(blocks) / FRAME_BLOCKS))
    low = max(0, int(block.min()) * frames // blocks[source] - 2)
    high = min(frames, int(block.max()) * frames // blocks[source] + 3)
    bounds = [_begun(f, frames, blocks)[source] for f in range(low, high + 1)]
    frame = low + np.searchsorted(bounds, block, side="right") - 1
    out = np.empty(len(block), np.int64)
    for f in np.unique(frame).tolist():
        before, after = _begun(f, frames, blocks), _begun(f + 1, frames, blocks)
        at = np.flatnonzero(frame == f)
        out[at] = sum(before) + frame_places(tuple(b - a for a, b in zip(before, after)))[source][block[at] - before[source]]
    return out


def plan_mix(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens wanted from each source.

    Sources without any tokens can't contribute; the shares of the others are scaled to sum to 1. Without ``total`` the
    mix is as large as it can be with every share met exactly and no source repeated beyond its cap. With ``total`` a
    source that is too small gives all it may, and the rest of the total is shared among the others by their weights.
    """
    present = {s: (w, r) for s, w, r in targets if available.get(s, 0) > 0 and w > 0 and r > 0}
    if not present:
        return {}
    most = {s: available[s] * r for s, (_, r) in present.items()}
    weight = {s: w for s, (w, _) in present.items()}
    if total is None:
        scale = sum(weight.values())
        size = min(most[s] / (weight[s] / scale) for s in present)
        return {s: min(most[s], int(size * weight[s] / scale + 0.5)) for s in present}
    want: dict[str, float] = {}
    open_, left = set(present), float(total)
    while open_:
        scale = sum(weight[s] for s in open_)
        short = [s for s in open_ if most[s] < left * weight[s] / scale]
        if not short:
            want |= {s: left * weight[s] / scale for s in open_}
            break
        for s in short:
            want[s] = most[s]
            left -= most[s]
            open_.discard(s)
    return {s: int(v + 0.5) for s, v in want.items() if v >= 0.5}


def mix(documents: DataFrame, targets: DataFrame, total: int | str | None = None, doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of every mix in ``targets`` (mix_name, source, target_share, max_repeats).

    chosen: (mix_name, slot, position, doc_id, source, repeat, n_tokens); order by slot, then position. repeat counts from 0
    and stays below max_repeats. shares: (mix_name, source, target_share, max_repeats, available_tokens, n_documents, n_tokens,
    actual_share, most_repeats). A source's last document is the one with which it comes nearest to what the plan wants, so it misses
    that by at most half a document; within the mix a source lags or leads by less than a block and a document. Documents without source or tokens are no
    candidates; ``total`` "available" stands for all tokens of the mix's sources; a source that is listed but has no documents contributes nothing and its row says so. Repeated target
    rows with different values are an error.
    """
    spark = documents.sparkSession
    goals = targets.select("mix_name", "source", "target_share", "max_repeats").where("mix_name IS NOT NULL AND source IS NOT NULL").distinct().limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} rows of targets")
    if len({(g.mix_name, g.source) for g in goals}) < len(goals):
        raise ValueError("a source has two targets in one mix")
    wanted = sorted({g.source for g in goals})
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).where(F.col("source").isin(wanted) & (F.col("n_tokens") > 0))
    placed = with_positions(rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), ["source"], ["_h", "doc_id"], size="n_tokens")
    available = {r.source: r.n for r in placed.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # at most one row per wanted source

    plans, blocks = [], {}
    for name in sorted({g.mix_name for g in goals}):
        own = sorted((g for g in goals if g.mix_name == name), key=lambda g: g.source)
        size_of_mix = sum(available.get(g.source, 0) for g in own) if total == "available" else total
        want = plan_mix(available, [(g.source, g.target_share, g.max_repeats) for g in own], size_of_mix)
        if not want:
            continue
        sources = sorted(want)
        blocks[name] = tuple(-(-want[s] // BLOCK) for s in sources)
        plans += [(name, i, s, want[s], g.max_repeats, available[s]) for i, s in enumerate(sources) for g in own if g.source == s]
    schema = "mix_name string, number int, source string, want long, max_repeats int, available long"
    plan = F.broadcast(spark.createDataFrame(plans, schema))  # at most MOST_SOURCES rows

    begins = F.col("offset") + F.col("repeat") * F.col("available")
    copies = placed.join(plan, "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1))).where((begins < F.col("want")) & ((begins == 0) | (begins * 2 + F.col("n_tokens") <= F.col("want") * 2)))
    copies = copies.select("mix_name", "source", "doc_id", "n_tokens", F.col("repeat").cast("int").alias("repeat"), begins.alias("begins"), "number")

    def slot(batches):
        for batch in batches:
            i, number = batch.column("begins").to_numpy() // BLOCK, batch.column("number").to_numpy()
            name = batch.column("mix_name").dictionary_encode()
            key = name.indices.to_numpy().astype(np.int64) << 32 | number
            out = np.zeros(len(i), np.int64)
            for k in np.unique(key).tolist():
                at = np.flatnonzero(key == k)
                out[at] = slots_of(k & 0xFFFFFFFF, i[at], blocks[name.dictionary[k >> 32].as_py()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("mix_name", "source", "doc_id", "n_tokens", "repeat", "begins")), pa.array(out)], names=["mix_name", "source", "doc_id", "n_tokens", "repeat", "position", "slot"])

    kinds = T.StructType([*(copies.schema[c] for c in ("mix_name", "source", "doc_id", "n_tokens", "repeat")), T.StructField("position", T.LongType()), T.StructField("slot", T.LongType())])
    chosen = copies.mapInArrow(slot, kinds).select("mix_name", "slot", "position", "doc_id", "source", "repeat", "n_tokens")
    used = copies.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    sums = used.groupBy("mix_name").agg(F.sum("n_tokens").alias("_all"))
    goal = spark.createDataFrame([(g.mix_name, g.source, g.target_share, g.max_repeats, available.get(g.source, 0)) for g in goals], "mix_name string, source string, target_share double, max_repeats int, available_tokens long")
    shares = goal.join(used, ["mix_name", "source"], "left").join(sums, "mix_name", "left")
    shares = shares.select(
        "mix_name", "source", "target_share", "max_repeats", "available_tokens", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_documents", "n_tokens")),
        F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce(F.col("most_repeats"), F.lit(0)).alias("most_repeats"),
    )
    return chosen, shares
