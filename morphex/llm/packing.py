"""Filling fixed-capacity containers with whole documents.

The plan is made over lengths, not documents: best-fit takes the counts of all lengths, longest first, and puts as many
documents of a length as there are into the containers with the least sufficient space, all containers of
one content at a time. The plan's size depends on the capacity only. Documents then take the planned places by
their rank within their length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import with_positions


class Plan:
    """Places of the documents of each length: runs of consecutive ranks go to runs of consecutive containers."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.containers = capacity, 0
        #: length -> (first rank, first container) of each run, in order of rank
        self.runs: dict[int, list[tuple[int, int]]] = {}
        # remaining space -> list of (first container, how many) still alike
        space: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sizes: list[int] = []

        def put(left: int, first: int, many: int) -> None:
            if left <= 0:
                return
            if not space[left]:
                bisect.insort(sizes, left)
            space[left].append((first, many))

        for length in sorted((x for x, n in counts.items() if n > 0 and x > 0), reverse=True):
            if length > capacity:
                raise ValueError("a length exceeds the capacity")
            rank, left_over, runs = 0, counts[length], []
            while left_over:
                at = bisect.bisect_left(sizes, length)
                if at == len(sizes):
                    each = capacity // length
                    full, rest = divmod(left_over, each)
                    for many, per in ((full, each), (1 if rest else 0, rest)):
                        for _ in range(per if many else 0):
                            runs.append((rank, self.containers))
                            rank += many
                        if many:
                            put(capacity - per * length, self.containers, many)
                            self.containers += many
                    break
                room = sizes[at]
                first, many = space[room].pop()
                if not space[room]:
                    sizes.pop(at)
                take = min(many, left_over)
                runs.append((rank, first))
                rank += take
                left_over -= take
                put(room - length, first, take)
                if take < many:
                    put(room, first + take, many - take)
            self.runs[length] = runs

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first rank, first container) sorted by key = length << 40 | first rank."""
        flat = sorted((length << 40 | rank, rank, first) for length, runs in self.runs.items() for rank, first in runs)
        a = np.array(flat, np.int64).reshape(-1, 3)
        return a[:, 0], a[:, 1], a[:, 2]


def pack(items: DataFrame, capacity: int, item_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(item_id, piece, start, size, container): every item in a container of ``capacity``, whole if it fits.

    An item larger than the capacity is split into pieces of the full capacity and one rest; no other is split. Items
    of size 0 or null have no container and are left out. Containers are numbered from 0. Repeated items are packed
    each. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rows = items.select(F.col(item_id).alias("item"), F.col(size).cast("long").alias("whole")).where(F.col("whole") > 0)
    pieces = rows.select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(whole - 1) div {capacity}"))).alias("piece"), "whole")
    pieces = pieces.select("item", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity).alias("length"))
    ranked = with_positions(pieces, ["length"], ["item", "piece"])
    counts = {r.length: r.n for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    key, first_rank, first_container = Plan(counts, capacity).arrays()

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "position"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "piece", "start", "length")), pa.array(first_container[at] + rank - first_rank[at])], names=["item", "piece", "start", "length", "container"])

    schema = T.StructType([pieces.schema["item"], *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "container"))])
    out = ranked.mapInArrow(place, schema)
    return out.select(F.col("item").alias(item_id), "piece", "start", F.col("length").alias(size), "container")


def pack_report(packed: DataFrame, capacity: int, size: str = "n_tokens") -> DataFrame:
    """One row: containers, tokens, used share, and the least number of containers that could hold them."""
    total = packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens"))
    return total.select(F.lit(capacity).alias("capacity"), "containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("used"), F.ceil(F.col("tokens") / capacity).alias("least"))
