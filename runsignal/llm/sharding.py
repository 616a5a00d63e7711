"""Shards on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    """``cells`` positions; every shard owns ``vnodes`` of them.  ``slack``: a shard holds at most
    (1 + slack) times its even part; with 0 the counts are at most one apart."""

    shards: int = 16
    vnodes: int = 64
    cells: int = 4096
    slack: float = 0.0

    def owners(self) -> list[tuple[int, int]]:
        """(cell, shard) of every virtual node in ring order.  A node's place depends on its shard and number
        alone, but for the rare cell that is taken already."""
        if self.shards * self.vnodes > self.cells:
            raise ValueError("more virtual nodes than cells")
        taken: dict[int, int] = {}
        for node in range(self.vnodes):
            for shard in range(self.shards):
                cell = zlib.crc32(f"shard {shard} node {node}".encode()) % self.cells
                while cell in taken:
                    cell = (cell + 1) % self.cells
                taken[cell] = shard
        return sorted(taken.items())

    def capacities(self, rows: int) -> list[int]:
        if self.slack:
            return [math.ceil((1 + self.slack) * rows / self.shards)] * self.shards
        return [rows // self.shards + (s < rows % self.shards) for s in range(self.shards)]


def plan(counts: dict[int, int], ring: Ring) -> list[list[int]]:
    """``[cell, from, to, shard, slot]``: which ranks of each cell go to which shard, from which slot on.

    Every cell first asks the next virtual node clockwise.  What its shard has no room for asks the node after
    that in the next round.  Works on row counts of the ring's cells only, whatever the number of rows.
    """
    nodes = ring.owners()
    cells = [c for c, _ in nodes]
    room, load, out = ring.capacities(sum(counts.values())), [0] * ring.shards, []
    waiting = [(bisect_left(cells, c) % len(nodes), c, 0, n) for c, n in sorted(counts.items()) if n]
    while waiting:
        rest = []
        for node, cell, at, to in sorted(waiting):
            shard = nodes[node][1]
            take = min(to - at, room[shard] - load[shard])
            if take:
                out.append([cell, at, at + take, shard, load[shard]])
                load[shard] += take
            if at + take < to:
                rest.append(((node + 1) % len(nodes), cell, at + take, to))
        waiting = rest
    return out


def sharded(docs: DataFrame, ring: Ring = Ring(), key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``keep`` columns, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    size is the UTF-8 bytes of the text plus 1, a null text has none and the checksum of the empty text.
    A key's place on the ring is a hash of it; rows with a null key are placed by their text.  Rows in one cell
    go clockwise by hash; equal rows are interchangeable.  Text itself is never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(text))
    cell = F.pmod(F.shiftrightunsigned(place, 40), F.lit(ring.cells)).cast("int")
    counts = {r["cell"]: r["n"] for r in docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # at most ring.cells rows
    ranges = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan(counts, ring))), "array<array<bigint>>")).alias("p"))
    ranges = ranges.select(F.expr("int(p[0])").alias("r_cell"), F.expr("p[1]").alias("r_from"), F.expr("p[2]").alias("r_to"), F.expr("int(p[3])").alias("shard"), F.expr("p[4]").alias("r_slot"))
    rows = docs.select(
        key, *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("r_at"), place.alias("r_place")
    )
    order = Window.partitionBy("r_at").orderBy("r_place", key, "size", "text_crc32")
    rows = rows.withColumn("r_rank", F.row_number().over(order) - F.lit(1))
    # A row for each cell and the few cuts in it: bounded by the ring.
    on = (F.col("r_at") == F.col("r_cell")) & (F.col("r_rank") >= F.col("r_from")) & (F.col("r_rank") < F.col("r_to"))
    out = rows.join(F.broadcast(ranges), on)
    return out.select(key, *keep, "size", "text_crc32", "shard", (F.col("r_slot") + F.col("r_rank") - F.col("r_from")).alias("slot"))
