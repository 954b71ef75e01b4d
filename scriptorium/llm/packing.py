"""Filling fixed-capacity containers with items.

Method: swap-based local search. Each shard of items starts from a best-fit packing; then items are moved, or
exchanged one for one and two for one, between underfull containers wherever that raises the sum of squared
fills, until containers empty out or nothing improves. An item larger than the capacity is divided into full
containers and a rest that is packed like any other.

Shards hold about ``shard_items`` items, so no task grows with the table; a shard wastes less than a
container more than the best packing of its items needs, in practice.

Defined results: items of null, zero or negative size take part in none; equal sizes go in order of the key.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import stage_table


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of items: largest first, each into the fullest container that has room."""
    rooms = 0  # bit r is set while a container with r units of room is open
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(bins)
            bins.append([])
        bins[chosen].append(item)
        left = room - size
        if left:
            by_room.setdefault(left, []).append(chosen)
            rooms |= 1 << left
    return bins


def pairs_of(sizes: list[int]) -> dict[int, tuple[int, int]]:
    """Every sum of two of the items with two sizes that make it. Different sizes count once, and a container of capacity c
    holds fewer than (2 c) ** 0.5 of them, so its pairs are at most about c, however many items it has."""
    counts = Counter(sizes)
    kinds = sorted(counts)
    found = {x + y: (x, y) for i, x in enumerate(kinds) for y in kinds[i + 1 :]}
    return found | {2 * x: (x, x) for x in kinds if counts[x] > 1}


class Rooms:
    """Underfull containers by their room: for each room the sizes that its containers hold, and the sums of two of them,
    as bit sets with the containers of every bit."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins: dict[int, set[int]] = {}
        self.masks: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.holders: tuple[dict[tuple[int, int], set[int]], dict[tuple[int, int], set[int]]] = ({}, {})

    def change(self, number: int, sizes: list[int], room: int, add: bool) -> None:
        """Enter a container, or take it out."""
        if not sizes or not room:
            return
        here = self.bins.setdefault(room, set())
        (here.add if add else here.discard)(number)
        if not here:
            del self.bins[room]
        for mask, holders, values in zip(self.masks, self.holders, (set(sizes), pairs_of(sizes))):
            bits = mask.get(room, 0)
            for value in values:
                held = holders.setdefault((room, value), set())
                (held.add if add else held.discard)(number)
                bits = bits | 1 << value if held else bits & ~(1 << value)
            mask[room] = bits

    def best(self, mine: list[int], most: int, least: int, but: int) -> tuple[int, int, tuple[int, ...], int, int]:
        """(gain, container, sizes given, number of items taken, their sum): the change that fills another container most,
        of those with at most ``most`` room, if it gains more than ``least``."""
        found = (least, -1, (), 0, 0)
        rooms = sorted((r for r in self.bins if r <= most), reverse=True)
        ones = sorted(set(mine), reverse=True)
        twos = pairs_of(mine)
        for room in rooms:
            if room <= found[0]:
                break  # no change gains more than the room
            for gives, takes in ((1, 0), (1, 1), (2, 1), (1, 2)):
                for given in ones if gives == 1 else twos:
                    if takes == 0:
                        if found[0] < given <= room and (self.bins[room] - {but}):
                            found = (given, min(self.bins[room] - {but}), (given,), 0, 0)
                        continue
                    low = max(given - room, 1)
                    bits = self.masks[takes - 1].get(room, 0) >> low
                    while bits:
                        taken = low + (bits & -bits).bit_length() - 1
                        if given - taken <= found[0]:
                            break
                        holders = self.holders[takes - 1][room, taken] - {but}
                        if holders:
                            found = (given - taken, min(holders), (given,) if gives == 1 else twos[given], takes, taken)
                            break
                        bits &= bits - 1
        return found


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges between underfull containers, until none helps.

    The partner of an emptying container comes from an index by room, so a step costs as much as there are different
    rooms, not containers. Every change raises the sum of squared fills, so it ends; there is no cap on its rounds.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    best = -(-sum(fill) // capacity)
    count = sum(1 for b in bins if b)
    if count <= best:
        return [b for b in bins if b]
    index = Rooms(capacity)
    held = lambda b: [sizes[i] for i in bins[b]]
    for b in range(len(bins)):
        index.change(b, held(b), capacity - fill[b], True)
    improved = True
    while improved and count > best:
        improved = False
        for weak in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            while bins[weak] and count > best:
                gain, other, given, takes, taken = index.best(held(weak), capacity - fill[weak], 0, weak)
                if other < 0:
                    break
                improved = True
                for b in (weak, other):
                    index.change(b, held(b), capacity - fill[b], False)
                exchange(bins, sizes, weak, other, given, takes, taken)
                fill[weak] -= gain
                fill[other] += gain
                for b in (weak, other):
                    index.change(b, held(b), capacity - fill[b], True)
                count -= not bins[weak]
    return [b for b in bins if b]


def exchange(bins: list[list[int]], sizes: list[int], weak: int, other: int, given: tuple[int, ...], takes: int, taken: int) -> None:
    """Items of the sizes ``given`` go from ``weak`` to ``other``, and ``takes`` items of the size ``taken`` together come back."""
    back: list[int] = []
    if takes == 1:
        back = [next(i for i in bins[other] if sizes[i] == taken)]
    elif takes == 2:
        seen: dict[int, int] = {}
        for i in bins[other]:
            if taken - sizes[i] in seen:
                back = [seen[taken - sizes[i]], i]
                break
            seen.setdefault(sizes[i], i)
    for size in given:
        item = next(i for i in bins[weak] if sizes[i] == size)
        bins[weak].remove(item)
        bins[other].append(item)
    for item in back:
        bins[other].remove(item)
        bins[weak].append(item)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def fill_containers(df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2_048, shard_items: int = 25_000) -> DataFrame:
    """(container, key, part_no, first, n): every item, or its parts, with the container and the unit it begins at.

    ``container`` is the shard and a number within it, so ids stay the same when a task runs again.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = stage_table(df.where((F.col(size) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(size).cast("long").alias("size")))
    shards = max(1, -(-items.count() // shard_items))
    kind = dict(df.dtypes)[key]

    def fill(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("item", "ascending"), ("size", "ascending")])
        sizes = table.column("size").to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        whole = np.repeat(np.arange(len(sizes)), full)
        part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        packed = np.flatnonzero(rest)
        bins = pack(rest[packed].tolist(), capacity)
        row = np.concatenate([whole, packed[np.array([i for b in bins for i in b], np.int64)]])
        local = np.concatenate([np.arange(len(whole)), len(whole) + np.repeat(np.arange(len(bins)), [len(b) for b in bins])])
        split = len(whole)
        part = np.concatenate([part, full[row[split:]]])
        amount = np.concatenate([np.full(split, capacity), rest[row[split:]]])
        return pa.table(
            {
                "container": pa.array((np.int64(shard) << 32) + local),
                key: table.column("item").combine_chunks().take(pa.array(row)),
                "part_no": pa.array((part + 1).astype(np.int32)),
                "first": pa.array(part * capacity),
                "n": pa.array(amount.astype(np.int32)),
            }
        )

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    return sharded.repartition(min(shards, 20_000), "shard").groupBy("shard").applyInArrow(fill, f"container long, `{key}` {kind}, part_no int, first long, n int")
