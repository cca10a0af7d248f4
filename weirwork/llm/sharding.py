"""Sharding by minimax contiguous partition.

Rows with equal texts form atomic groups. Groups are ordered by a 60-bit hash of their text, so a
group's shard follows from comparing its hash with the cut points: no join carries the assignment.
The smallest feasible shard capacity is found by binary search with a greedy check over ordered
group sizes. The check runs on the driver over a summary of bounded size: hash ranges, of which
only those that can hold a cut are split further, down to single groups where needed.

Defined cases: a null text is an empty one (8 bytes). Two texts that share all 60 bits move
together. Repeated rows are rows of their own in the same shard. An empty table gives no rows.
More shards than groups leaves shards empty. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

HASH_BITS = 60
COARSE_BITS = 12
STEP_BITS = 6
FETCH_GROUPS = 300_000  # summary rows that the driver may hold for one refinement
BLOCK_ROWS = 50_000  # rows numbered by one window partition


@dataclass(frozen=True)
class Item:
    """Groups whose hash is in [lo, hi): bytes, largest group and number of groups."""

    lo: int
    hi: int
    total: int
    largest: int
    groups: int


def greedy_ends(sizes: list[int], capacity: int) -> list[int] | None:
    """Ends (exclusive) of the runs that fill each shard as far as capacity goes; None if one item is larger."""
    ends, used = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if used + size > capacity:
            ends.append(i)
            used = 0
        used += size
    if sizes:
        ends.append(len(sizes))
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which `shards` contiguous runs hold all sizes."""
    if not sizes:
        return 0
    low = max(max(sizes), -(-sum(sizes) // shards))
    high = max(low, max(sizes) + sum(sizes) // shards)
    while low < high:
        mid = (low + high) // 2
        ends = greedy_ends(sizes, mid)
        if ends is not None and len(ends) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def even_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """shards-1 cut positions: no run above capacity, each as near as possible to an even share of what is left."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    n = len(sizes)
    earliest, end = [n], n  # earliest[j]: first start from which j shards can hold the rest
    for _ in range(shards):
        start, used = end, 0
        while start > 0 and used + sizes[start - 1] <= capacity:
            start -= 1
            used += sizes[start]
        end = start
        earliest.append(end)
    import bisect

    cuts, at = [], 0
    for j in range(shards - 1):
        left = shards - j
        goal = prefix[at] + (prefix[n] - prefix[at]) / left
        k = bisect.bisect_left(prefix, goal)
        if k > at and k <= n and goal - prefix[k - 1] < prefix[min(k, n)] - goal:
            k -= 1
        last = bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        # no shard is left empty while there are groups for all
        k = min(max(k, at + 1), max(n - left + 1, at))
        k = max(min(k, last, n), earliest[left - 1], at)
        cuts.append(k)
        at = k
    return cuts


def _windows(items: list[Item], shards: int) -> tuple[int, int, list[bool]]:
    """Bounds of the best capacity, and which items can hold a cut at some capacity between them."""
    sizes = [x.total for x in items]
    total = sum(sizes)
    low = max(max(x.largest for x in items), -(-total // shards))
    high = max(low, smallest_capacity(sizes, shards))
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    import bisect

    marks = [False] * len(items)
    first, last, even = 0, 0, 0.0
    for j in range(shards - 1):
        first = max(first, bisect.bisect_right(prefix, prefix[first] + low) - 1)  # a cut is never before this boundary
        last = min(total, last + high)  # nor after these bytes
        even = total * (j + 1) / shards
        lo, hi = first, min(len(items) - 1, bisect.bisect_right(prefix, last) - 1)
        for i in range(lo, hi + 1):
            marks[i] = True
        marks[min(len(items) - 1, max(0, bisect.bisect_right(prefix, even) - 1))] = True
        if last >= total and first >= len(items):
            break
    return low, high, marks


def _summaries(groups: DataFrame, bits: int, within: list[Item] | None) -> list[Item]:
    width = 1 << (HASH_BITS - bits)
    if within is not None:
        groups = _restrict(groups, within)
    rows = (
        groups.groupBy(F.shiftright("pos", HASH_BITS - bits).alias("range"))
        .agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest"), F.count("*").alias("groups"))
        .collect()
    )
    return sorted((Item(r["range"] * width, (r["range"] + 1) * width, r["total"], r["largest"], r["groups"]) for r in rows), key=lambda x: x.lo)


def _restrict(groups: DataFrame, items: list[Item]) -> DataFrame:
    """The groups in the items, found by their upper bits: a set of values for each width of items."""
    by_width: dict[int, list[int]] = {}
    for x in items:
        shift = (x.hi - x.lo).bit_length() - 1
        by_width.setdefault(shift, []).append(x.lo >> shift)
    keep = F.lit(False)
    for shift, values in by_width.items():  # one for each step of refinement, whatever the number of shards
        keep = keep | F.shiftright("pos", shift).isin(values)
    return groups.filter(keep)


def shard_table(starts: list[int], bits: int) -> list[tuple[int, int, list[int]]]:
    """For each value of the upper `bits` bits of a hash: the shard of its least hash, and the starts of shards within."""
    shift, rows, at = HASH_BITS - bits, [], 0
    for k in range(1 << bits):
        while at < len(starts) and starts[at] <= k << shift:
            at += 1
        end = at
        while end < len(starts) and starts[end] < (k + 1) << shift:
            end += 1
        rows.append((k, at, starts[at:end]))
    return rows


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hash values at which shards 1, 2, ... begin, and the smallest feasible capacity.

    groups: pos (hash) and bytes, one row a group.
    """
    items = _summaries(groups, COARSE_BITS, None)
    if not items:
        return [1 << HASH_BITS] * (shards - 1), 0
    bits = COARSE_BITS
    while True:
        _, _, marks = _windows(items, shards)
        todo = [x for x, m in zip(items, marks, strict=True) if m and x.groups > 1]
        if not todo:
            break
        done = [x for x, m in zip(items, marks, strict=True) if not m or x.groups <= 1]
        if sum(x.groups for x in todo) <= FETCH_GROUPS:
            rows = _restrict(groups, todo).select("pos", "bytes").collect()
            fresh = [Item(r["pos"], r["pos"] + 1, r["bytes"], r["bytes"], 1) for r in rows]
        else:
            bits += STEP_BITS
            fresh = _summaries(groups, bits, todo)
        items = sorted(done + fresh, key=lambda x: x.lo)
    sizes = [x.total for x in items]
    capacity = smallest_capacity(sizes, shards)
    starts = [items[k].lo if k < len(items) else 1 << HASH_BITS for k in even_cuts(sizes, shards, capacity)]
    return starts, capacity


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row."""
    text = text_or_empty(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("pos"),
            F.monotonically_increasing_id().alias("row"),  # fixed by the cut: deals repeated rows over blocks
        )
    )
    groups = cut(rows.groupBy("pos").agg(F.sum("size").alias("bytes")))
    starts, _ = plan_cuts(groups, shards)
    bits = max(1, (4 * shards).bit_length())
    table = docs.sparkSession.createDataFrame(shard_table(starts, bits), "upper long, base int, starts array<long>")  # some eight rows a shard
    shard = F.col("base") + F.size(F.filter("starts", lambda s: s <= F.col("pos")))
    blocks = max(1, rows.count() // (shards * BLOCK_ROWS) + 1)
    known = rows.join(F.broadcast(table), F.shiftright("pos", HASH_BITS - bits) == F.col("upper"))
    placed = known.select(*rows.columns, shard.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("pos", "doc_id", "row")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
