"""Sharding by minimax contiguous partition [native: DataFrame functions only].

Groups of equal texts are atoms, put in order by a 63-bit hash, and shards are cuts of that one order.  The smallest
capacity C is found for which a greedy check fits the ordered atoms into the shards, where each shard holds at most C
or is one atom: an atom above every capacity that others need doesn't raise theirs, and the largest shard is as
small as any cuts make it.  The driver never holds the atoms: it sees sums over ranges of hashes (at most a few ten
thousand), which bound C from below (a range can be cut anywhere) and from above (a range can't be cut).  Only
ranges where a cut may lie are divided further, until both bounds meet; that capacity is exact.

Nulls: a null text counts as empty bytes (size 1) and is grouped with empty texts; null ids are kept.
Repeated rows are rows of their own, in the shard of their text; they are counted once and made again from their
number, so that one row repeated any number of times is no large group.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BITS, FIRST, STEP = 63, 12, 6
ROWS_PER_BUCKET = 1 << 14


class Range(NamedTuple):
    first: int  # the lowest hash it may have
    bits: int  # of its prefix
    size: int
    atom: bool  # whether it is one atom
    top: int  # size of its largest atom


class _Ranges:
    """Ordered ranges of hashes."""

    def __init__(self, ranges: list[Range]):
        self.ranges = sorted(ranges)
        self.ends = list(accumulate((r.size for r in self.ranges), initial=0))

    def _reach(self, at: int, cap: int) -> int:
        """The end of the largest shard of whole ranges that starts at a range."""
        end = bisect_right(self.ends, self.ends[at] + cap) - 1
        return at + 1 if end == at < len(self.ranges) and self.ranges[at].atom else end

    def whole(self, cap: int, shards: int, strict: bool = True) -> list[int] | None:
        """Ends of the greedy shards as indices of ranges, where no range is cut; None if they don't fit."""
        cuts, at = [], 0
        for _ in range(shards):
            at = self._reach(at, cap)
            cuts.append(at)
        return cuts if not strict or at == len(self.ranges) else None

    def split(self, cap: int, shards: int) -> list[int] | None:
        """Ends in bytes that no greedy shards pass, since a range of several atoms can be cut anywhere, or after its largest."""
        cuts, at = [], 0
        for _ in range(shards):
            j = bisect_right(self.ends, at + cap) - 1
            if j == len(self.ranges):
                at = self.ends[j]
            elif self.ranges[j].atom:
                at = self.ends[j + 1] if at == self.ends[j] else self.ends[j]
            else:
                at = min(self.ends[j + 1], at + max(cap, self.ranges[j].top))
            cuts.append(at)
        return cuts if at >= self.ends[-1] else None

    def least(self, fits, shards: int) -> int:
        low, high = 0, self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid, shards) is not None else (mid + 1, high)
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """The ranges, of more than one atom, in which a cut may lie if the capacity is from low to high."""
        found: set[int] = set()
        for first, last in zip(self.whole(low, shards, strict=False), self.split(high, shards)):
            found.update(range(first, min(bisect_left(self.ends, last), len(self.ranges))))
        return [j for j in sorted(found) if not self.ranges[j].atom]

    def even(self, cap: int, shards: int) -> list[int]:
        """Cuts within the capacity that are as near to equal sizes as the ranges' ends allow; atoms above it count as a shard's share."""
        last = [len(self.ranges)]
        for _ in range(shards):
            start, end = bisect_left(self.ends, self.ends[last[-1]] - cap), last[-1]
            last.append(end - 1 if start == end > 0 and self.ranges[end - 1].atom else start)
        alone = [r.size > cap for r in self.ranges]
        share = (self.ends[-1] - sum(r.size for r, a in zip(self.ranges, alone) if a)) / max(1, shards - sum(alone))
        weight = list(accumulate((share if a else r.size for r, a in zip(self.ranges, alone)), initial=0))
        cuts, at = [], 0
        for left in range(shards - 1, 0, -1):
            goal = weight[at] + (weight[-1] - weight[at]) / (left + 1)
            j = min(bisect_left(weight, goal), len(self.ranges))
            if j - 1 > at and goal - weight[j - 1] <= weight[j] - goal:
                j -= 1
            at = min(max(j, last[left], at), self._reach(at, cap))
            cuts.append(at)
        return cuts


def _prefix(bits: int) -> Column:
    return F.shiftright("u", BITS - bits)


def _ranges(groups: DataFrame, bits: Column, prefix: Column) -> list[Range]:
    found = groups.groupBy(bits.alias("bits"), prefix.alias("p")).agg(F.sum("size").alias("size"), F.max("size").alias("top"), F.min("u").alias("a"), F.max("u").alias("b"))
    return [Range(r.p << (BITS - r.bits), r.bits, r["size"], r.a == r.b, r.top) for r in found.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """groups(u, size): the first hashes of the 2nd, 3rd ... shard, and the least capacity that each shard keeps or is one atom."""
    state = _Ranges(_ranges(groups, F.lit(FIRST), _prefix(FIRST)))
    while True:
        low, high = state.least(state.split, shards), state.least(state.whole, shards)
        todo = [] if low == high else state.unsure(low, high, shards)
        if not todo:
            break
        by_bits: dict[int, list[int]] = {}
        for j in todo:
            by_bits.setdefault(state.ranges[j].bits, []).append(state.ranges[j].first >> (BITS - state.ranges[j].bits))
        where, bits = F.lit(False), F.lit(0)
        for b, prefixes in by_bits.items():
            inside = _prefix(b).isin(prefixes)
            where, bits = where | inside, F.when(inside, min(b + STEP, BITS)).otherwise(bits)
        finer = groups.where(where).withColumn("bits", bits)
        keep = [r for j, r in enumerate(state.ranges) if j not in set(todo)]
        state = _Ranges(keep + _ranges(finer, F.col("bits"), F.expr(f"shiftright(u, {BITS} - bits)")))
    cuts = [state.ranges[j].first if j < len(state.ranges) else 1 << BITS for j in state.even(high, shards)] if state.ranges else []
    return [min(c, (1 << 63) - 1) for c in cuts], high


def minimax_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", piece: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per row of docs: its id, `size` (UTF-8 bytes + 1), `text_crc32`, `shard` and its gapless `slot` in the shard.

    Rows of equal texts share a shard; the largest shard is as small as cuts of the ordered groups allow.  A row that
    comes more than `piece` times is made again by as many tasks as it has pieces.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("u"),
    )
    kinds = checkpointed(rows.groupBy("doc_id", "size", "text_crc32", "u").agg(F.count("*").alias("n")))
    groups = checkpointed(kinds.groupBy("u").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")))
    n_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cuts, _ = minimax_cuts(groups.drop("n"), n_shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("u") >= F.lit(c)).cast("int")
    buckets = max(16, -(-n_rows // (ROWS_PER_BUCKET * n_shards)))
    kinds = kinds.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "u"), F.lit(buckets)).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "u", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("nth", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"), "n")
    kept = ["doc_id", "size", "text_crc32", "shard"]
    few = placed.where(F.col("n") <= piece)
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / piece))).alias("part")
    pieces = placed.where(F.col("n") > piece).select("*", part).repartition("shard", "slot", "part")
    many = pieces.select(*kept, (F.col("slot") + F.col("part") * piece).alias("slot"), F.least(F.lit(piece), F.col("n") - F.col("part") * piece).alias("n"))
    return few.unionByName(many).select(*kept, F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)).alias("slot"))


def op10_minimax_shards(docs: DataFrame) -> DataFrame:
    return minimax_shards(docs, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
