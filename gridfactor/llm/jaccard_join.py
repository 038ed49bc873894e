"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A document is its set of distinct k-word shingles (64-bit hashes); two documents link if
100 * intersection >= percent * union.  Documents are dealt into cells by a hash; a cell keeps each
distinct set once.  All exchanges below are between cells and buckets of tokens.

1. A quarter of all tokens (by hash) is counted.  A set with so many tokens that no other set has that
   the rest can't reach the threshold is out: exact, whatever the sample.
2. For the sets left, all tokens are counted.  Tokens are ordered by rarity (the number of sets, in a
   byte), then hash, and are classed: in one set only, rare, frequent (in more than `frequent` sets).
3. For a level g (a power of two, from the set's size), a linked pair shares at least g + 1 tokens among
   the first p + g of each, where p is the usual prefix length.  So it shares a rare token there, or g + 1
   frequent ones, of which two fall into the same of g hash groups: rare tokens are indexed singly,
   frequent ones as 2-token combinations within their group.  Sets of sizes that could link have a level
   in common.  Sets of very few shingles link with equal sets only, so their whole set is the token.
4. Sets that share an index entry are candidates.  An entry's sets are tied to the first of them only;
   the connected families of these ties hold all links.  Each family's sets meet once, in one task, and
   are compared exactly: a hub with all others, until what is left can't link across components.
5. A family above `family_tokens` tokens is first divided: all its sets are compared with HUBS of its sets,
   in parallel.  Those that link to a hub are settled as its component; what else could link must lie, by
   the triangle inequality of the Jaccard distance, near the rim.  Rims and rest are indexed anew, once.
6. Families that are still above it are joined in blocks of half that size: each pair of blocks meets in
   one task and is compared exactly.  So there are two rounds whatever the sets are; the block join of a
   family of T tokens sends 2 * T / family_tokens copies of it.

Nulls: a null text and one without words have an empty set, which links with nothing.  A null id is kept;
it is larger than all ids.  Repeated rows are documents of their own that link with each other.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE_1, Routes, SpanHash, binary_values, blocks, bucket_of, checkpointed, counted, flat, in_cells, mix, n_cells, stored, u64
from .components import components

SAMPLE = 4
LAST = np.iinfo(np.int64).max
KEY_BYTES = 5
EXACT = 96
HUBS = 32
#: Lower case of A-Z, and the bytes that separate words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MULTIPLIERS = (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, as sorted hashes; of fewer words, the whole sequence."""
    data = LOWER[raw]
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~space
    start = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], space[:-1]]))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1 if len(data) else start
    h = SpanHash(data, BASE_1).of(start, end)
    first = np.searchsorted(start, offsets)  # of each text, its first word
    n = len(h) - k + 1
    if n > 0:
        every = np.zeros(n, np.uint64)
        for j in range(k):
            every = mix(every * u64(MULTIPLIERS[j % 5]) + h[j : j + n])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            s = np.array([b - a], np.uint64)
            for x in h[a:b]:
                s = mix(s * u64(MULTIPLIERS[4]) + x)
            out.append(s)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return bucket_of(hashes, buckets), hashes & np.uint64((1 << 8 * KEY_BYTES) - 1)


class Cell:
    """A cell's documents, its distinct sets (each with the smallest id), and all their tokens."""

    def __init__(self, table: pa.Table, k: int):
        self.ids = table["doc_id"].combine_chunks().fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        raw, off = binary_values(table["b"])
        order = np.argsort(self.ids, kind="stable")
        seen: dict[bytes, int] = {}
        self.of = np.zeros(len(self.ids), np.int64)
        self.sets: list[np.ndarray] = []
        owner = []
        found = []
        for a, b in blocks(off, 1 << 20):
            found += shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
        for row in order:
            s = found[row]
            name = s.tobytes()
            if name not in seen or not name:
                seen[name] = len(self.sets)
                self.sets.append(s)
                owner.append(self.ids[row])
            self.of[row] = seen[name]
        self.owner = np.array(owner, np.int64)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)

    def tokens(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of some sets, one after another, and where each set's begin (and the end)."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[which])])
        return (np.concatenate([self.sets[j] for j in which]) if len(which) else np.zeros(0, np.uint64)), ends


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """bucket, the indices of its hashes in the order of their short keys."""
    bucket, short = _split(hashes, buckets)
    order = np.lexsort((short, bucket))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _send_counts(kind: int, cell: int, tokens: np.ndarray, buckets: int) -> list[tuple]:
    """Distinct tokens by bucket, each with the number of sets here that have it."""
    distinct, n = np.unique(tokens, return_counts=True)
    out = []
    for bucket, at in _by_bucket(distinct, buckets):
        short = _split(distinct[at], buckets)[1].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        many = np.flatnonzero(n[at] > 1)
        head = np.array([len(at), len(many)], np.int64)
        out.append((kind, bucket, cell, head.tobytes() + short.tobytes() + many.astype(np.int32).tobytes() + n[at][many].astype(np.int32).tobytes()))
    return out


def _answer_counts(bucket: int, table: pa.Table) -> pa.Table:
    """For each cell, a byte for each token it sent: its rarity()."""
    cells, blobs, kinds = table["cell"].to_pylist(), table["data"].to_pylist(), table["kind"].to_pylist()
    keys, counts, sizes = [], [], []
    for blob in blobs:
        n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8, n * KEY_BYTES, 16).reshape(n, KEY_BYTES)
        c, at = np.ones(n, np.int64), 16 + n * KEY_BYTES
        c[np.frombuffer(blob, np.int32, m, at)] = np.frombuffer(blob, np.int32, m, at + 4 * m)
        keys.append(wide.view("<u8").ravel())
        counts.append(c)
        sizes.append(n)
    every, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    head = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    total = np.zeros(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(count[order], head), np.diff(np.append(head, len(order))))
    out, ends = [], np.cumsum(sizes)
    for kind, c, n, e in zip(kinds, cells, sizes, ends):
        out.append((kind, bucket, c, rarity(total[e - n : e]).tobytes()))
    return Routes.table(out)


def rarity(sets: np.ndarray) -> np.ndarray:
    """The number of sets that have a token, in a byte: exact up to EXACT, then eight steps for each doubling."""
    beyond = EXACT + np.floor(8 * np.log2(np.maximum(sets, 1) / EXACT)) + 1
    return np.where(sets <= EXACT, sets, np.minimum(beyond, 255)).astype(np.uint8)


def _rarities(distinct: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """rarity() of each distinct token; 1 is a token of one set alone."""
    out = np.zeros(len(distinct), np.uint8)
    for bucket, at in _by_bucket(distinct, buckets):
        out[at] = np.frombuffer(answers[bucket], np.uint8)
    return out


def _alive(cell: Cell, answers: dict[int, bytes], buckets: int, percent: int) -> np.ndarray:
    """The sets that may still link: those with few enough sampled tokens of their own."""
    which = np.flatnonzero(cell.sizes > 0)
    tokens, ends = cell.tokens(which)
    picked = tokens % np.uint64(SAMPLE) == 0
    distinct, of = np.unique(tokens[picked], return_inverse=True)
    own = np.zeros(len(tokens) + 1, np.int64)
    own[1:][picked] = _rarities(distinct, answers, buckets)[of] == 1
    own = np.cumsum(own)
    n = cell.sizes[which]
    return which[own[ends[1:]] - own[ends[:-1]] <= n - -(-percent * n // 100)]


def _level(n: int, percent: int) -> int:
    p = n - -(-percent * n // 100) + 1
    return 1 << (p - 1).bit_length()


def whole_only(n: int, percent: int) -> bool:
    """Whether a set is so small that it can link with equal sets only."""
    return n * (100 - percent) < percent


def _entries(tokens: np.ndarray, rare: np.ndarray, frequent: int, percent: int, n: int) -> np.ndarray:
    """Index entries of one set of n tokens, given those and at least all others' shared ones: rare tokens singly, pairs of frequent ones."""
    if whole_only(n, percent):
        return mix(np.array([np.bitwise_xor.reduce(mix(tokens)) + u64(n)], np.uint64))
    p = n - -(-percent * n // 100) + 1
    levels = sorted({_level(n, percent), _level(n * 100 // percent, percent)})
    tokens, rare = tokens[rare > 1], rare[rare > 1]
    order = np.lexsort((tokens, rare))
    tokens, rare = tokens[order], rare[order]
    own = n - len(tokens)  # the first in order
    few, heavy = tokens[rare <= frequent], tokens[rare > frequent]
    out = [few[: max(0, p + levels[-1] - own)]]
    for g in levels:
        have = heavy[: max(0, p + g - own - len(few))]
        if len(have) > 1:
            group = (have >> np.uint64(17)) & np.uint64(g - 1)
            order = np.argsort(group, kind="stable")
            have, group = have[order], group[order]
            step = 1
            while step < len(have):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                out.append(mix(have[step:][same] * u64(MULTIPLIERS[0]) ^ mix(have[:-step][same] + u64(g))))
                step += 1
    return np.concatenate(out)


def _first_ties(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, each with the least ref that has it; and ties (least ref, other ref), each once."""
    order = np.lexsort((refs, keys))
    keys, refs = keys[order], refs[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    lead = np.repeat(refs[head], np.diff(np.append(head, len(keys))))
    ties = np.unique(np.stack([lead, refs], 1)[lead != refs], axis=0)
    return keys[head], refs[head], ties[:, 0], ties[:, 1]


def _packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _ties(table: pa.Table) -> pa.Table:
    """All ties of a bucket of index entries."""
    parts = [_unpacked(x, np.uint64, np.int64, np.int64, np.int64) for x in table["data"].to_pylist()]
    keys, refs, a, b = (np.concatenate([p[k] for p in parts]) for k in range(4))
    _, _, c, d = _first_ties(keys, refs)
    ties = np.unique(np.stack([np.concatenate([a, c]), np.concatenate([b, d])], 1), axis=0)
    return pa.table({"a": ties[:, 0].copy(), "b": ties[:, 1].copy()})


FOUND = "kind int, bucket int, ref long, doc_id long, owner long, n long, data binary"


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 7
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "bucket", "ref", "doc_id", "owner", "n", "data"])


def _post(entries: list[np.ndarray], refs: list[int], buckets: int) -> list[tuple]:
    """Index entries of one task by bucket, each once, with the ties inside the task."""
    if not entries:
        return []
    keys, first, a, b = _first_ties(np.concatenate(entries), np.repeat(np.array(refs, np.int64), [len(x) for x in entries]))
    out, none = [], np.zeros(0, np.int64)
    for bucket, at in _by_bucket(keys, buckets):
        out.append((1, bucket, None, None, None, None, _packed(keys[at], first[at], none, none)))
    if len(a):
        out.append((1, int(a[0]) % buckets, None, None, None, None, _packed(none.astype(np.uint64), none, a, b)))
    return out


def _index(cell_no: int, table: pa.Table, answers: pa.Table, k: int, buckets: int, percent: int, frequent: int) -> pa.Table:
    """Kind 0: a row for each document; 1: index entries; 2: sets that have entries, without tokens of their own."""
    if not table.num_rows:
        return _found([])
    cell = Cell(table, k)
    given: tuple[dict, dict] = ({}, {})
    for kind, bucket, data in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["data"].to_pylist()):
        given[kind][bucket] = data
    which = _alive(cell, given[0], buckets, percent)
    tokens, ends = cell.tokens(which)
    distinct, of = np.unique(tokens, return_inverse=True)
    rare = _rarities(distinct, given[1], buckets)[of]
    base = cell_no << 32
    raw_ids = table["doc_id"].combine_chunks()
    rows = [(0, None, base + int(j), raw_ids[r].as_py(), int(cell.owner[j]), int(cell.sizes[j]), None) for r, j in enumerate(cell.of)]
    entries, refs = [], []
    for j, a, b in zip(which, ends[:-1], ends[1:]):
        got = _entries(tokens[a:b], rare[a:b], frequent, percent, int(b - a))
        if len(got):
            entries.append(got)
            refs.append(base + int(j))
            rows.append((2, None, base + int(j), None, int(cell.owner[j]), int(b - a), (tokens[a:b] if whole_only(int(b - a), percent) else tokens[a:b][rare[a:b] > 1]).tobytes()))
    return _found(rows + _post(entries, refs, max(1, buckets // 8)))


def link_components(sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Exact components of a family: n are the full sizes, sets hold at least all tokens that two sets share.

    A hub is compared with the sets that share a token with it in both prefixes (tokens in order of the sets
    that have them, those of no other set first).  Every set outside the largest component becomes a hub, so
    each pair of different components that could link is compared.
    """
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    count = np.bincount(tokens)
    order = np.lexsort((tokens, count[tokens], owner))
    tokens = tokens[order]  # rare ones first, set by set
    prefix = np.clip(n - -(-percent * n // 100) + 1 - (n - sizes), 0, sizes)  # less the tokens that no other set has
    inside = np.arange(len(tokens)) - starts[owner] < prefix[owner]
    listed, holder = tokens[inside], owner[inside]
    by = np.argsort(listed, kind="stable")
    holder, n_holders = holder[by], np.bincount(listed, minlength=len(count))
    first = np.cumsum(n_holders) - n_holders
    asked, mine = np.zeros(len(sets), bool), np.zeros(len(count), bool)
    members, parent = np.ones(len(sets), np.int64), list(range(len(sets)))  # members of each root

    def find(j: int) -> int:
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        return j

    order, largest = np.argsort(-sizes, kind="stable"), int(np.argmax(sizes))
    todo = order[:1]
    while len(todo):
        for j in todo:
            if asked[j] or (find(j) == find(largest) and asked.any()):
                continue
            asked[j] = True
            own = tokens[starts[j] : starts[j + 1]]
            near = own[: prefix[j]]
            other = np.unique(holder[flat(first[near], n_holders[near])])
            other = other[other != j]
            if not len(other):
                continue
            mine[own] = True
            ends = np.cumsum(sizes[other])
            both = np.add.reduceat(mine[tokens[flat(starts[other], sizes[other])]].astype(np.int64), ends - sizes[other])
            mine[own] = False
            for k in other[100 * both >= percent * (n[other] + n[j] - both)]:
                a, b = sorted((find(int(k)), find(int(j))))
                if a != b:
                    parent[b] = a
                    members[a] += members[b]
            if members[find(j)] > members[find(largest)]:
                largest = find(j)
        root = np.array([find(j) for j in range(len(sets))])
        todo = order[~asked[order] & (root[order] != find(largest))]
    return np.array([find(j) for j in range(len(sets))])


def _cluster(table: pa.Table, percent: int) -> pa.Table:
    """The component of each set of a family, by its smallest ref."""
    refs = table["ref"].to_numpy()
    label = link_components([np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()], table["n"].to_numpy(), percent)
    least = np.full(len(refs), LAST)
    np.minimum.at(least, label, refs)
    return pa.table({"ref": refs, "component": least[label]})


def indexed_sets(docs: DataFrame, k: int, percent: int, frequent: int, cells: int, most_rows: int, id_col: str, text_col: str) -> DataFrame:
    """Steps 1 to 3, stored, so that the shuffled texts can be dropped: rows of _index()."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    groups, r = in_cells(rows, cells, "doc_id", "b").groupBy("cell"), Routes(cells, most_rows)

    def sample(key, t):
        cell = Cell(t, k)
        tokens, _ = cell.tokens(np.flatnonzero(cell.sizes > 0))
        return r.sent(Routes.table(_send_counts(0, key[0].as_py(), tokens[tokens % np.uint64(SAMPLE) == 0], cells)), "bucket")

    def count(key, t, answers):
        cell, answers = Cell(t, k), r.received(answers)
        given = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))
        return r.sent(Routes.table(_send_counts(1, key[0].as_py(), cell.tokens(_alive(cell, given, cells, percent))[0], cells)), "bucket")

    def answer(df):
        counted_ = r.routed(df, "bucket").groupBy("bucket").applyInArrow(lambda key, t: r.sent(_answer_counts(key[0].as_py(), r.received(t)), "cell"), r.SCHEMA)
        return r.routed(counted_, "cell")

    first = answer(groups.applyInArrow(sample, r.SCHEMA))
    second = answer(groups.cogroup(first.groupBy("cell")).applyInArrow(count, r.SCHEMA))
    both = first.unionByName(second)
    return stored(groups.cogroup(both.groupBy("cell")).applyInArrow(lambda key, t, a: _index(key[0].as_py(), t, r.received(a), k, cells, percent, frequent), FOUND))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, frequent: int = 16, family_tokens: int = 1 << 22, cells: int | None = None, most_rows: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links).  percent is 80 to 99: below, small sets could share too few tokens for the prefixes."""
    if not 80 <= percent < 100:
        raise ValueError("percent has to be from 80 to 99")
    found = indexed_sets(docs, k, percent, frequent, cells or n_cells(docs, text_col), most_rows, id_col, text_col)
    ties = found.where("kind = 1").groupBy("bucket").applyInArrow(lambda key, t: _ties(t), "a long, b long")
    sets = found.where("kind = 2").select("ref", "owner", "n", "data")
    links = checkpointed(linked_components(sets.drop("owner"), ties, percent, frequent, family_tokens))
    least = links.join(sets.select("ref", "owner"), "ref").groupBy("component").agg(F.min("owner").alias("least"))
    links = links.join(least, "component").select("ref", "least")
    out = found.where("kind = 0").select("ref", "doc_id", "owner", "n").join(links, "ref", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif(F.coalesce("least", "owner"), F.lit(int(LAST))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def linked_components(sets: DataFrame, ties: DataFrame, percent: int, frequent: int, family_tokens: int) -> DataFrame:
    """sets(ref, n, data) and ties(a, b) that connect all that could link: (ref, component), the component's least ref."""
    small, large = _families(sets, ties, percent, family_tokens)
    return small if large is None else small.unionByName(_divided(large, percent, frequent, family_tokens))


def _families(sets: DataFrame, ties: DataFrame, percent: int, family_tokens: int) -> tuple[DataFrame, DataFrame | None]:
    """(ref, component) in families up to family_tokens; the sets of larger ones, with the `family` and its number of `blocks`."""
    families = counted(components(ties).select(F.col("node").alias("ref"), F.col("root").alias("family")))
    sets = sets.join(families, "ref")
    sizes = checkpointed(sets.groupBy("family").agg(F.sum(F.octet_length("data") / 8).alias("tokens"), F.count("*").alias("members")))
    blocks = F.least(F.ceil(2 * F.col("tokens") / family_tokens), "members").cast("int").alias("blocks")
    large = sizes.where(F.col("tokens") > family_tokens).select("family", blocks)
    if large.isEmpty():
        return sets.groupBy("family").applyInArrow(lambda key, t: _cluster(t, percent), "ref long, component long"), None
    small = sets.join(large, "family", "left_anti").groupBy("family").applyInArrow(lambda key, t: _cluster(t, percent), "ref long, component long")
    return small, sets.join(large, "family")


def _against_hubs(table: pa.Table, percent: int) -> pa.Table:
    """A part of a family and its hubs (kind 1): the links of sets to hubs with their distances, and for each hub, without a ref, the least distance of the others."""
    refs, n, data = table["ref"].to_numpy(), table["n"].to_numpy(), table["data"].to_pylist()
    is_hub = np.array(table["kind"].to_pylist()) == 1
    hubs, sets = np.flatnonzero(is_hub), np.flatnonzero(~is_hub)
    tokens = np.concatenate([np.frombuffer(data[j], np.uint64) for j in hubs])
    holder = np.repeat(np.arange(len(hubs)), [len(data[j]) // 8 for j in hubs])
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    out, nearest = [(refs[:0], refs[:0], np.zeros(0))], np.full(len(hubs), 2.0)
    for j in sets:
        own = np.frombuffer(data[j], np.uint64)
        a, b = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        both = np.bincount(holder[flat(a, b - a)], minlength=len(hubs))
        both[refs[hubs] == refs[j]] = n[j]  # tokens that no other set has are left out
        union = n[j] + n[hubs] - both
        core, far = 100 * both >= percent * union, 1 - both / union
        out.append((refs[hubs[core]], np.full(int(core.sum()), refs[j]), far[core]))
        nearest = np.where(core, nearest, np.minimum(nearest, far))
    hub, ref, far = (np.concatenate([x[k] for x in out]) for k in range(3))
    ref = pa.concat_arrays([pa.array(ref, pa.int64()), pa.nulls(len(hubs), pa.int64())])
    return pa.table({"hub": np.concatenate([hub, refs[hubs]]), "ref": ref, "far": np.concatenate([far, nearest])})


def _divided(sets: DataFrame, percent: int, frequent: int, family_tokens: int) -> DataFrame:
    """Large families: all sets against HUBS hubs of each; then the cores' rims and the rest by an index of their own, and in blocks what it leaves together."""
    nth = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("ref"), "ref"))
    hubs = checkpointed(sets.select("family", "ref", "blocks").withColumn("nth", nth).where(F.col("nth") <= HUBS).select("family", "ref", "blocks"))
    # parts of a family, each with all hubs
    part = F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int").alias("part")
    parts = sets.select("family", part, "ref", "n", "data", F.lit(0).alias("kind"))
    sent = hubs.join(sets.select("ref", "n", "data"), "ref").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "ref", "n", "data", F.lit(1).alias("kind"))
    seen = parts.unionByName(sent).groupBy("family", "part").applyInArrow(lambda key, t: _against_hubs(t, percent), "hub long, ref long, far double")
    seen = stored(seen)
    core = seen.where("ref IS NOT NULL")
    # a set needs no further comparison if for one hub that it links to, all sets that don't are too far off
    nearest = seen.where("ref IS NULL").groupBy("hub").agg(F.min("far").alias("nearest"))
    settled = core.join(nearest, "hub").where(F.col("far") < F.col("nearest") - ((100 - percent) / 100 + 1e-9)).select("ref").distinct()
    again = stored(sets.select("ref", "n", "data").join(settled, "ref", "left_anti"))
    small, large = _families(again, _ties_of(again, percent, frequent), percent, family_tokens)
    outer = small if large is None else small.unionByName(_blocks(large, percent))
    # what links to a hub is one component; rim sets connect it with what they link to
    ties = core.select(F.col("hub").alias("a"), F.col("ref").alias("b")).unionByName(outer.select(F.col("component").alias("a"), F.col("ref").alias("b")))
    roots = components(ties)
    mine = sets.select("ref")
    return mine.join(roots, mine["ref"] == roots["node"], "left").select("ref", F.coalesce("root", "ref").alias("component"))


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of each family's sets, by pairs of its blocks: ties (ref, component)."""
    block = F.pmod(F.xxhash64("ref", F.lit(1)), F.col("blocks")).cast("int")
    other = F.explode(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))).alias("other")
    pairs = sets.withColumn("block", block).select("family", "ref", "n", "data", "block", other)
    pairs = pairs.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "ref", "n", "data")
    return pairs.groupBy("family", "low", "high").applyInArrow(lambda key, t: _cluster(t, percent), "ref long, component long")


def _ties_of(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """Ties among some sets(ref, n, data) by their index entries; tokens are counted among these sets."""

    def unnest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, data in zip(batch["ref"].to_pylist(), batch["data"].to_pylist()):
                tokens = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), ref)), pa.array(tokens)], ["ref", "token"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, n, tokens, kinds in zip(*(batch[c].to_pylist() for c in ("ref", "n", "tokens", "kinds"))):
                t = np.array(tokens, np.int64).view(np.uint64)
                by = np.argsort(t)
                keys = _entries(t[by], np.array(kinds)[by], frequent, percent, n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), ref)), pa.array(keys)], ["ref", "key"])

    rows = stored(sets.mapInArrow(unnest, "ref long, token long"))
    kinds = rows.groupBy("token").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("kind"))
    lists = rows.join(kinds, "token").groupBy("ref").agg(F.collect_list("token").alias("tokens"), F.collect_list("kind").alias("kinds"))
    keys = stored(lists.join(sets.select("ref", "n"), "ref").mapInArrow(entries, "ref long, key long"))
    first = keys.groupBy("key").agg(F.min("ref").alias("a"))
    return keys.join(first, "key").select("a", F.col("ref").alias("b")).where("a <> b").distinct()


def op2_combination_prefix(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
