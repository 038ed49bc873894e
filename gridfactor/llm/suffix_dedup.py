"""Suffix-array deduplication of repeated byte strings: deep-shallow sorting of distributed suffixes.

Every byte covered by a `LENGTH`-byte window that also starts in a document with a smaller id goes.

Documents are dealt into cells by a hash.  In each window the k-gram with the least hash (the leftmost of
several) is its anchor; equal windows have equal anchors, so windows are dealt by anchor:

1. each cell sends the distinct anchors it has; a bucket answers which of them other documents have too;
2. each cell sends, for these, the distinct contexts (the bytes that an anchor's windows cover) with their
   smallest document; a bucket sorts all windows as suffixes of the contexts, deep-shallow: by
   symbols of eight bytes to a shallow depth, as multikey quicksort does with bytes, then blind tries for the groups that still share
   their prefix.  Equal windows lie side by side; the smallest document of each run goes back (contexts of
   one anchor count as equal by a 64-bit hash; those of an anchor with one class needn't be sorted);
3. each cell marks and removes its bytes.

A cell sends a context once however many of its documents hold it.  A passage in very many documents has
as many surroundings, hence contexts of one anchor: cells report how many they have of each anchor, and
anchors with more than `hot_contexts` in all (or in more than `hot_cells` cells) are sent window by window
instead, dealt by the window.  So an anchor brings at most `hot_contexts` contexts to a bucket, and a window
at most one from each cell, however many documents there are; the windows of such anchors, up to WIDTH for
each surrounding, are spread over all buckets.  The cells' texts are shuffled once for all three steps.

Nulls: a null text is empty, a null id counts as larger than every other.  Equal ids aren't smaller than
each other, so a repeated row keeps what its like keeps.  Texts under LENGTH bytes lose nothing.  Very
long texts are scanned in blocks that overlap.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, BASE_2, Routes, SpanHash, binary_values, bucket_of, flat, in_cells, n_cells

LENGTH, GRAM = 50, 20
WIDTH = LENGTH - GRAM + 1
BLOCK = 1 << 20
SCAN = 1 << 17  # bytes scanned at once: their arrays stay in a core's cache
SHALLOW = 16
KEY_BYTES = 5
HOT_CELLS = 4096
HOT_CONTEXTS = 1 << 14
LAST = np.iinfo(np.int64).max


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of a width, by doubling."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor, in order: first start, last start, anchor's hash, hash of the bytes from the first start to the last window's end."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    last = len(data) - LENGTH
    for a in range(0, max(0, last + 1), SCAN):
        b = min(a + SCAN, last + 1)
        part = data[a : b + LENGTH - 1]
        spans = SpanHash(part, BASE_1)
        at = np.arange(len(part) - GRAM + 1)
        grams = spans.of(at, at + GRAM)
        low = np.uint64((1 << 28) - 1)
        chosen = (_least(grams & ~low | at.astype(np.uint64), WIDTH) & low).astype(np.int64)
        first, end = np.searchsorted(offsets, [a, b - 1], side="right") + [-1, 0]  # the texts of these starts
        ends = np.repeat(offsets[first + 1 : end + 1], np.diff(np.clip(offsets[first : end + 1], a, b)))
        fits = np.arange(a + LENGTH, b + LENGTH) <= ends  # never the last start of a text, so texts lie in runs of their own
        edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (fits[1:] != fits[:-1])]))
        end = np.append(edge[1:], len(chosen)) - 1
        keep = fits[edge]
        edge, end = edge[keep], end[keep]
        other = SpanHash(part, BASE_2)
        whole = other.of(edge, end + LENGTH) ^ (chosen[edge] - edge).astype(np.uint64)
        for k, x in enumerate((edge + a, end + a, grams[chosen[edge]], whole)):
            out[k].append(x)
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds))


class Cell:
    """A cell's rows in order of id, its distinct texts (each with the smallest id that has it), and their anchors."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks().fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        raw, off = binary_values(table["b"])
        order = np.argsort(ids, kind="stable")
        self.ids, first, pieces, self.of, owner = ids[order], {}, [], [], []
        for k in order:
            text = raw[off[k] : off[k + 1]].tobytes()
            if text not in first:
                first[text] = len(pieces)
                pieces.append(text)
                owner.append(ids[k])
            self.of.append(first[text])
        self.order = order
        self.owner = np.array(owner, np.int64)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        self.lo, self.hi, self.key, self.whole = anchors(self.data, self.offsets)
        self.text = np.repeat(np.arange(len(pieces)), np.diff(np.searchsorted(self.lo, self.offsets)))

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some runs, in order: all window starts, their texts and the windows' hashes."""
        n = self.hi[runs] - self.lo[runs] + 1
        starts = flat(self.lo[runs], n)
        return starts, np.repeat(self.text[runs], n), SpanHash(self.data, BASE_1).of(starts, starts + LENGTH)

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """bucket, its distinct short keys in order, whether several texts here have each, and its distinct contexts here."""
        bucket = bucket_of(self.key, buckets)
        short = self.key & np.uint64((1 << 8 * KEY_BYTES) - 1)
        order = np.lexsort((self.whole ^ self.key, short, bucket))
        ctx = (self.whole ^ self.key)[order]
        differs = np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (short[order][1:] != short[order][:-1]) | (ctx[1:] != ctx[:-1])]) if len(order) else np.zeros(0, bool)
        bucket, short, text = bucket[order], short[order], self.text[order]
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])])) if len(order) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(text, new) != np.maximum.reduceat(text, new) if len(new) else np.zeros(0, bool)
        contexts = np.add.reduceat(differs.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[new][1:] != bucket[new][:-1]])) if len(new) else []
        for a, b in zip(cuts, [*cuts[1:], len(new)]):
            yield int(bucket[new[a]]), short[new[a:b]], several[a:b], contexts[a:b]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return Routes.table([(0, *r) for r in rows])


def _send_anchors(cell: int, table: pa.Table, buckets: int) -> pa.Table:
    out = []
    for bucket, keys, several, contexts in Cell(table).by_bucket(buckets):
        short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        many = np.flatnonzero(contexts > 1)
        head = np.array([len(keys), len(many)], np.int64)
        out.append((bucket, cell, head.tobytes() + short.tobytes() + many.astype(np.int32).tobytes() + contexts[many].astype(np.int32).tobytes() + np.packbits(several).tobytes()))
    return _rows(out)


def _shared_anchors(bucket: int, table: pa.Table, hot_cells: int, hot_contexts: int) -> pa.Table:
    """For each cell, two bits for each anchor it sent: whether several texts, here or elsewhere, have it; whether more than hot_cells cells do, or they have more than hot_contexts contexts of it."""
    cells, blobs = table["cell"].to_pylist(), table["data"].to_pylist()
    keys, flags, contexts, sizes = [], [], [], []
    for blob in blobs:
        n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8, n * KEY_BYTES, 16).reshape(n, KEY_BYTES)
        c, at = np.ones(n, np.int32), 16 + n * KEY_BYTES
        c[np.frombuffer(blob, np.int32, m, at)] = np.frombuffer(blob, np.int32, m, at + 4 * m)
        keys.append(wide.view("<u8").ravel())
        contexts.append(c)
        flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + 8 * m), count=n).astype(bool))
        sizes.append(n)
    every = np.concatenate(keys)
    order = np.argsort(every)
    same = np.concatenate([[False], every[order][1:] == every[order][:-1], [False]])
    shared = np.zeros(len(every), bool)
    shared[order] = same[1:] | same[:-1]
    shared |= np.concatenate(flags)
    head = np.flatnonzero(~same[:-1])
    hot = np.zeros(len(every), bool)
    n_cells_of = np.diff(np.append(head, len(order)))
    n_contexts = np.add.reduceat(np.concatenate(contexts)[order], head, dtype=np.int64)
    hot[order] = np.repeat((n_cells_of > hot_cells) | (n_contexts > hot_contexts), n_cells_of)
    hot &= shared  # what one text alone has needn't be sent
    bits = lambda a, b: np.packbits(shared[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes()
    ends = np.cumsum(sizes)
    return _rows([(bucket, c, bits(e - n, e)) for c, n, e in zip(cells, sizes, ends) if shared[e - n : e].any()])


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _send_contexts(cell: int, table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    c = Cell(table)
    bits = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))
    bucket = bucket_of(c.key, buckets)
    short = c.key & np.uint64((1 << 8 * KEY_BYTES) - 1)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if len(order) else np.zeros(buckets + 1, np.int64)
    out, single = [], []
    for b, keys, *_ in c.by_bucket(buckets):
        if b not in bits:
            continue
        both = np.frombuffer(bits[b], np.uint8)
        shared, hot = (np.unpackbits(x, count=len(keys)).astype(bool) for x in np.split(both, 2))
        mine = order[edges[b] : edges[b + 1]]
        at = np.searchsorted(keys, short[mine])
        single.append(mine[hot[at]])
        mine = mine[shared[at] & ~hot[at]]
        if not len(mine):
            continue
        # one context for each class; texts are in order of id, so the first run has the smallest document
        _, first, of, n = np.unique(c.whole[mine] ^ c.key[mine], return_index=True, return_inverse=True, return_counts=True)
        run = mine[first]
        last = np.zeros(len(first), np.int64)
        np.maximum.at(last, of, c.text[mine])
        size = c.hi[run] - c.lo[run] + LENGTH
        ctx = c.data[flat(c.lo[run], size)]
        out.append((b, cell, _pack(run.astype(np.int32), c.owner[c.text[run]], (last != c.text[run]), short[run], size.astype(np.int16), ctx)))
    hot_runs = np.sort(np.concatenate(single)) if single else np.zeros(0, np.int64)
    if len(hot_runs):
        starts, text, key = c.windows(hot_runs)
        key, first, of = np.unique(key, return_index=True, return_inverse=True)
        last = np.zeros(len(key), np.int64)
        np.maximum.at(last, of, text)
        bucket, start, text = bucket_of(key, buckets), starts[first], text[first]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        for part in np.split(order, cuts[1:]):
            size = np.full(len(part), LENGTH)
            out.append((int(bucket[part[0]]), cell, _pack((-start[part] - 1).astype(np.int32), c.owner[text[part]], last[part] != text[part], key[part] & np.uint64((1 << 8 * KEY_BYTES) - 1), size.astype(np.int16), c.data[flat(start[part], size)])))
    return _rows(out)


def deep_shallow(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the LENGTH-byte suffix prefixes at the starts, and for each place in it whether a new string begins there."""
    word = np.ndarray(len(buf) - 7, ">u8", buf.tobytes(), 0, (1,))
    order = np.argsort(word[starts].astype(np.uint64), kind="stable")
    first = word[starts[order]].astype(np.uint64)
    new = np.concatenate([[True], first[1:] != first[:-1]])
    for depth in range(8, SHALLOW, 8):  # multikey quicksort, a symbol of eight bytes at a time
        group = np.cumsum(new)
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        symbol = word[starts[order[open_]] + depth].astype(np.uint64)
        by = np.lexsort((symbol, group[open_]))
        order[open_] = order[open_][by]
        symbol, g = symbol[by], group[open_]
        new[open_] |= np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (g[1:] != g[:-1])])[: len(open_)]
    tails = np.lib.stride_tricks.sliding_window_view(buf[SHALLOW:], LENGTH - SHALLOW)
    # blind tries, all groups level by level: a node is where members first differ; they branch by that byte alone
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        head = np.flatnonzero(new[open_])
        size = np.diff(np.append(head, len(open_)))
        tail = tails[starts[order[open_]]]
        differ = tail != np.repeat(tail[head], size, axis=0)
        node = np.minimum.reduceat(np.where(differ.any(1), differ.argmax(1), LENGTH), head)
        branch = np.repeat(node, size) < LENGTH
        open_, tail, node, group = open_[branch], tail[branch], np.repeat(node, size)[branch], np.repeat(head, size)[branch]
        byte = tail[np.arange(len(open_)), node]
        by = np.lexsort((byte, group))
        order[open_] = order[open_][by]
        byte = byte[by]
        new[open_] |= np.concatenate([[True], (byte[1:] != byte[:-1]) | (group[1:] != group[:-1])])[: len(open_)]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone[open_]]
    return order, new


def _smallest(bucket: int, table: pa.Table) -> pa.Table:
    """For each cell: context, first and last window in it, and the smallest document that has these windows."""
    cells, blobs = table["cell"].to_pylist(), table["data"].to_pylist()
    parts = [_unpack(x, np.int32, np.int64, bool, np.uint64, np.int16, np.uint8) for x in blobs]
    cell = np.repeat(np.arange(len(cells)), [len(p[0]) for p in parts])
    run, doc, several, key, size, buf = (np.concatenate([p[k] for p in parts]) for k in range(6))
    size = size.astype(np.int64)
    at = np.cumsum(size) - size
    buf = np.concatenate([buf, np.zeros(8, np.uint8)])
    same = SpanHash(buf, BASE_2).of(at, at + size) ^ key
    order = np.lexsort((doc, same, key))
    new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    new = new_key | np.concatenate([[True], same[order][1:] != same[order][:-1]])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1  # the class of each context
    lead = order[new]  # of each class, the context with the smallest document
    group = np.cumsum(new_key)[new]
    mixed = np.bincount(group)[group] > 1  # whether its anchor has several classes
    windows = size[lead] - LENGTH + 1
    least = np.repeat(doc[lead], windows)
    base = np.cumsum(windows) - windows
    todo = np.flatnonzero(mixed)
    for part in _batches(todo, group, windows):
        starts, where = flat(at[lead[part]], windows[part]), flat(base[part], windows[part])
        by, fresh = deep_shallow(buf, starts)
        head = np.flatnonzero(fresh)
        least[where[by]] = np.repeat(np.minimum.reduceat(least[where[by]], head), np.diff(np.append(head, len(by))))
    # runs of windows with one smallest document, sent to the cells where a larger document has them
    edge = np.concatenate([[True], least[1:] != least[:-1]])
    edge[base] = True
    begin = np.flatnonzero(edge)
    owner = np.searchsorted(base, begin, side="right") - 1
    first = begin - base[owner]
    last = np.append(begin[1:], len(least)) - 1 - base[owner]
    runs = np.bincount(owner, minlength=len(lead))
    from_ = np.cumsum(runs) - runs
    take = flat(from_[kind], runs[kind])
    who = np.repeat(np.arange(len(kind)), runs[kind])
    keep = several[who] | (least[begin[take]] < doc[who])
    take, who = take[keep], who[keep]
    out = []
    for k in np.unique(cell[who]):
        m = cell[who] == k
        out.append((bucket, cells[k], _pack(run[who[m]], first[take[m]].astype(np.int16), last[take[m]].astype(np.int16), least[begin[take[m]]])))
    return _rows(out)


def _batches(todo: np.ndarray, group: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
    """Classes in batches of about BLOCK windows; those of one anchor stay together, at most HOT_CONTEXTS * WIDTH windows or half a BLOCK."""
    if not len(todo):
        return
    heads = np.flatnonzero(np.concatenate([[True], group[todo][1:] != group[todo][:-1]]))
    load = np.cumsum(np.add.reduceat(windows[todo], heads)) // BLOCK
    cuts = heads[np.flatnonzero(np.concatenate([[True], load[1:] != load[:-1]]))]
    yield from (todo[a:b] for a, b in zip(cuts, [*cuts[1:], len(todo)]))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("removed", pa.list_(pa.int64()))])


def _removed(table: pa.Table, answers: pa.Table, with_bytes: bool) -> pa.Table:
    if not table.num_rows:
        return KEPT.empty_table()
    c = Cell(table)
    steps = np.zeros(len(c.data) + 1, np.int32)
    ident = c.whole ^ c.key
    order = np.argsort(ident, kind="stable")
    ranked = ident[order]
    at, low = [], []  # windows that came alone, and their smallest documents
    for blob in answers["data"].to_pylist():
        run, first, last, least = _unpack(blob, np.int32, np.int16, np.int16, np.int64)
        alone = run < 0
        if alone.any():
            at.append(-run[alone].astype(np.int64) - 1)
            low.append(least[alone])
            run, first, last, least = run[~alone], first[~alone], last[~alone], least[~alone]
        a, b = np.searchsorted(ranked, ident[run]), np.searchsorted(ranked, ident[run], side="right")
        like = order[flat(a, b - a)]  # all runs of the class
        first, last, least = (np.repeat(x, b - a) for x in (first, last, least))
        gone = c.owner[c.text[like]] > least
        np.add.at(steps, c.lo[like[gone]] + first[gone], 1)
        np.add.at(steps, c.lo[like[gone]] + last[gone] + LENGTH, -1)
    if at:
        at, low = np.concatenate(at), np.concatenate(low)
        theirs = np.unique(c.key[np.searchsorted(c.lo, at, side="right") - 1])
        starts, text, window = c.windows(np.flatnonzero(np.isin(c.key, theirs)))
        asked = SpanHash(c.data, BASE_1).of(at, at + LENGTH)
        by = np.argsort(asked)
        place = np.minimum(np.searchsorted(asked[by], window), len(by) - 1)
        gone = (asked[by][place] == window) & (c.owner[text] > low[by][place])
        np.add.at(steps, starts[gone], 1)
        np.add.at(steps, starts[gone] + LENGTH, -1)
    cover = np.cumsum(steps[:-1]) > 0
    rows = []
    raw_ids = table["doc_id"].combine_chunks()
    for k, row in enumerate(c.order):
        j = c.of[k]
        a, b = c.offsets[j], c.offsets[j + 1]
        mark = cover[a:b] if c.ids[k] == c.owner[j] or b - a < LENGTH else np.ones(b - a, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
        kept = c.data[a:b][~mark].tobytes()
        rows.append((raw_ids[int(row)].as_py(), int(b - a), int(mark.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None, edges.tolist() if with_bytes else None))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), KEPT)], schema=KEPT)


def remove_repeats(docs: DataFrame, with_bytes: bool = True, cells: int | None = None, hot_cells: int = HOT_CELLS, hot_contexts: int = HOT_CONTEXTS, most_rows: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_bytes the bytes `kept` and the removed spans' ends `removed` (start, end, start, ...).

    Messages between cells and buckets go by Routes(cells, most_rows).
    """
    cells = cells or n_cells(docs, text_col)
    buckets, r = cells, Routes(cells, most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    rows = in_cells(rows, cells, "doc_id", "b")
    groups = rows.groupBy("cell")
    number = lambda key: key[0].as_py()

    sent = groups.applyInArrow(lambda key, t: r.sent(_send_anchors(number(key), t, buckets), "bucket"), r.SCHEMA)
    shared = r.routed(sent, "bucket").groupBy("bucket").applyInArrow(lambda key, t: r.sent(_shared_anchors(number(key), r.received(t), hot_cells, hot_contexts), "cell"), r.SCHEMA)
    contexts = groups.cogroup(r.routed(shared, "cell").groupBy("cell")).applyInArrow(lambda key, t, a: r.sent(_send_contexts(number(key), t, r.received(a), buckets), "bucket"), r.SCHEMA)
    least = r.routed(contexts, "bucket").groupBy("bucket").applyInArrow(lambda key, t: r.sent(_smallest(number(key), r.received(t)), "cell"), r.SCHEMA)
    return groups.cogroup(r.routed(least, "cell").groupBy("cell")).applyInArrow(lambda key, t, a: _removed(t, r.received(a), with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<long>")


def op5_deep_shallow(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
