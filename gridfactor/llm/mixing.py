"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by hash into blocks of about `docs_per_block`; the block number is the
source's permuted order.  A source's target is met by whole passes over its blocks and a last partial
pass, whose one cut block is drawn document by document.  So each source has an exact number of block
draws.  A binary tree over the output shards divides these quotas: at each node the left half gets a
multivariate-hypergeometric sample of them, and the draws go to the shards in permuted order, each to
one shard.  Inside a shard, rows are ordered by a hash of shard, document and pass: a draw's `place`.

Equal rows are counted and dealt in pieces of a sixteenth of a block, each by a hash of its own, so that a row
that comes any number of times is in many blocks.  What grows with the data is grouped by (source, block); running
sums over a source's blocks go over RUN blocks at a time, so that no task holds all blocks of a source.  The driver holds one row per source
and its quota per shard, and refuses more than MOST_SOURCES sources; tables of sources are broadcast,
which that bounds.  Sizes are words `[^\\x20\\x09-\\x0D]+`.

Nulls: a null text has size 0, a null source is a source of its own (last), null ids are kept.
Documents of size 0 are taken as the passes go, for 0 words.  Repeated rows are rows of their own,
numbered by `nth`.
An empty table, or one without words, gives every row taken 0.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, counted, split_words

SEPARATORS = r"[\x20\x09-\x0D]+"
#: Blocks of a source that one running sum goes over; the most sources; the most block draws that a quota may hold.
RUN, MOST_SOURCES, MOST_DRAWS = 1024, 1 << 20, 10**9 - 1
#: Pieces of a block into which repeated rows go; pieces that a task makes at once; rows among which repeated rows are numbered at once.
PIECES, PIECES_A_TASK, CHUNK_BITS = 16, 4096, 12


def capped_targets(sizes: list[int], weights: list[int], cap: int = 3) -> list[Fraction]:
    """Shares of sum(sizes) by weight; who would get more than cap times its size stops there, and the excess goes to the others by weight."""
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), {k for k, s in enumerate(sizes) if s}
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if weights[k] * level > cap * sizes[k]}
        for k in over or open_:
            out[k] = Fraction(cap * sizes[k]) if over else weights[k] * level
        left -= sum(out[k] for k in over)
        open_ = open_ - over if over else set()
    return out


def split_quotas(counts: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """(shards, sources): a random, exact division of each source's draws; every shard gets nearly as many draws as any other."""
    out = np.zeros((shards, len(counts)), np.int64)

    def walk(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals") if have.sum() else have
        walk(lo, mid, left)
        walk(mid, hi, have - left)

    walk(0, shards, np.asarray(counts, np.int64))
    return out


def _pieces(kinds: DataFrame, piece: int) -> DataFrame:
    """Rows with a number `n` in pieces of at most `piece`: `part`, `n` of that part and `hp`, the hash by which it is dealt (`h` for the first)."""
    few = kinds.where(F.col("n") <= piece).select("*", F.lit(0).cast("long").alias("part"))
    last = F.expr(f"(n - 1) div {piece}")
    many = kinds.where(F.col("n") > piece).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {piece * PIECES_A_TASK}")))).repartition("h", "task")
    many = many.withColumn("part", F.explode(F.sequence(F.col("task") * PIECES_A_TASK, F.least(F.col("task") * PIECES_A_TASK + PIECES_A_TASK - 1, last)))).drop("task")
    many = many.withColumn("n", F.least(F.lit(piece).cast("long"), F.col("n") - F.col("part") * piece))
    return few.unionByName(many).withColumn("hp", F.when(F.col("part") == 0, F.col("h")).otherwise(F.xxhash64("h", "part")))


def _text_key(seed: int, id_col: str, text_col: str) -> list[Column]:
    """What stands for id and text: a hash, which also orders, and a checksum beside it."""
    return [F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.crc32(F.col(text_col).cast("binary")).alias("crc")]


def mix_sources(docs: DataFrame, n_shards: int = 64, docs_per_block: int = 512, cap: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, block, and `draws`, an array of (pass, shard, place) with one entry for each time that the mix takes it.

    `h` and `crc` tell texts apart; `nth` numbers the rows that agree in these, id and source.
    """
    spark = docs.sparkSession
    base = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.size(split_words(F.col(text_col), SEPARATORS)), F.lit(0)).cast("long").alias("size"),
            *_text_key(seed, id_col, text_col),
        )
        .withColumn("size", F.greatest("size", F.lit(0).cast("long")))
        .groupBy("doc_id", "source", "size", "h", "crc")
        .agg(F.count("*").alias("n"))
    )
    by_source = checkpointed(base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")))
    if by_source.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = by_source.collect()  # a row per source
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = capped_targets([r["size"] for r in found], [k % 3 + 1 for k in range(len(found))], cap)
    docs_per_block = max(docs_per_block, -(-2 * (cap + 1) * sum(r.n for r in found) // MOST_DRAWS))
    plan = []
    for k, (r, t) in enumerate(zip(found, targets)):
        passes = int(t // r["size"]) if r["size"] else 0
        plan.append([k, r.source, r["size"], float(t), max(1, -(-r.n // docs_per_block)), passes, int(round(t - passes * r["size"]))])
    kinds = "sid int, source string, source_size long, target double, n_blocks int, passes int, rest long"
    sources = spark.createDataFrame(plan, kinds)
    rows = base.withColumnRenamed("source", "s0").join(F.broadcast(sources), F.col("s0").eqNullSafe(F.col("source"))).drop("s0")
    rows = _pieces(rows, max(1, docs_per_block // PIECES)).withColumn("block", F.pmod("hp", F.col("n_blocks")).cast("int"))

    blocks = rows.groupBy("sid", "block", "n_blocks", "passes", "rest").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    blocks = checkpointed(blocks.withColumn("run", F.floor(F.col("block") / RUN)))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy("sid", "run").agg(F.sum("words").alias("words"))
    runs = runs.select("sid", "run", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy("sid", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("words").over(before), F.lit(0))).join(runs, ["sid", "run"])
    blocks = blocks.withColumn("extra", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("start") - F.col("inside")))).drop("run", "start", "inside")
    blocks = checkpointed(blocks.withColumn("kind", F.when(F.col("extra") == 0, 0).when(F.col("extra") == F.col("words"), 2).otherwise(1)))
    partial = dict(blocks.where("kind > 0").groupBy("sid").agg((F.max("block") + 1).alias("n")).collect())  # a row per source
    quotas = split_quotas([p[5] * p[4] + partial.get(p[0], 0) for p in plan], n_shards, seed)
    ends = spark.createDataFrame([(p[0], [int(x) for x in np.cumsum(quotas[:, k])]) for k, p in enumerate(plan)], "sid int, ends array<long>")
    of_draw = lambda p: F.struct(p.cast("int").alias("pass"), F.size(F.filter("ends", lambda e: e <= p.cast("long") * F.col("n_blocks") + F.col("block"))).cast("int").alias("shard"))
    blocks = blocks.join(F.broadcast(ends), "sid").select(
        "sid",
        "block",
        "kind",
        "extra",
        F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), of_draw)).otherwise(F.array().cast("array<struct<pass:int,shard:int>>")).alias("whole"),
        of_draw(F.col("passes")).alias("last"),
    )
    rows = rows.join(blocks, ["sid", "block"])
    # of the one cut block of each source, documents are taken while more than half of each fits
    inside = Window.partitionBy("sid", "block").orderBy("hp", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where("kind = 1").withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    fitting = F.expr("(2 * extra + size - 2 * start) div (2 * greatest(size, 1))")
    fitting = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least("n", fitting))).when(F.col("start") <= F.col("extra"), F.col("n")).otherwise(0)
    cut = cut.withColumn("more", fitting.cast("long")).drop("start")
    rows = rows.where("kind != 1").withColumn("more", F.when(F.col("kind") == 2, F.col("n")).otherwise(0).cast("long")).unionByName(cut)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draws = F.when(F.col("k") < F.col("more"), F.concat("whole", F.array("last"))).otherwise(F.col("whole"))
    place = lambda d: F.when(F.col("k") == 0, F.xxhash64(d["shard"], F.col("hp"), d["pass"])).otherwise(F.xxhash64(d["shard"], F.col("hp"), d["pass"], F.col("k")))
    placed = F.transform(draws, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), place(d).alias("place")))
    nth = F.col("part") * max(1, docs_per_block // PIECES) + F.col("k")
    return rows.select("doc_id", "source", "size", "source_size", "target", "block", placed.alias("draws"), "h", "crc", nth.alias("nth"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a `__key`, stored and numbered from 0 among those of their key: by chunks of rows as they lie in storage, so that no task has all rows of a key."""
    rows = checkpointed(rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__chunk", F.shiftright("__at", CHUNK_BITS))
    before = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__key", "__chunk").agg(F.count("*").alias("n")).select("__key", "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__key", "__chunk").orderBy("__at")
    return rows.withColumn("__nth", F.row_number().over(inside) - 1).join(starts, ["__key", "__chunk"]).withColumn("__nth", F.col("__start") + F.col("__nth"))


def drawn_documents(docs: DataFrame, mix: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is drawn, with `mix_shard` and `mix_place`, by which a shard's rows are to be sorted (columns of docs with these names are replaced).

    mix: mix_sources(docs, seed=seed).  Rows that agree in id, text and source are told apart by their order in storage.
    """
    mix = mix.select(F.struct("h", "crc", "doc_id", "source").alias("__key"), F.col("nth").alias("__nth"), F.col("draws").alias("__draws"))
    h, crc = _text_key(seed, id_col, text_col)
    rows = docs.withColumn("__key", F.struct(h, crc, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")))
    again = counted(mix.where("__nth = 1").select("__key"))
    once = rows.join(again, "__key", "left_anti").withColumn("__nth", F.lit(0).cast("long"))
    many = _numbered(rows.join(again, "__key", "left_semi")).select(once.columns)
    rows = once.unionByName(many).join(mix, ["__key", "__nth"]).withColumn("__d", F.explode("__draws"))
    mine = [c for c in docs.columns if c not in ("mix_shard", "mix_place")]
    return rows.select(*mine, F.col("__d.shard").alias("mix_shard"), F.col("__d.place").alias("mix_place"))


def write_mix(docs: DataFrame, mix: DataFrame, path: str, seed: int = 0) -> None:
    """Write the drawn documents as Parquet, a folder per shard, each file in shuffled order."""
    out = drawn_documents(docs, mix, seed)
    out.repartition("mix_shard", F.pmod("mix_place", F.lit(8))).sortWithinPartitions("mix_shard", "mix_place").drop("mix_place").write.partitionBy("mix_shard").parquet(path)


def op4_hypergeometric_mix(docs: DataFrame) -> DataFrame:
    """The digest columns, and each document's draws: the shard of each, and its place there, as lists in text."""
    listed = lambda name: F.array_join(F.transform("draws", lambda d: d[name].cast("string")), ",")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "block", listed("shard").alias("shards"), listed("place").alias("places"))
