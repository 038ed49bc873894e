"""Quality rules: counts of words, symbols, repeated lines and windows, and robust outliers of their logarithms.

A document that passes the base rule (words enough, not mostly repeated) has a vector of four statistics: the
logarithms of its mean word length, its share of symbols, of repeated lines and of repeated words.  For each
language and source the minimum covariance determinant gives a centre and a covariance that outliers don't
move: of all halves or more (`share`) of the vectors, those whose covariance has the least determinant.  Documents
whose Mahalanobis distance is beyond the chi-square quantile are rejected.

Three starts without a random draw (median and absolute deviations; mean and covariance; medians with the
correlations of tanh) are concentrated at once: each step takes the `share` of a pool's vectors that are
nearest by the last estimate, all documents at each step.  A step is one grouped sum: vectors are summed by bins
of their distance, and a pool's nearest bins are added up (the last one in part, so that exactly the share is
taken); so a pool of a third of all rows is as many partial sums as any other.  Vectors are whole numbers
(1024 to the unit), so sums don't depend on the rows' order.  Statistics that are the same in most documents
would make the determinant 0: a floor is added to each variance, in the steps too.

A language and source with under `least` vectors is judged by its language, and a language with fewer by all
documents.  Documents without text, an empty text or white space alone have no words and fail the base rule.
A null language or source is a value like others.  Repeated rows and ids count as rows of their own; an empty table
gives an empty result.  Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dense, lists
from .common import binary_values, blocks, checkpointed, counted, spread_join, stored

#: What separates words, and what counts as a symbol.
SEPARATORS, SYMBOLS = b" \x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SEPARATOR, _SYMBOL = _flags(SEPARATORS), _flags(SYMBOLS)


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each distinct slice of the bytes."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    slices = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)
    return slices.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _of_block(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    """COUNTS of the texts d[o[k]:o[k + 1]], one row each; equal words, lines and windows are found by their bytes, not by hashes."""
    n, size = len(o) - 1, len(d)
    before = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    inside = ~_SEPARATOR[d]
    word_bytes = before(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = o[:-1][o[:-1] < size]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    text = np.searchsorted(o, starts, side="right") - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.bincount(text, minlength=n)
    chars, symbols = before(inside & ((d & 0xC0) != 0x80)), before(_SYMBOL[d])
    out[:, 1], out[:, 2] = chars[o[1:]] - chars[o[:-1]], symbols[o[1:]] - symbols[o[:-1]]

    breaks = d == 10
    lines = np.unique(np.concatenate([o, np.flatnonzero(breaks) + 1]))
    kept = before(~breaks)
    code = _codes(d[~breaks], kept[lines]) if len(lines) > 1 else np.zeros(0, np.int64)
    wordy = np.diff(word_bytes[lines]) > 0
    of = (np.searchsorted(o, lines[:-1], side="right") - 1)[wordy]
    first = np.unique(code[wordy] * n + of, return_index=True)[1]
    out[:, 3] = np.bincount(of, minlength=n)
    out[:, 4] = out[:, 3] - np.bincount(of[first], minlength=n)

    if len(starts) > 2:
        word = _codes(d[inside], np.append(word_bytes[starts], word_bytes[-1]))
        base = word.max() + 1
        pairs = pd.factorize(word[:-1] * base + word[1:])[0]
        at = np.flatnonzero(text[:-2] == text[2:])
        triples = pd.factorize(pairs[at] * base + word[at + 2])[0]
        windows = pd.factorize(triples * n + text[at])[0]
        again = at[np.bincount(windows)[windows] > 1] if len(at) else at
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[again + k] = True
        out[:, 5] = np.bincount(text[covered], minlength=n)
    return out


def counts_of(column, block_bytes: int = 1 << 22) -> np.ndarray:
    """COUNTS of a column of texts (null: none), by blocks of about so many bytes."""
    data, off = binary_values(column)
    parts = [_of_block(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in blocks(off, block_bytes)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


#: A vector's statistics; their unit; and the least standard deviation that each is given, as a ratio of logarithms.
UNIT, FLOORS = 1024, (0.1, 0.25, 0.4, 0.4)
P = len(FLOORS)
MOST_STEPS = 20


def statistics() -> Column:
    """ln of the mean word length, 1 + percent of symbols, 1 + tenths of repeated lines, 1 + tenths of repeated words, in 1024ths."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    logs = (ratio("word_chars", "n_words"), 1 + 100 * ratio("n_symbols", "word_chars"), 1 + 10 * ratio("n_dup_lines", "n_lines"), 1 + 10 * ratio("n_repeat_words", "n_words"))
    return F.array(*[F.round(UNIT * F.ln(F.greatest(x, F.lit(1e-9)))).cast("long") for x in logs])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, lang, source and COUNTS of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for c, n in zip(by, ("lang", "source"))], F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = counts_of(batch["text"])
                yield pa.RecordBatch.from_arrays([batch["id"], batch["lang"], batch["source"], *[pa.array(c) for c in counts.T.copy()]], ["id", "lang", "source", *COUNTS])

    return rows.mapInArrow(run, f"id {kinds['id']}, lang {kinds['lang']}, source {kinds['source']}, " + ", ".join(f"{c} long" for c in COUNTS))


def chi_square(x: float, df: int) -> float:
    """The distribution function for whole degrees of freedom."""
    value, k = (math.erf(math.sqrt(x / 2)), 1) if df % 2 else (1 - math.exp(-x / 2), 2)
    while k < df:
        value -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return value


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, df) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal vectors is multiplied by to be that of all."""
    return share / chi_square(chi_square_quantile(share, P), P + 2) if share < 1 else 1.0


def _entry(a: str, i: int, j: int | None = None) -> Column:
    return F.col(a)[i if j is None else i * P + j].cast("double")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i, P)]


def distance() -> Column:
    """The squared Mahalanobis distance of `z` from `mean`, by `inverse`."""
    off = [_entry("z", i) - _entry("mean", i) for i in range(P)]
    return F.greatest(F.lit(0.0), sum((2 if i < j else 1) * _entry("inverse", i, j) * off[i] * off[j] for i, j in _pairs()))


def _products() -> dict[str, Column]:
    """s0.. and q00..: a vector's values and their products, exact as longs."""
    z = F.col("z")
    return {f"s{i}": z[i] for i in range(P)} | {f"q{i}{j}": z[i] * z[j] for i, j in _pairs()}


def _moments(weight: Column) -> list[Column]:
    """Weighted sums of n, s0.., q00...: the number of rows, the sums of values, the sums of products."""
    names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _pairs()]]
    return [F.sum(weight * F.col(c)).alias(c) for c in names]


ESTIMATE = "pool string, start int, size long, mean array<double>, inverse array<double>, logdet double"


def _estimates(rows: DataFrame, start: Column, of) -> DataFrame:
    """ESTIMATE of rows (pool, size, ...), a row for each pool; of(batch) gives centres and covariances, to which the floors are added."""
    floor = np.diag((np.array(FLOORS) * UNIT) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mean, cov = of(batch)
                full = cov + floor
                columns = [batch["pool"], batch["start"], batch["size"], lists(mean), lists(np.linalg.inv(full).reshape(len(mean), -1)), pa.array(np.linalg.slogdet(full)[1])]
                yield pa.RecordBatch.from_arrays(columns, ["pool", "start", "size", "mean", "inverse", "logdet"])

    return rows.withColumn("start", start).mapInArrow(run, ESTIMATE)


def _mean_and_covariance(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: batch[c].to_numpy(zero_copy_only=False).astype(np.float64)
    n = column("n")
    mean = np.stack([column(f"s{i}") for i in range(P)], 1) / n[:, None]
    cov = np.zeros((len(n), P, P))
    for i, j in _pairs():
        cov[:, i, j] = cov[:, j, i] = column(f"q{i}{j}") / n - mean[:, i] * mean[:, j]
    return mean, cov


def medians(values: DataFrame) -> DataFrame:
    """(pool, dim, size, v): the middle one of v, or the lower of two, by counts of equal values."""
    w = Window.partitionBy("pool", "dim").orderBy("v")
    counts = values.groupBy("pool", "dim", "v").agg(F.count("*").alias("n"))
    running = counts.withColumns({"to": F.sum("n").over(w), "size": F.sum("n").over(Window.partitionBy("pool", "dim"))})
    return running.where("2 * to >= size").groupBy("pool", "dim").agg(F.max("size").alias("size"), F.min("v").alias("v"))


def _by_pool(values: DataFrame, name: str) -> DataFrame:
    """(pool, size, name): the values of the P dimensions as an array."""
    of = F.sort_array(F.collect_list(F.struct("dim", "v")))
    return values.groupBy("pool").agg(F.max("size").alias("size"), F.transform(of, lambda x: x["v"].cast("double")).alias(name))


def starts(fed: DataFrame) -> DataFrame:
    """Three first estimates (ESTIMATE) of each pool of fed(pool, z)."""
    away = lambda other: F.zip_with("z", other, lambda a, b: a - b)
    moments = lambda rows: rows.withColumn("n", F.lit(1)).withColumns(_products()).groupBy("pool").agg(*_moments(F.lit(1)))
    centre = counted(_by_pool(medians(fed.select("pool", F.posexplode("z").alias("dim", "v"))), "centre"))
    off = spread_join(fed, centre, "pool").select("pool", F.posexplode(F.transform(away("centre"), F.abs)).alias("dim", "v"))
    deviation = F.transform("deviation", lambda d: F.greatest(1.4826 * d, F.lit(1.0)))
    middle = counted(centre.join(_by_pool(medians(off), "deviation").drop("size").withColumn("deviation", deviation), "pool"))
    tanh = F.zip_with(away("centre"), "deviation", lambda a, d: F.round(UNIT * F.tanh(a / d)).cast("long"))

    def by_medians(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return dense(batch["centre"]), dense(batch["deviation"])[:, :, None] ** 2 * np.eye(P)

    def by_tanh(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cov, d = _mean_and_covariance(batch)[1], dense(batch["deviation"])
        own = np.sqrt(np.maximum(cov[:, range(P), range(P)], 1e-12))
        return dense(batch["centre"]), cov / (own[:, :, None] * own[:, None]) * d[:, :, None] * d[:, None]

    plain = moments(fed).withColumn("size", F.col("n"))
    bent = moments(spread_join(fed, middle, "pool").select("pool", tanh.alias("z"))).join(middle, "pool")
    found = [_estimates(middle, F.lit(0), by_medians), _estimates(plain, F.lit(1), _mean_and_covariance), _estimates(bent, F.lit(2), by_tanh)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def concentrated(fed: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """The estimates of the share of each pool's vectors that are nearest by these.

    A bin is a fortieth of a doubling of the distance; of the one that holds the last of the share, each row counts in part.
    """
    bin_ = F.floor(40 * F.log2(1 + distance())).cast("int")
    w = Window.partitionBy("pool", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = spread_join(fed, estimates.select("pool", "start", "size", "mean", "inverse"), "pool")
    binned = rows.select("pool", "start", "size", bin_.alias("bin"), "z").withColumn("n", F.lit(1)).withColumns(_products())
    sums = binned.groupBy("pool", "start", "size", "bin").agg(*_moments(F.lit(1)))
    left = F.ceil(F.lit(share) * F.col("size")) - F.coalesce(F.sum("n").over(w), F.lit(0))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("n")))
    nearest = sums.withColumn("part", part).where("part > 0").groupBy("pool", "start", "size").agg(*_moments(F.col("part")))
    factor = consistency(share)

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mean, cov = _mean_and_covariance(batch)
        return mean, cov * factor

    return _estimates(nearest, F.col("start"), of)


def minimum_determinants(fed: DataFrame, share: float) -> DataFrame:
    """(pool, mean, inverse, logdet): of each pool's starts, concentrated until no determinant falls any more, the least."""
    now = counted(starts(fed))
    for step in range(MOST_STEPS):
        new = counted(concentrated(fed, now, share))
        before = now.select(F.col("pool").alias("p"), F.col("start").alias("s"), F.col("logdet").alias("was"))
        falls = new.join(before, (F.col("pool") == F.col("p")) & (F.col("start") == F.col("s"))).agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        now = new
        if step and (falls is None or falls < 1e-6):
            break
    return now.groupBy("pool").agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("e")).select("pool", "e.*")


def pooled(passing: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Where each language and source is judged, (key, pool), and which vectors a pool has, (pool, z)."""
    sizes = passing.groupBy("key", "language").agg(F.count("*").alias("n"))
    languages = sizes.groupBy("language").agg(F.sum("n").alias("m"), F.bool_or(F.col("n") < least).alias("wanted"))
    sizes = checkpointed(sizes.join(languages, "language"))
    rare = sizes.where(F.col("m") < least).limit(1).count() > 0
    own, common = F.col("n") >= least, F.col("m") >= least
    every = F.lit("{}")
    feeds = F.array_compact(F.array(F.when(own, F.col("key")), F.when(common & F.col("wanted"), F.col("language")), F.when(F.lit(rare), every)))
    pools = counted(sizes.select("key", F.when(own, F.col("key")).when(common, F.col("language")).otherwise(every).alias("pool"), feeds.alias("feeds")))
    fed = spread_join(passing.select("key", "z"), pools.select("key", "feeds"), "key").select(F.explode("feeds").alias("pool"), "z")
    return pools.select("key", "pool"), stored(fed)


def quality_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"), least_words: int = 50, most_repeated: int = 50, share: float = 0.75, least: int = 30, tail: float = 1e-6) -> DataFrame:
    """id, lang, source, COUNTS, base_failed, distance (squared, null where base_failed), kept.

    base_failed: under `least_words`, or more than `most_repeated` percent of words in repeated windows.
    Others are kept up to the chi-square quantile of 1 - tail.
    """
    counts = text_counts(docs, id_col, text_col, by)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    json = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    rows = stored(counts.withColumns({"base_failed": failed, "key": json("lang", "source"), "language": json("lang")}).withColumn("z", F.when(~F.col("base_failed"), statistics())))
    pools, fed = pooled(rows.where("not base_failed"), least)
    best = counted(minimum_determinants(fed, share).join(pools, "pool").select("key", "mean", "inverse"))
    judged = spread_join(rows, best, "key", how="left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = F.coalesce(F.col("distance") <= chi_square_quantile(1 - tail, P), F.lit(False))
    return judged.select("id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def op13_mcd_outliers(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = quality_outliers(docs)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
