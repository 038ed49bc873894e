"""Language identification by rank-order profiles and the out-of-place distance.

N-grams of one to three letters are taken from the lower-cased words of a text, each word padded with a
space at both ends.  A language's profile is its most frequent n-grams in order, summed by Spark over a
sample of labelled documents (at most about `fit_docs` of each language, drawn by a hash of the id).  A
document's own most frequent n-grams are compared with each profile: each adds the distance between its
two ranks, or the profile's length if the profile lacks it.  The language with the least sum wins, by
code point if several have it.

Nulls: a null text, or one without a letter, is `und` with score 0.  Null labels and null ids aren't
learned from.  Without any labelled document all predictions are `und`.  Texts are used whole, repeated
rows are kept, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (21 bits a letter) of a whole text, in order, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # a space before a letter
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    if len(points) == 2:
        return points[:0], np.zeros(0, np.int64)
    if points[1] == 32:
        points = points[1:]
    s = points != 32
    two = points[:-1] << np.uint64(21) | points[1:]
    three = two[:-1] << np.uint64(21) | points[2:]
    grams = np.concatenate([points[s], two, three[s[1:-1]]])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """At most k n-grams, the most frequent first; equal counts by n-gram."""
    if len(grams) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:k]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_profiles(docs: DataFrame, size: int = 300, fit_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Languages and their most frequent n-grams, from documents that aren't held out."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    share = {r.lang: min(1.0, fit_docs / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not share:
        return {}
    scale = 1 << 20
    limits = F.create_map(*(F.lit(x) for lang, p in sorted(share.items()) for x in (lang, int(p * scale))))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.element_at(limits, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                by.setdefault(lang, []).append(ngram_counts(text.as_py()))
            for lang, found in by.items():
                grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = grams.withColumn("nth", nth).where(F.col("nth") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang.encode(), r.nth)):  # size rows per language
        out.setdefault(r.lang, []).append(r.gram)
    return out


def guesser(profiles: dict[str, list[int]], size: int) -> Callable[[str | None], tuple[str, float]]:
    """A function from a text to its language and score."""
    langs = sorted(profiles, key=str.encode)
    grams = np.array([g for lang in langs for g in profiles[lang]], np.uint64)
    ranks = np.array([k for lang in langs for k in range(len(profiles[lang]))], np.int64)
    owner = np.array([j for j, lang in enumerate(langs) for _ in profiles[lang]], np.int64)
    table = np.unique(grams)
    rank = np.full((len(table) + 1, len(langs)), size, np.int64)  # the last row: in no profile
    rank[np.searchsorted(table, grams), owner] = ranks
    seen = rank < size

    def guess(text: str | None) -> tuple[str, float]:
        top = most_frequent(*ngram_counts(text), size)
        if not len(top) or not len(table):
            return UND, 0.0
        at = np.minimum(np.searchsorted(table, top), len(table) - 1)
        at[table[at] != top] = len(table)
        far = np.where(seen[at], np.abs(rank[at] - np.arange(len(top))[:, None]), size).sum(0)
        best = int(far.argmin())
        return langs[best], float(1 - far[best] / (size * len(top)))

    return guess


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], size: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (1 less the share of the largest distance)."""
    guess = guesser(profiles, size)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guess(text.as_py()) for text in batch["text"]]
            names, scores = [x for x, _ in found], [y for _, y in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, profiles: dict[str, list[int]], least_score: float = 0.0, size: int = 300, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language with at least this score; without profiles, those whose text has a letter."""
    guess = guesser(profiles, size) if profiles else lambda text: ("", 1.0) if len(ngram_counts(text)[0]) else (UND, 0.0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guess(text.as_py()) for text in batch[text_col]]
            yield batch.filter(pa.array([lang != UND and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op9_rank_order(docs: DataFrame) -> DataFrame:
    return predict_language(docs, fit_profiles(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
