"""Benchmark decontamination by a prefix-filtered set join [native: DataFrame functions only].

The records of the join are windows of 13 consecutive item words (a shorter item is one window); a
window is a set of 4-word shingles (fewer words: itself).  A document holds a window only if it holds
all of its shingles, so one necessary prefix token is enough: the shingle that the fewest documents
have.

1. One pass over the documents hashes the shingle at each position, in generated code, and keeps where
   they hold any shingle of the benchmark: rows of (id, text's hash, position, shingle's hash) alone.
2. These rows give the number of documents that each shingle is in, hence the order by rarity, and each
   window's prefix token.  A window with a shingle that no document has is out.
3. Places of prefix tokens alone are candidates: the window has to start at the place less the token's
   offset in the window, inside the document (positional and length bounds).
4. Documents with candidates are read again; each candidate's words are compared with the window's.

The index of benchmark shingles is counted; up to `broadcast_rows` rows (16 bytes each) it is broadcast,
beyond that the join is by shuffle of (id, position, hash) alone.

Nulls: a null text has no words.  Items without id hit words, but aren't listed.  A repeated row gets
the result of its like; rows that share an id but not their text are judged apart.  Empty tables: no
documents give no rows, no items give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, counted, lower_ascii, split_words, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 4
BROADCAST_ROWS = 1 << 20


def words(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def _places(k: int) -> Column:
    """For each position of the words w, the k words from there on (nulls behind the last)."""
    return F.arrays_zip(*[(F.slice("w", j + 1, F.size("w")) if j else F.col("w")).alias(f"w{j}") for j in range(k)])


def _shingle(k: int) -> Column:
    """The hash of the k words of a place z; null if there are fewer."""
    return F.when(F.col(f"z.w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"z.w{j}") for j in range(k)]))


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, `window` (its words joined by a space) and `len` (words in it), once each."""
    w = F.col("w")
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size(w) > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - window + 1))
    return rows.select("item_id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice(w, s, window), " "))).alias("window"), F.least(F.size(w), F.lit(window)).alias("len")).distinct()


def _matches(docs: DataFrame, index: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(doc_id, t, n_words, mark, pos, h): a row for each place where a document holds an indexed shingle, and one with `mark` for each document, whose h may be null.

    docs(doc_id, t, w): id, hash of the text, words.
    """
    rows = docs.select("doc_id", "t", F.size("w").alias("n_words"), "w")
    if not sizes:
        return rows.select("doc_id", "t", "n_words", F.lit(True).alias("mark"), F.lit(0).alias("pos"), F.lit(None).cast("bigint").alias("h"))
    rows = rows.select("doc_id", "t", "n_words", F.posexplode_outer(_places(sizes[-1])).alias("pos", "z"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if len(sizes) == 1:
        rows = rows.select("doc_id", "t", "n_words", first.alias("mark"), "pos", _shingle(sizes[0]).alias("h"))
    else:
        each = F.array(*[F.struct((first & F.lit(j == 0)).alias("mark"), "pos", _shingle(k).alias("h")) for j, k in enumerate(sizes)])
        rows = rows.select("doc_id", "t", "n_words", F.inline(each))
    if small:
        hit = F.broadcast(index.withColumnRenamed("h", "indexed"))
        return rows.join(hit, F.col("h") == F.col("indexed"), "left").where("mark OR indexed IS NOT NULL").select("doc_id", "t", "n_words", "mark", "pos", F.col("indexed").alias("h"))
    hits = rows.where("h IS NOT NULL").join(index, "h", "left_semi").select("doc_id", "t", "n_words", F.lit(False).alias("mark"), "pos", "h")
    marks = rows.where("mark").select("doc_id", "t", "n_words", "mark", "pos", F.lit(None).cast("bigint").alias("h"))
    return hits.unionByName(marks)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, `t` (xxhash64 of the text), n_words, n_hit, item_ids (sorted strings), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    windows = checkpointed(item_windows(items, window))
    sets = windows.select("window", "len").distinct().withColumn("w", F.split("window", " "))
    sizes = sorted(r.k for r in windows.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` values
    tokens = sets.select("window", "len", F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("h")).limit(0)
    for k in sizes:
        part = sets.where(F.least("len", F.lit(shingle)) == k).select("window", "len", F.posexplode(_places(k)).alias("offset", "z"))
        tokens = tokens.unionByName(part.select("window", "len", "offset", _shingle(k).alias("h")).where("h IS NOT NULL"))
    tokens = checkpointed(tokens)
    index = checkpointed(tokens.select("h").distinct())
    small = index.count() <= broadcast_rows

    text = F.col(text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    matches = stored(_matches(named.select("doc_id", "t", words(F.col("text")).alias("w")), index, sizes, small))

    places = matches.where("h IS NOT NULL")
    rarity = places.select("doc_id", "t", "h").distinct().groupBy("h").agg(F.count("*").alias("docs"))
    prefix = tokens.join(rarity, "h").groupBy("window", "len").agg(F.min(F.struct("docs", "h", "offset")).alias("p"), F.count_distinct("h").alias("have"))
    whole = tokens.groupBy("window").agg(F.count_distinct("h").alias("need"))
    prefix = prefix.join(whole, "window").where("have = need").select("window", "len", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))
    start = F.col("pos") - F.col("offset")
    candidates = places.join(prefix, "h").where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    candidates = checkpointed(candidates.select(F.col("doc_id").alias("d"), F.col("t").alias("k"), start.alias("start"), (start + F.col("len")).alias("end"), "window").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("k"))
    asked = counted(candidates.select("d", "k").distinct())
    texts = named.join(asked, same, "left_semi").select("doc_id", "t", words(F.col("text")).alias("w"))
    pairs = F.broadcast(candidates) if candidates.count() <= broadcast_rows // 8 else candidates  # with the windows' words
    held = texts.join(pairs, same).where(F.array_join(F.slice("w", F.col("start") + 1, F.col("end") - F.col("start")), " ") == F.col("window"))
    held = checkpointed(held.select("doc_id", "t", "start", "end", "window").distinct())

    spans = held.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    hit = spans.select(F.col("doc_id").alias("d1"), F.col("t").alias("t1"), covered.cast("long").alias("n_hit"))
    listed = held.select("doc_id", "t", "window").distinct().join(windows.where("item_id IS NOT NULL").select("window", "item_id"), "window")
    listed = listed.groupBy(F.col("doc_id").alias("d2"), F.col("t").alias("t2")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = matches.where("mark").select("doc_id", "t", F.col("n_words").cast("long").alias("n_words"))
    out = out.join(hit, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("t") == F.col("t1")), "left").join(listed, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select("doc_id", "t", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op7_prefix_containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
