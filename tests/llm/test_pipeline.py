"""The pipeline's stages, one after another, each against a plain version on its own input."""

import re
import string
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from test_operators import DOCS, brute_hits, odd_rows, plain_targets

from gridfactor.functions import storage
from gridfactor.llm.common import table

ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages(spark, sf):
    docs, seen = table(spark, sf, "documents"), {}
    extra = spark.createDataFrame([(900001, None, None, "src1", 0), (900002, "1234 5678", "en", None, 9)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, docs.collect(), out.columns)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(seen[n][2] == columns for n in list(seen)[:-1])

    before, after, _ = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {900001, 900002}

    before, after, _ = seen["ngram_jaccard"]
    shingles = {}
    for r in before:
        w = re.findall("[^\x20\x09-\x0d]+", r.text.translate(ASCII))
        shingles[r.doc_id] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    kept = {r.doc_id for r in after}
    ids = sorted(shingles)
    link = lambda a, b: 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    label = {a: a for a in ids}
    for a in ids:
        for b in ids:
            if a < b and label[a] != label[b] and link(a, b):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert kept == set(label.values())

    before, after, _ = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hits = brute_hits([((r.doc_id, r.text), r.text) for r in before], items)
    clean = Counter(key for key, *_, bad in hits.elements() if not bad)
    assert Counter((r.doc_id, r.text) for r in after) == clean and len(after) < len(before)

    before, after, _ = seen["mixing"]
    words = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r)
    for r in after:
        taken[r.source] += words(r)
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    for name, target in zip(names, plain_targets([sizes[x] for x in names], [k % 3 + 1 for k in range(len(names))])):
        assert abs(taken[name] - target) <= max(words(r) for r in before if r.source == name)
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3

    before, after, _ = seen["sharding"]
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in before) == Counter((r.doc_id, r["size"], r.text_crc32) for r in after)
    for k in range(16):
        assert sorted(r.slot for r in after if r.shard == k) == list(range(sum(r.shard == k for r in after)))
    load = Counter()
    for r in after:
        load[r.shard] += r["size"]
    assert set(load) == set(range(16)) and max(load.values()) < 2 * sum(load.values()) / 16


def test_near_duplicates_with_repeated_and_null_ids(spark, sf):
    text = lambda name, end="": " ".join(f"{name}{j}" for j in range(60)) + end
    rows = [(1, text("a")), (5, text("a", " x")), (5, text("clean")), (None, text("a", " y")), (None, text("d")), (None, text("d", " x")), (None, text("d")), (None, text("f"))]
    rows += [(9, text("e")), (9, text("e", " x")), (7, text("g")), (7, text("g")), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, (r.text or "-").split("0")[0]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert kept == {(1, "a"): 1, (5, "clean"): 1, (None, "d"): 1, (None, "f"): 1, (9, "e"): 1, (7, "g"): 1, (None, "-"): 2}


def test_language_stage_without_labels(spark, sf):
    docs = table(spark, sf, "documents").withColumn("lang", F.lit(None).cast("string"))
    extra = spark.createDataFrame([(900001, None, None, "src1", 0), (900002, "1234 5678", "en", None, 9)], docs.schema).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), sf)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect())


def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeated rows and ids, columns with clashing names; then an empty table."""
    odd = spark.createDataFrame(odd_rows(), DOCS)
    for docs in (odd, odd.limit(0)):
        start = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before = Counter(docs.collect())
            out = stage(spark, docs, sf)
            docs = spark.createDataFrame(out.collect(), out.schema)
            if name != "sharding":
                assert out.columns == start and set(docs.collect()) <= set(before)
        assert docs.count() == sum(before.values())


def test_run_leaves_stage_outputs_alone(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_root", lambda spark: f"file://{tmp_path}/ck")
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [p for p in (tmp_path / "ck").iterdir() if not p.name.startswith(".") and any(p.iterdir())]
    assert len(left) == len(corpus_pipeline.STAGES) and all((p / "_SUCCESS").exists() for p in left)
    assert storage._scratch == []


def test_one_row_many_times(spark, sf):
    """Of a row repeated 100,000 times one stays, also if its source differs (the first by source then language); no task gets all of them."""
    one = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one two three four five six").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("source"), F.lit(27).alias("n_chars"))
    other = spark.createDataFrame([(4, "seven eight nine ten eleven twelve", None, None, 3)], one.schema.simpleString()[7:-1].replace(":", " "))
    out = corpus_pipeline.near_duplicates(spark, one.unionByName(other), sf)
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.source) for r in out.collect()) == [(3, "a"), (4, None)]
