"""Quality rules: counts against plain code, robust estimates against all steps of plain code."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridfactor.llm import quality_outliers as q
from gridfactor.llm.common import table


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)]


ODD = ["", None, "a", "a a a a", " \n", "\n\n", "a b\na b\n", "x y z x y z", "  lead\n lead\nlead\r\nlead", "é è é è é è", "\na\n\na", "a\x0bb\x0cc\x85d e", "#*$ %&|<>", "ab c\nab c", "日本 語　x", "w " * 5000, "x" * 9000 + "\n" + "x" * 9000]


@pytest.mark.parametrize("block", [1, 40, 1 << 22])
def test_counts(block):
    assert q.counts_of(pa.array(ODD), block).tolist() == [brute_counts(t) for t in ODD]
    assert q.counts_of(pa.array([], pa.string()), block).shape == (0, 6)


def test_counts_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.op13_mcd_outliers(docs).collect():
        want = brute_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [*want[:3], *want[4:]]
        assert r.base_failed == (want[0] < 50 or 100 * want[5] > 50 * want[0]) and not (r.kept and r.base_failed)


def brute_determinant(z, share, tries=60):
    """The least log determinant of plain concentration steps from random starts."""
    floor, h = np.diag((np.array(q.FLOORS) * q.UNIT) ** 2), int(np.ceil(share * len(z)))
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(tries):
        of = z[rng.choice(len(z), 8, replace=False)]
        for _ in range(50):
            cov = np.cov(of.T, bias=True) * q.consistency(share) + floor
            d = ((z - of.mean(0)) @ np.linalg.inv(cov) * (z - of.mean(0))).sum(1)
            of = z[np.argsort(d, kind="stable")[:h]]
        best = min(best, np.linalg.slogdet(np.cov(of.T, bias=True) * q.consistency(share) + floor)[1])
    return best


def test_minimum_determinants(spark):
    """As small as by plain code from many random starts, in pools with a fifth of outliers."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for pool, n in (("a", 300), ("b", 41)):
        z = np.rint(rng.normal(size=(n, q.P)) @ rng.normal(size=(q.P, q.P)) * 400 + 1000).astype(int)
        z[: n // 5] += [3000, 2500, 0, 4000]
        rows += [(pool, v.tolist()) for v in z]
        want[pool] = brute_determinant(z.astype(float), 0.75)
    fed = spark.createDataFrame(rows, "pool string, z array<long>").repartition(6)
    got = {r.pool: r for r in q.minimum_determinants(fed, 0.75).collect()}
    for pool, least in want.items():
        assert got[pool].logdet <= least + 0.02
        assert abs(np.array(got[pool]["mean"]) - 1000).max() < 400  # the outliers don't move it


def test_chi_square():
    assert q.chi_square(3.841459, 1) == pytest.approx(0.95, abs=1e-6) and q.chi_square(9.487729, 4) == pytest.approx(0.95, abs=1e-6)
    assert q.chi_square_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)


def planted(spark, salt=0):
    """Prose of one source, and documents of symbols in it; another source with few documents; odd rows."""
    rng = np.random.default_rng(salt)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(60, 200)))
    junk = lambda: " ".join("#$%&|*"[k % 6] * 3 + word() for k in range(80))
    rows = [(k, prose(), "en", "s1") for k in range(80)] + [(100 + k, junk(), "en", "s1") for k in range(12)]
    rows += [(200 + k, prose(), "en", "s2") for k in range(5)] + [(210, junk(), "en", "s2"), (220, prose(), None, None), (221, junk(), "xx", None)]
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, "few words", "en", "s1"), (303, "one two three " * 40, "en", "s1"), (None, rows[0][1], "en", "s1"), (1, rows[1][1], "en", "s1")]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, distance double")


@pytest.mark.parametrize("rows", [None, 0])
def test_outliers_are_rejected(spark, rows, monkeypatch):
    if rows is not None:
        monkeypatch.setattr("gridfactor.llm.common.BROADCAST_ROWS", rows)
    got = q.op13_mcd_outliers(planted(spark).repartition(4)).collect()
    assert len(got) == 106
    for r in got:
        junk = r.doc_id is not None and (100 <= r.doc_id < 200 or r.doc_id in (210, 221))
        failed = r.doc_id in (300, 301, 302, 303)
        assert r.base_failed == failed and r.kept == (not junk and not failed), r


def test_outliers_empty(spark):
    assert q.op13_mcd_outliers(planted(spark).limit(0)).collect() == []
    assert [r.kept for r in q.op13_mcd_outliers(planted(spark).where("doc_id = 300")).collect()] == [False]
