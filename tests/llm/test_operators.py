"""Each operator against a brute-force version, a round trip or held-out labels, and on odd input."""

import base64
import gzip
import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridfactor.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, mixing, mpeg_audio, sharding, suffix_dedup, warc
from gridfactor.llm import common
from gridfactor.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, cell int, b string, w string, t long, shard int, u long, h long, component string"
ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = " ".join(f"word{k % 977} is {k}" for k in range(20_000))


def odd_rows():
    base = "The quick brown fox jumps over the lazy dog while forty two engineers watch from the old bridge near the quiet river bank tonight"
    near = base.replace("forty two", "forty three")
    texts = [base, base, near, None, "", " \t\n", "one", "ONE", "two words", "Two Words", LONG, LONG + " end", "über çà été ß İ K", base + " " + LONG[:300], "....", "12 34", None]
    rows = [(k, x, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None) for k, x in enumerate(texts)]
    rows += [(0, base, "en", "s1"), (None, base, "en", None), (None, "other text without an id at all", None, "s1"), (99, near, "fr", "s2"), (99, near, "fr", "s2")]
    return [(*r, 7, 1, 2, "b", "w", 3, 4, 5, 6, "c") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def rows_of(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key], str(r)))


# ---------------------------------------------------------------- 1
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<main><article><header><h1>The &amp; title</h1></header><p>First <b>bold</b>ly\n  put&nbsp;text. <p>Second &eacute;t&#233; <a href=y>link</a>.<div class="ad">Buy</div><ul><li>one<li>two</ul>
<form><label>Mail</label><input></form><blockquote>Quoted<br>lines</blockquote><aside>Side</aside></article><section id="comments"><p>First comment is long enough to count as text, really.</p></section></main>
<aside class="sidebar"><p>Related</p></aside><footer>&copy; me</footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "The & title First boldly put text. Second été link. one two Quoted lines"


def test_html_without_article():
    text = "A long paragraph of the story that goes on and on, with many words and hardly any markup in it. " * 3
    html = f"<body><div id=menu><a>x</a> <a>y</a></div><div class=content><h1>Head</h1><p>{text}</p><p>Short.</p></div><div><a>l1</a><br><a>l2</a></div></body>"
    assert html_extract.main_text(html) == "Head " + text.strip() + " Short."


def test_html_comment_articles():
    html = '<main><article><p>Story text.</p></article><article class="comment"><p>I think that this is a very long comment about it.</p></article></main>'
    assert html_extract.main_text(html) == "Story text."


STORY = "A long paragraph of the story that goes on and on, with many words and hardly any markup in it. " * 3


@pytest.mark.parametrize("teaser", ['<article class="teaser"><h3><a href=x>More</a></h3><p><a href=x>Read on</a></p></article>', "<main><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></main>"])
def test_html_article_is_not_the_main_text(teaser):
    """The story is in a div; the article or main element holds a teaser."""
    links = "<nav><ul>" + "<li><a href=z>l</a>" * 4 + "</ul></nav>"
    for html in (f"<body><div class=story><h1>Head</h1><p>{STORY}</p><p>{STORY}</p></div>{links}{teaser}</body>", f"<body>{teaser}{links}<div class=story><h1>Head</h1><p>{STORY}</p><p>{STORY}</p></div></body>"):
        assert html_extract.main_text(html) == " ".join(["Head", STORY.strip(), STORY.strip()])


def test_html_article_of_short_lines():
    lines = [f"Short line {k} of a poem" for k in range(40)]
    html = f"<body><article>{''.join(f'<p>{x}</p>' for x in lines)}</article><div><p>{STORY}</p></div></body>"
    assert html_extract.main_text(html) == " ".join([*lines, STORY.strip()])


def test_html_foreign_elements_that_close_themselves():
    html = f"<article><svg width=1 /><h1>Head</h1><p>a <svg/> b <math/> c</p><svg><g/><text>no</text></svg><p>{STORY}</p></article>"
    assert html_extract.main_text(html) == "Head a b c " + STORY.strip()


@pytest.mark.parametrize("name", ["section id=discussion", "section id=related-work", 'div class="market-share"', 'div class="side-effects"', 'section class="discussion"'])
def test_html_words_that_articles_use(name):
    tag = name.split()[0]
    links = '<div class="related"><a href=x>One thing</a> <a href=y>Other</a></div><div class=share><a href=z>Share</a></div>'
    html = f"<article><h1>Head</h1><p>{STORY}</p><{name}><h2 id=social-history>Part</h2><p>{STORY}</p></{tag}>{links}<div class='nav-menu'>Menu</div></article>"
    assert html_extract.main_text(html) == " ".join(["Head", STORY.strip(), "Part", STORY.strip()])


SOUP = "<body><div><a href=a>Home</a> <a href=b>News</a></div><div><ul>" + "<li><a href=c>Topic</a></li>" * 12 + f"</ul></div><div><h2>Head</h2><p>{STORY}</p><p>Short one.</p><p>{STORY}</p></div><div><p><a href=d>About</a> <a href=e>Jobs</a></p></div></body>"


def test_html_ratios_decide_without_names():
    """Neither an article nor a name: the ratios alone find the story."""
    assert html_extract.main_text(SOUP) == " ".join(["Head", STORY.strip(), "Short one.", STORY.strip()])


def test_html_story_with_a_misleading_name():
    html = f"<body><div class=widget><p>{STORY}</p></div><div>" + "<b><i><u>x</u></i></b><br>" * 9 + "</div></body>"
    assert STORY.strip() in html_extract.main_text(html)


def test_html_long_chrome_between_paragraphs():
    notice = "<div class=newsletter-signup>" + "Subscribe to it now. " * 900 + "</div>"
    html = f"<article><p>{STORY}</p>{notice}<p>{STORY}</p></article><section class=comments><p>{STORY * 40}</p></section><footer>{STORY}</footer>"
    assert html_extract.main_text(html) == " ".join([STORY.strip()] * 2)


def test_html_noise_instead_of_ratios(spark, sf, monkeypatch):
    """On the given pages noise in place of the ratios changes the texts; with no prior on chrome's ratios they stay (names still say what is chrome)."""
    pages = [r.html for r in table(spark, sf, "pages").collect()] + [SOUP]
    right = [html_extract.main_text(x) for x in pages]
    with monkeypatch.context() as m:
        m.setattr(html_extract, "PRIOR", 1.0)
        plain = [html_extract.main_text(x) for x in pages]
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_extract, "smoothed", lambda ratios, kinds: rng.uniform(0, 100, len(ratios)))
    noisy = [html_extract.main_text(x) for x in pages]
    assert sum(a != b for a, b in zip(right, noisy)) > 0.9 * len(pages)
    assert sum(a == b for a, b in zip(right, plain)) > 0.9 * len(pages)


def test_html_smoothing_matters(monkeypatch):
    """A long line alone among links, without a name that says so, isn't content; without smoothing it would be."""
    links = "".join(f"<p><a href=x{k}>Topic {k}</a></p>" for k in range(6))
    teaser = "<p>" + "A line between links that is as long as a paragraph of the story, though nothing else is near it. " * 2 + "</p>"
    html = f"<body><div><h1>Head</h1>{f'<p>{STORY}</p>' * 4}</div><div>{links}{teaser}{links}</div></body>"
    want = " ".join(["Head", *[STORY.strip()] * 4])
    assert html_extract.main_text(html) == want
    monkeypatch.setattr(html_extract, "smoothed", lambda ratios, kinds: ratios)
    assert html_extract.main_text(html) != want


S = STORY.strip()


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<article><h1>T</h1><p>{STORY}</p><h2 id="ads-and-auctions">Ads and auctions</h2><p>{STORY}</p></article>', f"T {S} Ads and auctions {S}"),
        (f'<article><p>{STORY}</p><section id="comments-on-methods"><h2>On methods</h2><p>{STORY}</p></section></article>', f"{S} On methods {S}"),
        (f'<article><p>{STORY}</p><div class="ad-hoc-analysis"><p>{STORY}</p></div></article>', f"{S} {S}"),
        (f'<article><p>{STORY}</p><blockquote class="sponsored-study">{STORY}</blockquote></article>', f"{S} {S}"),
        (f"<article><p>{STORY} where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{S} where x=2 holds."),
        (f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><h1>Title</h1></div><div><p>{STORY}</p><p>{STORY}</p></div><div><p>The end.</p></div><div><a href=c>About</a></div></body>", f"Title {S} {S} The end."),
        (f"<body><ul><li><a href=q>x</a></ul><section><h2>One</h2><p>{STORY}</p><p>{STORY}</p></section><section><h2>Two</h2><p>Short.</p></section></body>", f"One {S} {S} Two Short."),
        (f"<body><article><h1>A</h1><p>{STORY}</p></article><article><h1>B</h1><p>Short second.</p></article></body>", f"A {S} B Short second."),
        (f'<body><article><p>{STORY}</p><div class="comments"><p>{STORY}</p></div><div id="ad-slot-3"><p>{STORY}</p></div><div class="comment-list"><p>{STORY}</p></div></article></body>', S),
    ],
)
def test_html_loses_no_text(html, want):
    assert html_extract.main_text(html) == want


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>x", 1), (3, "u", "no markup &lt;", 1), (3, "u", "<article><p>" + "y " * 100_000, 1)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text[:20], r.n_chars) for r in html_extract.op1_html_extract(pages).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "x", 1), (3, "no markup <", 11), (3, "y " * 10, 199_999)}
    assert html_extract.op1_html_extract(pages.limit(0)).count() == 0


def test_html_table(spark, sf):
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in html_extract.op1_html_extract(table(spark, sf, "pages")).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        import html as h

        plain = " ".join(h.unescape(re.sub(r"<(p|/p|h1|/h1|br)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == plain


# ---------------------------------------------------------------- 2
def brute_components(rows, k, percent):
    sets, out = [], []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII))
        sets.append(frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    for j, (doc, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[j] and rows[m][0] is not None]
        out.append((doc, len(sets[j]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("more", [{}, {"cells": 3, "frequent": 1}, {"cells": 2, "frequent": 1, "family_tokens": 100}, {"cells": 7, "most_rows": 0}])
def test_jaccard_odd(odd, more):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd, **more).collect()), key=str)
    assert got == brute_components([r[:2] for r in odd_rows()], 4, 85)


@pytest.mark.parametrize("percent, k, more", [(85, 4, {"cells": 4}), (80, 5, {"cells": 3, "frequent": 2, "family_tokens": 3000})])
def test_jaccard_near_copies(spark, percent, k, more):
    """Families of copies with edits on both sides of the threshold, chains among them."""
    rng = np.random.default_rng(3)
    rows = []
    for family in range(6):
        size = int(rng.integers(4, 90))
        base = [f"f{family}w{j}" for j in range(size)]
        shared = [f"common{j}" for j in range(12)]
        for _ in range(25):
            words = list(base)
            for _ in range(int(rng.integers(0, 2 + size // 14))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(words + shared * int(rng.integers(0, 2)))))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, **more).collect()), key=str)
    assert got == brute_components(rows, k, percent)


def test_jaccard_form_letters(spark, monkeypatch):
    """Letters that share most shingles but don't link, with a few that do: rounds don't grow with the letters."""
    rng = np.random.default_rng(11)
    form, rows = [f"w{j}" for j in range(300)], []
    for k in range(40):
        words = list(form)
        for f, at in enumerate(rng.choice(np.arange(5, 290, 6), 9, replace=False)):
            words[at] = f"field{k}x{f}"
        rows.append((k, " ".join(words)))
        if k % 10 == 3:
            rows.append((100 + k, " ".join([*words[:-1], f"end{k}"])))
    found, calls = jaccard_join.components, []
    monkeypatch.setattr(jaccard_join, "components", lambda edges: calls.append(1) or found(edges))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), cells=2, family_tokens=3000).collect()), key=str)
    want = brute_components(rows, 4, 85)
    assert got == want and len({x[2] for x in want}) > 30
    assert len(calls) <= 3


@pytest.mark.parametrize("percent, seed", [(80, 0), (85, 1), (90, 2), (85, 3)])
def test_family_components(percent, seed):
    """Families of sets in one task against all pairs: chains, hubs, equal sets, tokens of their own."""
    rng = np.random.default_rng(seed)
    sets = []
    for family in range(4):
        s = set(rng.integers(0, 60, int(rng.integers(3, 40))).tolist())
        for _ in range(25):
            s = set(s)
            for _ in range(int(rng.integers(0, 3))):
                s.discard(next(iter(s))) if len(s) > 2 and rng.random() < 0.5 else s.add(int(rng.integers(0, 90)))
            sets.append(s)
    own = rng.integers(0, 3, len(sets))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + own[a] + len(sets[b]) + own[b] - both
            if 100 * both >= percent * union and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = jaccard_join.link_components([np.array(sorted(s), np.uint64) for s in sets], np.array([len(s) for s in sets]) + own, percent)
    assert [label.index(x) for x in label] == [got.tolist().index(x) for x in got]


def test_family_without_links_is_not_compared_pair_by_pair(monkeypatch):
    """Sets that share one token only: a hub meets none of them."""
    sets = [np.array([0, *range(1 + 9 * k, 10 + 9 * k)], np.uint64) for k in range(2000)]
    seen, flat = [], jaccard_join.flat
    monkeypatch.setattr(jaccard_join, "flat", lambda a, b: seen.append(int(b.sum())) or flat(a, b))
    assert len(set(jaccard_join.link_components(sets, np.full(2000, 10), 85).tolist())) == 2000
    assert sum(seen) < 20 * len(sets)


def test_jaccard_empty(none):
    assert jaccard_join.op2_combination_prefix(none).count() == 0


# ---------------------------------------------------------------- 3
def test_mpeg_round_trip():
    for data in (b"", b"x", b"\xff" * 575, bytes(range(256)) * 9, LONG.encode()):
        media = mpeg_audio.encode(data)
        found = mpeg_audio.scan(media)
        assert mpeg_audio.decode(media, found) == mpeg_audio.padded(data)
        assert found["bad_crc"] == 0 and found["skipped"] == 0 and found["samples"] == 1152 * len(found["offsets"])
        assert found["table"]["frames"] == len(found["offsets"]) and found["table"]["bytes"] == len(media) - mpeg_audio.tag_bytes(media)
        assert mpeg_audio.tags(media) == {"payload_bytes": str(len(data))}


def test_mpeg_crc_and_resync():
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # the published check value of this CRC
    media = bytearray(mpeg_audio.encode(b"a" * 5000))
    start = mpeg_audio.scan(bytes(media))["offsets"]
    media[start[3] + 8] ^= 1  # side information
    assert mpeg_audio.scan(bytes(media))["bad_crc"] == 1
    broken = bytes(media[: start[5]]) + b"\xff\xfb junk \xff" + bytes(media[start[5] :])
    found = mpeg_audio.scan(broken)
    assert found["skipped"] >= 9 and len(found["offsets"]) >= len(start) - 1
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0)[3:7] == (128000, 44100, 417, 1152)


def frames(version_bits, layer, indices, hertz_index=0, mono=True, protected=False):
    """A stream of empty frames with some bitrates."""
    out = b""
    for k in indices:
        head = bytes([0xFF, 0xE0 | version_bits << 3 | (4 - layer) << 1 | (not protected), k << 4 | hertz_index << 2, 0xC0 if mono else 0x40])
        h = mpeg_audio.header(head, 0)
        body = bytes(h[5] - 4)
        if protected:
            n = (17 if mono else 32) if layer == 3 else (16 if mono else (2 * 4 + 28) // 2)
            body = mpeg_audio.crc16(head[2:] + bytes(n)).to_bytes(2, "big") + body[2:]
        out += head + body
    return out


@pytest.mark.parametrize(
    "version, layer, index, hertz, bits, size, samples",
    [(3, 1, 1, 44100, 32000, 32, 384), (3, 1, 14, 44100, 448000, 484, 384), (3, 2, 14, 44100, 384000, 1253, 1152), (3, 3, 14, 44100, 320000, 1044, 1152), (2, 1, 14, 22050, 256000, 556, 384), (2, 2, 14, 22050, 160000, 1044, 1152), (2, 3, 8, 22050, 64000, 208, 576), (0, 3, 14, 11025, 160000, 1044, 576)],
)
def test_mpeg_headers(version, layer, index, hertz, bits, size, samples):
    """Sizes by the standard's formula: 144 (Layer I: 12 slots of 4; Layer III of MPEG-2: 72) times the bitrate over the rate."""
    data = frames(version, layer, [index] * 3)
    got = mpeg_audio.header(data, 0)
    assert (got[3], got[4], got[5], got[6]) == (bits, hertz, size, samples)
    found = mpeg_audio.scan(data)
    assert found["offsets"] == [0, size, 2 * size] and found["samples"] == 3 * samples and not found["vbr"]


def test_mpeg_variable_bitrates():
    data = frames(3, 3, [9, 9, 14, 1, 5, 5])
    found = mpeg_audio.scan(data)
    sizes = [mpeg_audio.header(data, at)[5] for at in found["offsets"]]
    assert found["vbr"] and found["offsets"] == list(np.cumsum([0, *sizes[:-1]])) and sum(sizes) == len(data) and found["samples"] == 6 * 1152
    body = mpeg_audio.struct.pack(">HHHIIHHHH", 1, 0, 75, len(data), 5, 2, 10, 2, 3) + (30).to_bytes(2, "big") + (50).to_bytes(2, "big")
    vbri = bytearray(data)
    vbri[36 : 40 + len(body)] = b"VBRI" + body
    table = mpeg_audio.scan(bytes(vbri))
    assert table["table"] == {"kind": "VBRI", "frames": 5, "bytes": len(data), "seek": [0, 300]} and table["offsets"] == found["offsets"][1:]


@pytest.mark.parametrize("layer, mono", [(1, True), (1, False), (3, True), (3, False), (2, True)])
def test_mpeg_checksums(layer, mono):
    data = bytearray(frames(3, layer, [9] * 4, mono=mono, protected=True))
    found = mpeg_audio.scan(bytes(data))
    assert (found["crc"], found["bad_crc"], found["unverified"]) == ((4, 0, 0) if layer != 2 else (0, 0, 4))
    data[found["offsets"][2] + 8] ^= 4
    assert mpeg_audio.scan(bytes(data))["bad_crc"] == (layer != 2)


def test_mpeg_other_tags():
    body = frames(3, 3, [9] * 3)
    utf16 = b"\x01" + "Ünï".encode("utf-16")
    v23 = b"ID3\x03\x00\x00" + mpeg_audio._syncsafe(10 + len(utf16)) + b"TIT2" + len(utf16).to_bytes(4, "big") + b"\x00\x00" + utf16
    assert mpeg_audio.tags(v23 + body) == {"TIT2": "Ünï"} and mpeg_audio.scan(v23 + body)["offsets"][0] == len(v23)
    v22 = b"ID3\x02\x00\x00" + mpeg_audio._syncsafe(6 + 4) + b"TT2" + (4).to_bytes(3, "big") + b"\x00abc"
    assert mpeg_audio.tags(v22 + body) == {"TT2": "abc"}
    v1 = (b"TAG" + b"song".ljust(30, b"\0") + b"who".ljust(30) + b"\0" * 30 + b"1999").ljust(128, b"\0")
    assert mpeg_audio.tags(body + v1) == {"title": "song", "artist": "who", "album": "", "year": "1999"} and mpeg_audio.scan(body + v1)["skipped"] == 0


def test_mpeg_foreign_rows(spark):
    rows = [(1, None), (2, b""), (3, b"no audio at all"), (4, frames(3, 3, [9] * 3)), (None, mpeg_audio.encode(b"abc"))]
    got = {r.doc_id: r for r in mpeg_audio.media_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].feature is None and got[1].media_bytes is None and got[2].feature == got[3].feature == "no frames" and got[3].duration_s is None
    assert got[4].n_bytes is None and got[4].duration_s == 3 * 1152 / 44100 and got[4].seek_offsets == [0, 417, 834] and got[None].n_bytes == 3


def test_mpeg_payload_like_a_tag(spark):
    """TAG where an ID3v1 tag would begin, 128 bytes before the stream's end, is the last frame's payload."""
    texts = {k: ("a" * (576 * k + 521) + "TAG").ljust(n, "b") for k, n in ((0, 524), (1, 1140), (3, 2304))}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.payload_sha256, r.tail_crc32, r.payload_bytes, r.n_bytes, "skipped 0; table whole" in r.feature) for r in mpeg_audio.op3_mpeg_audio(rows).collect()}
    padded = {k: mpeg_audio.padded(t.encode()) for k, t in texts.items()}
    assert got == {k: (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-576:]), len(p), len(texts[k]), True) for k, p in padded.items()}
    v1 = (b"TAG" + b"song".ljust(30, b"\0")).ljust(128, b"\0")
    own = mpeg_audio.encode(texts[0].encode())
    own = own[mpeg_audio.tag_bytes(own) :]
    assert mpeg_audio.tags(own) == {} and mpeg_audio.tags(own + v1)["title"] == "song"  # not a title "bbb", one behind the last frame
    assert mpeg_audio.scan(own + v1)["offsets"] == mpeg_audio.scan(own)["offsets"] and mpeg_audio.scan(own + b"junk" + v1)["skipped"] == len(own) - 672 + 4


def test_mpeg_bytes_that_are_no_utf8(spark):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(X'41ff42' AS STRING) AS text")
    assert [(r.n_bytes, r.payload_sha256) for r in mpeg_audio.op3_mpeg_audio(rows).collect()] == [(3, hashlib.sha256(mpeg_audio.padded(b"A\xffB")).hexdigest())]


def test_mpeg_rows(odd, none):
    for r, (doc, text, *_) in zip(rows_of(mpeg_audio.op3_mpeg_audio(odd)), sorted(odd_rows(), key=lambda r: (r[0] is None, r[0]))):
        assert r.doc_id == doc
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in mpeg_audio.op3_mpeg_audio(odd).collect())
    want = Counter()
    for doc, text, *_ in odd_rows():
        data = (text or "").encode()
        p = mpeg_audio.padded(data)
        want[doc, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-576:])] += 1
    assert got == want
    for r in mpeg_audio.op3_mpeg_audio(odd).collect():
        n = r.payload_bytes // 576
        assert r.n_samples == 1152 * n and r.duration_s == 1152 * n / 48000
        first = r.media_bytes - 672 * n
        assert r.seek_offsets == ",".join(str(first + 672 * k) for k in range(n))
    assert mpeg_audio.op3_mpeg_audio(none).count() == 0


# ---------------------------------------------------------------- 4
def plain_targets(sizes, weights):
    """Shares by weight; who is above three times its size is fixed there, one source at a time."""
    fixed = {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in fixed and sizes[k]]
        left = sum(sizes) - sum(fixed.values())
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > 3 * sizes[k] + 1e-9]
        if not over:
            return [fixed.get(k, share.get(k, 0)) for k in range(len(sizes))]
        fixed[max(over, key=lambda k: share[k] / sizes[k])] = 3 * sizes[max(over, key=lambda k: share[k] / sizes[k])]


def test_mix(docs, odd, none):
    for d in (docs, odd):
        rows = mixing.op4_hypergeometric_mix(d).collect()
        assert len(rows) == d.count() and Counter(map(tuple, rows)) == Counter(map(tuple, mixing.op4_hypergeometric_mix(d).collect()))
        texts = Counter((r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in d.collect())
        assert Counter((r.doc_id, r["size"]) for r in rows) == texts
        source, by = Counter(), defaultdict(list)
        for r in mixing.mix_sources(d).collect():
            by[r.source].append(r)
            source[r.source] += r["size"]
        names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
        want = plain_targets([source[s] for s in names], [k % 3 + 1 for k in range(len(names))])
        assert abs(sum(want) - sum(source.values())) < 1e-6 * max(1, sum(want))
        for s, t in zip(names, want):
            taken = sum(r["size"] * len(r.draws) for r in by[s])
            assert abs(taken - t) <= max([r["size"] for r in by[s]], default=0)
            assert {r.source_size for r in by[s]} == {source[s]} and all(abs(r.target - t) < 1e-6 * max(1, t) for r in by[s])
            assert all(len(r.draws) <= 3 for r in by[s])
        assert sorted(r.shards for r in rows) == sorted(",".join(str(x.shard) for x in r.draws) for s in by for r in by[s])
    assert mixing.op4_hypergeometric_mix(none).count() == 0


@pytest.mark.parametrize("run", [1024, 3])
def test_mix_draws_follow_the_tree(docs, run, monkeypatch):
    """Each block draw is in one shard; shards have the quotas of the tree; another tree gives another result."""
    monkeypatch.setattr(mixing, "RUN", run)
    given = []
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda counts, shards, seed=0: given.append(split(counts, shards, seed)) or given[-1])
    rows = mixing.mix_sources(docs, n_shards=5, docs_per_block=4).collect()
    quotas = given[0]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    where, takers = defaultdict(set), Counter()
    for r in rows:
        assert sorted({x["pass"] for x in r.draws}) == list(range(len(r.draws)))  # a pass takes a document once
        for x in r.draws:
            where[r.source, r.block, x["pass"]].add(x.shard)
    assert all(len(x) == 1 for x in where.values())  # draws are disjoint among shards
    for (s, _, _), (shard,) in where.items():
        takers[s, shard] += 1
    got = np.array([[takers[s, k] for s in names] for k in range(5)])
    empty = quotas - got  # a block of which the cut took no document
    assert (empty >= 0).all() and empty.sum() <= len(names) and max(quotas.sum(1)) - min(quotas.sum(1)) <= 2
    words = Counter()
    for r in rows:
        for x in r.draws:
            words[x.shard] += r["size"]
    assert min(words.values()) > 0
    zero = lambda counts, shards, seed=0: np.array([counts] + [[0] * len(counts)] * (shards - 1))
    monkeypatch.setattr(mixing, "split_quotas", zero)
    assert {x.shard for r in mixing.mix_sources(docs, n_shards=5, docs_per_block=4).collect() for x in r.draws} == {0}


def test_mix_written(spark, docs, tmp_path):
    """Files of a shard hold its draws, in the order of their places."""
    mix = mixing.mix_sources(docs, n_shards=3)
    mixing.write_mix(docs, mix, f"file://{tmp_path}/mix")
    want, place = Counter(), {}
    for r in mix.collect():
        for x in r.draws:
            want[r.doc_id, x.shard] += 1
            place.setdefault((r.doc_id, x.shard), []).append(x.place)
    got = Counter()
    for k in range(3):
        for file in sorted((tmp_path / "mix" / f"mix_shard={k}").glob("*.parquet")):
            ids = [r.doc_id for r in spark.read.parquet(f"file://{file}").collect()]
            got.update((i, k) for i in ids)
            if all(len(place[i, k]) == 1 for i in ids):
                order = [place[i, k][0] for i in ids]
                assert order == sorted(order) and ids != sorted(ids)
    assert got == want


def test_mix_targets_and_quotas():
    t = mixing.capped_targets([10, 10, 1000], [1, 2, 3])
    assert t == [30, 30, 960]
    assert mixing.capped_targets([0, 0], [1, 2]) == [0, 0]
    q = mixing.split_quotas([100, 7, 0, 13], 8, 1)
    assert q.sum(0).tolist() == [100, 7, 0, 13] and set(q.sum(1)) <= {15}


def test_mix_documents(odd):
    mix = mixing.mix_sources(odd, n_shards=4, docs_per_block=2)
    want = Counter()
    for r in mix.collect():
        want[r.doc_id] += len(r.draws)
    got = Counter(r.doc_id for r in mixing.drawn_documents(odd, mix).collect())
    assert got == +want


def test_mix_of_a_row_many_times(spark):
    """One row 200,000 times, with another column that differs: it is in many blocks and shards, no task makes or gets them all, each copy is drawn as the mix says."""
    n = 200_000
    one = spark.range(n).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 4 == 0, None).otherwise("a").alias("source"), F.col("id").alias("extra"))
    other = spark.createDataFrame([(4, "b " * 1000, "a", -1), (None, None, "a", -2), (None, None, "a", -3)], "doc_id long, text string, source string, extra long")
    docs = one.unionByName(other)
    mix = mixing.mix_sources(docs, n_shards=8).cache()
    rows = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.size("draws")).alias("taken"), F.max("target").alias("target"), F.countDistinct("block").alias("blocks"), F.countDistinct("nth").alias("nths"), F.max(F.size("draws")).alias("most")).collect()
    found = {(r.source, r.doc_id): r for r in rows}
    assert {k: (r.n, r.nths) for k, r in found.items()} == {("a", 3): (3 * n // 4, 3 * n // 4), (None, 3): (n // 4, n // 4), ("a", 4): (1, 1), ("a", None): (2, 2)}
    for s in ("a", None):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1000 and all(r.most <= 3 for r in mine)
    assert found["a", 3].blocks > 250 and found[None, 3].blocks > 80  # of 293 and 98
    per_block = mix.groupBy("source", "block").count().agg(F.max("count")).first()[0]
    assert per_block < 2 * 512
    drawn = mixing.drawn_documents(docs, mix).cache()
    want = {(r.source, r.shard): r.n for r in mix.select("source", F.explode("draws.shard").alias("shard")).groupBy("source", "shard").agg(F.count("*").alias("n")).collect()}
    assert {(r.source, r.mix_shard): r.n for r in drawn.groupBy("source", "mix_shard").agg(F.count("*").alias("n")).collect()} == want
    load = Counter()
    for (_, shard), k in want.items():
        load[shard] += k
    assert len(load) == 8 and max(load.values()) < 2 * min(load.values())
    assert drawn.groupBy("extra").count().agg(F.max("count")).first()[0] <= 3
    # places tie only between rows of different sources that agree in id and text, whose hashes are the same
    assert drawn.select("source", "mix_shard", "mix_place").distinct().count() == drawn.count()
    sizes = spark.createDataFrame(mixing._numbered(one.withColumn("__key", F.struct("doc_id", "source"))).select("source", "__nth").toPandas()).groupBy("source").agg(F.countDistinct("__nth").alias("n"), F.max("__nth").alias("top"))
    assert {r.source: (r.n, r.top) for r in sizes.collect()} == {"a": (3 * n // 4, 3 * n // 4 - 1), None: (n // 4, n // 4 - 1)}
    mix.unpersist()
    drawn.unpersist()


# ---------------------------------------------------------------- 5
def brute_removed(rows):
    least = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        for i in range(len(b) - 49):
            least.setdefault(b[i : i + 50], doc)
    out = Counter()
    for doc, text in rows:
        b = (text or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            first = least[b[i : i + 50]]
            if first is not None and (doc is None or first < doc):
                m[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, m) if not y)
        out[doc, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("cells, hot_cells, most_rows", [(1, 4096, 99), (3, 4096, 99), (4, 2, 99), (3, 0, 99), (10, 4096, 0), (10, 2, 0)])
def test_suffix_dedup(docs, odd, cells, hot_cells, most_rows):
    for rows, d in (([(r.doc_id, r.text) for r in docs.collect()], docs), ([r[:2] for r in odd_rows()], odd)):
        got = suffix_dedup.remove_repeats(d, cells=cells, hot_cells=hot_cells, most_rows=most_rows).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert Counter(map(tuple, got)) == brute_removed(rows)


def footers(n):
    """Texts that share one passage and nothing around it."""
    rng = np.random.default_rng(5)
    noise = lambda: "".join(chr(x) for x in rng.integers(97, 123, 90))
    return [(k, noise() + "All rights are reserved by the owners of this text, and copies need a written licence." + noise()) for k in range(n)]


def test_suffix_contexts_of_one_anchor(spark):
    """Few cells, one passage, many surroundings: no anchor brings more than hot_contexts contexts to a bucket."""
    rows, limit = footers(200), 16
    tables = [suffix_dedup.pa.table({"doc_id": [k for k, _ in rows[c::2]], "b": [x.encode() for _, x in rows[c::2]]}) for c in range(2)]
    sent = [suffix_dedup._send_anchors(c, t, 1) for c, t in enumerate(tables)]
    answer = suffix_dedup._shared_anchors(0, suffix_dedup.pa.concat_tables(sent), 4096, limit)
    brought = Counter()
    for c, t in enumerate(tables):
        for blob in suffix_dedup._send_contexts(c, t, answer.filter(suffix_dedup.pa.array([x == c for x in answer["cell"].to_pylist()])), 1)["data"].to_pylist():
            brought.update(suffix_dedup._unpack(blob, np.int32, np.int64, bool, np.uint64)[3].tolist())
    assert len(brought) > 100 and max(brought.values()) <= limit
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), cells=2, hot_contexts=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_removed(rows)


def test_suffix_periodic(spark, none):
    rows = [(3, "ab" * 60), (1, "ba" * 26 + "x"), (2, "z" * 49), (4, "z" * 50), (5, "z" * 120 + "ab" * 30), (6, "q" * 50), (7, "q" * 51)]
    got = suffix_dedup.op5_deep_shallow(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_removed(rows)
    assert suffix_dedup.op5_deep_shallow(none).count() == 0


def test_anchors_do_not_depend_on_the_scan(monkeypatch):
    """Each window's anchor, of texts that are empty, short or long, whatever the blocks are that are scanned at once."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        offsets = np.concatenate([[0], np.cumsum(rng.choice([0, 1, 30, 49, 50, 51, 70, 400], rng.integers(0, 8)))]).astype(np.int64)
        data = rng.integers(97, 99, offsets[-1]).astype(np.uint8)
        found = []
        for scan in (1 << 20, 64, 7):
            monkeypatch.setattr(suffix_dedup, "SCAN", scan)
            lo, hi, key, _ = suffix_dedup.anchors(data, offsets)
            found.append([(int(w), int(k)) for a, b, k in zip(lo, hi, key) for w in range(a, b + 1)])
        starts = [w for a, b in zip(offsets[:-1], offsets[1:]) for w in range(a, b - suffix_dedup.LENGTH + 1)]
        assert [w for w, _ in found[0]] == starts and found[0] == found[1] == found[2]


def test_buckets_of_least_hashes():
    least = np.random.default_rng(4).integers(0, 1 << 64, (100000, 31), np.uint64).min(1)
    assert len(np.unique(common.bucket_of(least, 1 << 22))) > 95000
    assert np.bincount(common.bucket_of(least, 16)).max() < 1.1 * len(least) / 16


def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    buf = np.concatenate([rng.integers(97, 99, 3000), np.tile([97, 98, 99], 100), np.zeros(70)]).astype(np.uint8)
    starts = rng.integers(0, len(buf) - 60, 2000)
    order, new = suffix_dedup.deep_shallow(buf, starts)
    strings = [buf[s : s + 50].tobytes() for s in starts[order]]
    assert strings == sorted(strings)
    assert new.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]


# ---------------------------------------------------------------- 6
def test_warc(spark, sf):
    rows = [(3, "http://a\r\nb", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (5, "u", ""), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>same</p>"), (7, "u", "x" * 300_000), (1, "again", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc(pages).collect())
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        one = first.get(html or "")
        response = page == one
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else one] += 1
    assert got == want
    assert warc.op6_warc(pages.limit(0)).count() == 0


def test_warc_files_and_predicates(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 7}</p>") for k in range(40)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, per_file=9)
    files = sorted((tmp_path / "w").glob("*.gz"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert data.count(b"WARC/1.1\r\n") == 40 and data.endswith(b"\r\n\r\n")
    records = warc.read_warc(spark, path, split_mb=0)
    only = records.where(F.col("record_type") == "response")
    assert sorted((r.page_id, r.payload) for r in only.collect()) == [(k, f"<p>{k}</p>") for k in range(7)]
    assert [r.refers_to for r in records.where(F.col("page_id") == 39).collect()] == [39 % 7]
    damaged = data.replace(b"<p>3</p>", b"<p>4</p>", 1)
    for f in files[1:]:
        f.unlink()
    files[0].write_bytes(gzip.compress(damaged))
    (tmp_path / "w" / f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, path).collect()


def test_warc_of_others(spark, tmp_path):
    """Records with other ids, types and digests; predicates that contradict each other give nothing."""
    record = lambda kind, name, body, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    text = record("warcinfo", "urn:uuid:1", "software: y\r\n", "Content-Type: application/warc-fields\r\n") + record("response", "urn:uuid:2", http + "é<p>", "WARC-Payload-Digest: md5:abc\r\nWARC-Target-URI: http://z\r\nContent-Type: application/http; msgtype=response\r\n")
    text += record("response", "urn:page:7", http + "mine", "Content-Type: application/http\r\n")
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "part-0.warc").write_bytes(text.encode())
    records = warc.read_warc(spark, f"file://{tmp_path}/o")
    got = {r.record_id: (r.page_id, r.record_type, r.url, r.payload_bytes, r.payload) for r in records.collect()}
    assert got == {"<urn:uuid:1>": (None, "warcinfo", None, 13, "software: y\r\n"), "<urn:uuid:2>": (None, "response", "http://z", 5, "é<p>"), "<urn:page:7>": (7, "response", None, 4, "mine")}
    assert [r.page_id for r in records.where(F.col("page_id").isin(7, 9, 11)).collect()] == [7]
    reader = warc.WarcReader({"files": "[]"})
    rest = list(reader.pushFilters([warc.In(("page_id",), (7, 9)), warc.EqualTo(("page_id",), 8), warc.EqualTo(("page_id",), 7)]))
    assert rest == [] and reader.pages == set()


def test_warc_shuffles_no_payload(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k % 3}</p>") for k in range(9)], "page_id long, url string, html string")
    plan = warc.warc_records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


# ---------------------------------------------------------------- 7
def brute_hits(rows, items):
    cut = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(ASCII))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[j : j + 13])].add(item)
    out = Counter()
    for doc, text in rows:
        w = cut(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    hit.update(range(j, j + size))
                    found |= windows[tuple(w[j : j + size])]
        names = sorted(str(x) for x in found if x is not None)
        out[doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


ITEMS = [(1, "the QUICK brown fox jumps over the lazy dog while forty two engineers watch from"), (2, "word5"), (3, "two words"), (4, None), (5, "..."), (None, "over the lazy"), (10, "word5 is 5 word6 is 6 word7 is 7 word8 is 8 word9 is 9"), (10, "two words"), (7, "ÜBER çà été"), (8, "forty three engineers watch")]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination(spark, sf, docs, odd, limit):
    items = spark.createDataFrame([(*x, 1, 2) for x in ITEMS], "item_id long, text string, len int, w int")
    columns = ["doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256), "contaminated"]
    assert Counter(map(tuple, decontaminate.contamination(odd, items, broadcast_rows=limit).select(*columns).collect())) == brute_hits([r[:2] for r in odd_rows()], ITEMS)
    bench = table(spark, sf, "benchmark")
    got = decontaminate.contamination(docs, bench, broadcast_rows=limit).select(*columns).collect()
    assert Counter(map(tuple, got)) == brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_contamination_empty(spark, odd, none, sf):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.op7_prefix_containment(odd, items).collect()} == {0}
    assert decontaminate.op7_prefix_containment(none, table(spark, sf, "benchmark")).count() == 0


# ---------------------------------------------------------------- 8
def test_preference(spark):
    turns = [(1, 0, 10, 0, "system", "S"), (1, 0, 10, 1, "user", "Q"), (1, 0, 10, 2, "assistant", "good <|end|>"), (1, 1, 11, 0, "system", "S"), (1, 1, 11, 1, "user", "Q"), (1, 1, 11, 2, "assistant", "bad")]
    turns += [(2, 0, 12, 0, "user", "alone"), (3, 0, 13, 0, None, None), (3, 1, 14, 0, None, None), (3, 1, 14, 1, "assistant", "x"), (3, 1, 14, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "pair_id long, side int, conv_id long, turn long, role string, text string")
    one, two, three = rows_of(chat_format.preference_pairs(df), "pair_id")
    assert one.n_prompt_turns == 2 and one.prompt == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n"
    assert one.chosen == "<|assistant|>\ngood < |end|><|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_mask] == ["good < |end|><|end|>\n"] and [one.rejected[a:b] for a, b in one.rejected_mask] == ["bad<|end|>\n"]
    assert two.prompt == "" and two.rejected is None and two.rejected_mask is None and two.chosen == "<|user|>\nalone<|end|>\n" and two.chosen_mask == []
    assert three.n_prompt_turns == 1 and three.chosen == "" and [three.rejected[a:b] for a, b in three.rejected_mask] == ["x<|end|>\n"] * 2
    assert chat_format.preference_pairs(df.limit(0)).count() == 0


def brute_preferences(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    by = {c: [(role, text) for _, role, text in sorted(turns, key=key)] for c, turns in by.items()}
    out = Counter()
    clean = lambda x: (x or "").replace("<|", "< |")

    def rendered(turns):
        text, spans = "", []
        for role, x in turns:
            text += f"<|{clean(role)}|>\n"
            a = len(text)
            text += clean(x) + "<|end|>\n"
            if role == "assistant":
                spans.append(f"{a}-{len(text)}")
        return text, " ".join(spans)

    for conv, c in by.items():
        mine = [k for k, (role, _) in enumerate(c) if role == "assistant"]
        others = [x for role, x in by.get(conv ^ 1, []) if role == "assistant"]
        n, r = 0, None
        if mine and others:
            r = c[: mine[conv % len(mine)]] + [("assistant", others[-1])]
            while n < min(len(c), len(r)) and c[n] == r[n]:
                n += 1
        chosen, rejected = rendered(c[n:]), rendered(r[n:]) if r is not None else (None, None)
        out[conv, conv, conv ^ 1 if r is not None else None, n, rendered(c[:n])[0], chosen[0], rejected[0], chosen[1], rejected[1]] += 1
    return out


def test_preference_table(spark, sf):
    """Every conversation's pair against plain code; prompts of several turns occur."""
    c = table(spark, sf, "conversations")
    rows = chat_format.op8_preference(c).collect()
    assert Counter(map(tuple, rows)) == brute_preferences([(r.conv_id, r.turn, r.role, r.text) for r in c.collect()])
    assert sum(r.n_prompt_turns > 0 for r in rows) > len(rows) // 2 and len({r.n_prompt_turns for r in rows}) > 3
    assert any(r.rejected_mask for r in rows)


def test_preference_odd(spark):
    long = "long " * 50_000 + "<|end|>"
    rows = [(0, 0, "user", "Q"), (0, 1, "assistant", None), (1, 0, "user", "Q"), (1, None, "system", "S"), (1, 2, "assistant", "same"), (1, 4, "assistant", "same"), (1, 4, "assistant", "same"), (1, 3, None, None)]
    rows += [(2, 0, "user", "no answer"), (3, 0, "assistant", long), (None, 0, "assistant", "lost"), (None, 1, "user", "lost"), (6, 0, "assistant", "x"), (-4, 0, "assistant", ""), (-3, 0, "user", "a"), (-3, 1, "assistant", "<|"), (8, 0, "user", "Q"), (8, 1, "assistant", "A"), (9, 0, "user", "R"), (9, 1, "assistant", "A")]
    turns = spark.createDataFrame([(*r, 1, 2, "c", 5) for r in rows], "conv_id long, turn long, role string, text string, side int, pair_id int, c string, at int")
    got = chat_format.op8_preference(turns).collect()
    assert Counter(map(tuple, got)) == brute_preferences(rows)
    same = next(r for r in got if r.pair_id == 8)
    assert same.n_prompt_turns == 2 and same.chosen == same.rejected == ""
    assert chat_format.op8_preference(turns.limit(0)).count() == 0


# ---------------------------------------------------------------- 9
def test_language(spark, sf, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.op9_rank_order(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test) and all(0 <= r.score <= 1 for r in got)
    odd_got = language_id.op9_rank_order(odd).collect()
    assert len(odd_got) == len(odd_rows())
    assert all(r.lang_pred == "und" for r in odd_got if r.doc_id in (3, 4, 5, 14, 15))
    assert language_id.op9_rank_order(none).count() == 0
    assert {r.lang_pred for r in language_id.op9_rank_order(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_language(rows, size=300):
    """(held out, language, score) of each document, by the out-of-place distance in plain code; all labelled documents are learned from."""

    def ranked(texts):
        n = Counter()
        for text in texts:
            clean = "".join(c if c.isalpha() else " " for c in text.lower())
            for word in clean.split():
                word = f" {word} "
                n.update(word[j : j + k] for k in (1, 2, 3) for j in range(len(word) - k + 1) if word[j : j + k] != " ")
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], [ord(c) if c != " " else 32 for c in x[0].rjust(3, "\0")]))][:size]

    by, out = defaultdict(list), []
    for doc, text, lang in rows:
        if doc is not None and lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            by[lang].append(text or "")
    profiles = {lang: {g: k for k, g in enumerate(ranked(texts))} for lang, texts in by.items()}
    for doc, text, _ in rows:
        top = ranked([text or ""])
        held = doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2
        far = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(far, key=str.encode), key=lambda x: far[x]) if top and any(profiles.values()) else "und"
        out.append((doc, held, best, round(1 - far[best] / (size * len(top)), 9) if best != "und" else 0.0))
    return Counter(out)


def test_language_against_plain_code(docs, odd):
    for d in (docs, odd):
        got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.op9_rank_order(d).collect())
        assert got == plain_language([(r.doc_id, r.text, r.lang) for r in d.collect()])


def test_ngrams():
    grams, n = language_id.ngram_counts("Ab, ab! 1c")
    text = lambda g: "".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF)
    assert {text(g): int(k) for g, k in zip(grams, n)} == {"a": 2, "b": 2, "c": 1, " a": 2, "ab": 2, "b ": 2, " c": 1, "c ": 1, " ab": 2, "ab ": 2, " c ": 1}


# ---------------------------------------------------------------- 10
def least_capacity(sizes, shards):
    def fits(cap):
        used, room = 0, 0
        for s in sizes:
            if s > cap:  # alone
                used, room = used + 1, 0
            elif s > room:
                used, room = used + 1, cap - s
            else:
                room -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("n, shards, hot", [(1, 4, 0), (5, 16, 0), (300, 7, 0), (20_000, 16, 0), (300, 7, 2), (2000, 16, 1), (2000, 16, 3), (2000, 4, 6)])
def test_minimax(spark, n, shards, hot):
    """Shards are cuts of one order, each within the least capacity or one atom, also with atoms of a third of all and more."""
    rng = np.random.default_rng(n + hot)
    u = np.sort(rng.integers(0, 1 << 63, n, dtype=np.int64))
    sizes = rng.integers(1, 1000, n)
    sizes[rng.choice(n, hot, replace=False)] = 250 * n
    groups = spark.createDataFrame(list(zip(u.tolist(), sizes.tolist())), "u long, size long")
    cuts, cap = sharding.minimax_cuts(groups, shards)
    assert cap == least_capacity(sizes.tolist(), shards) and cuts == sorted(cuts)
    held = defaultdict(list)
    for a, s in zip(u.tolist(), sizes.tolist()):
        held[sum(a >= c for c in cuts)].append(s)
    assert all(sum(x) <= cap or len(x) == 1 for x in held.values()) and max(held) < shards
    if n >= shards + hot:
        assert len(held) == shards


def test_one_row_many_times(spark):
    """A row repeated 200,000 times beside others: slots have no gap, and no task makes twice the mean of its rows."""
    one = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words").alias("text"))
    docs = one.unionByName(spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id") % 900)).toDF("doc_id", "text")).unionByName(spark.createDataFrame([(None, None)] * 40, "doc_id long, text string"))
    found = sharding.minimax_shards(docs, 4, piece=1000)
    rows = found.agg(F.count("*").alias("n"), F.countDistinct("shard", "slot").alias("d")).first()
    assert rows.n == rows.d == 203_040
    ends = {r.shard: (r.n, r.low, r.high) for r in found.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()}
    assert all(low == 0 and high == n - 1 for n, low, high in ends.values())
    assert found.where("doc_id = 7 and size = 11").count() == 200_000 and found.where("doc_id is null and size = 1").count() == 40
    tasks = [r.n for r in found.where("doc_id = 7").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 1 and max(tasks) < 2 * sum(tasks) / len(tasks)


def test_shards(docs, odd, none):
    for d in (docs, odd):
        rows = sharding.op10_minimax_shards(d).collect()
        assert len(rows) == d.count()
        for k in range(16):
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    texts = {}
    for doc, text, *_ in odd_rows():
        texts.setdefault((len((text or "").encode()) + 1, zlib.crc32((text or "").encode())), []).append(doc)
    found = defaultdict(set)
    for r in rows:
        found[r["size"], r.text_crc32].add(r.shard)
    assert set(found) == set(texts) and all(len(x) == 1 for x in found.values())
    assert sharding.op10_minimax_shards(none).count() == 0


def test_shards_of_documents_against_plain_code(docs):
    """The registered query's sizes, checksums and capacity: groups of equal texts in order of Spark's hash, cut by a plain search."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.op10_minimax_shards(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in rows) == Counter((k, len((x or "").encode()) + 1, zlib.crc32((x or "").encode()), "bytes") for k, x in texts.items())
    groups = docs.groupBy(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("u")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")).collect()
    load, texts_of = Counter(), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        texts_of[r.shard].add((r["size"], r.text_crc32))
    cap = least_capacity([r["size"] for r in sorted(groups)], 16)
    assert all(x <= cap or len(texts_of[k]) == 1 for k, x in load.items()) and len(load) == 16


def test_routes():
    """Packed and dealt messages are the messages."""
    routes, rng = common.Routes(30, 0), np.random.default_rng(3)
    messages = [(int(rng.integers(0, 2)), b, c, rng.bytes(int(rng.integers(0, 9)))) for c in range(30) for b in range(30) if rng.random() < 0.5]
    packed = [routes.sent(common.Routes.table([m for m in messages if m[2] == c]), "bucket") for c in range(30)]
    assert max(p.num_rows for p in packed) <= 5
    got = []
    for g in range(6):
        for part in range(5):
            mine = [p.filter(pa.array([x == g for x in p["bucket"].to_pylist()], pa.bool_())) for p in packed[6 * part : 6 * part + 6]]
            got.append(routes._dealt(pa.concat_tables(mine), "bucket", "cell"))
    whole = pa.concat_tables(got)
    assert whole.num_rows <= 30 * 5
    for b in range(30):
        mine = routes.received(whole.filter(pa.array([x == b for x in whole["bucket"].to_pylist()])))
        assert sorted(map(tuple, zip(*(mine[c].to_pylist() for c in common.Routes.COLUMNS)))) == sorted(m for m in messages if m[1] == b)
