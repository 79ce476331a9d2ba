"""Pages, WARC records and conversations."""

import base64
import gzip
import hashlib
import html
import itertools
import json
import math
import random
import re
from collections import Counter

import pytest

from weftgraph.llm import html_text, preference, queries, warc

ARTICLE = "<p>" + "The first paragraph of the article is long enough to count. " * 3 + "</p><p>Short.</p><p>" + "Another paragraph &amp; more text, with a <a href='x'>link</a> inside. " * 3 + "</p>"
TEXT = " ".join((("The first paragraph of the article is long enough to count. " * 3) + "Short. " + ("Another paragraph & more text, with a link inside. " * 3)).split())
MENU = "<nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>Menu entry that is long enough to look like text</a></li></ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{MENU}<article>{ARTICLE}</article><footer>&copy; someone, all rights reserved by them for ever</footer></body></html>",
        f"<body><header><h1>Site name and a slogan that is rather long</h1></header><main>{ARTICLE}</main><aside>Sidebar words that are also long enough to look like text</aside>",
        f"<body><div class='menu'>One Two Three</div><div id='content'>{ARTICLE}</div><div class='comments'><p>A reader says a lot about this article and more than that.</p></div></body>",
        f"<body><div class='ad'>Buy this thing now, it is the very best of all things</div><article>{ARTICLE}<form><input name=q><label>Search the whole site for words</label></form></article>",
        f"<nav><ul><li>left open<article>{ARTICLE}",
        f"<head><meta charset=x><title>left open</title><p></p><select><option>One<option>Two<main>{ARTICLE}</main>",
        f"<body><div role='search'>Find what you look for on all pages of this site</div><article>{ARTICLE}<section id='user-comments'><p>I have read this article and would like to say much.</p></section></article>",
        f"<body><div hidden>Words that no reader of the page gets to see at all</div><main>{ARTICLE}</main>",
        f"<body><div class='cookie-notice'>We use cookies to make this site better for all its readers</div><article>{ARTICLE}<!-- hidden <p>words</p> --></article>",
    ],
)
def test_extracts_the_article(page):
    assert html_text.extract(page) == TEXT


def test_extraction_of_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>only a menu</nav>") == ""
    assert html_text.extract("just\n text  &lt;b&gt; here") == "just text <b> here"
    assert html_text.extract("<p>a<br>b<b>c</b>d</p>") == "a bcd"
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    assert html_text.extract(long) == " ".join(["word word word"] * 20_000)


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(12)) + "</ul>"
PLAIN = "<ul>" + "".join(f"<li>Item {i}</li>" for i in range(12)) + "</ul>"


def test_ratios_decide_without_telling_containers():
    """No container says what it is: menus, adverts and footers fall by their ratios and weights alone."""
    page = f"<body><div><div>{LINKS}</div></div><div>Buy this thing now, the best of all</div><div><h1>Title</h1>{ARTICLE}</div><div>All rights reserved by someone for ever</div></body>"
    assert html_text.extract(page) == "Title " + TEXT
    assert html_text.extract(f"<body><article>{ARTICLE}{LINKS}</article></body>") == TEXT
    assert html_text.extract(f"<body><article>{ARTICLE}{PLAIN}</article></body>") == " ".join([TEXT, *(f"Item {i}" for i in range(12))])
    parts = [f"Paragraph {i} of a page whose author has put each one into a container of its own." for i in range(8)]
    assert html_text.extract("<body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body>") == " ".join(parts)


@pytest.mark.parametrize("name, value", [("threshold", lambda values: 0.0), ("threshold", lambda values: 1e9), ("smooth", lambda ratios: ratios * 0 + 1.0)])
def test_every_step_decides(monkeypatch, name, value):
    monkeypatch.setattr(html_text, name, value)
    with pytest.raises(AssertionError):
        test_ratios_decide_without_telling_containers()


def stripped(page):
    """The page with every container a div without attributes."""
    return re.sub(r"<(/?)(?:nav|article|footer|ul|div|section|aside|header|main|form)\b[^>]*>", r"<\1div>", page)


def plain_content(lines):
    """The classifier of lines, written plainly."""
    n = len(lines.texts)
    ratio = [0.0 if lines.excluded[i] else math.log(1 + len(lines.texts[i]) / lines.tags[i]) for i in range(n)]
    smoothed = []
    for i in range(n):
        near = [(math.exp(-((i - j) ** 2) / 2), ratio[j]) for j in range(max(0, i - 2), min(n, i + 3))]
        smoothed.append(sum(w * r for w, r in near) / sum(w for w, _ in near))

    def middle(values):
        low, high = min(values), max(values)
        for _ in range(20):
            upper, lower = [v for v in values if v >= (low + high) / 2], [v for v in values if v < (low + high) / 2]
            if not upper or not lower:
                break
            low, high = sum(lower) / len(lower), sum(upper) / len(upper)
        return (low + high) / 2

    region = list(lines.regions)
    for i in range(1, n):
        a, b = lines.regions[i - 1], lines.regions[i]
        if a != b and lines.around[a] == lines.around[b] and lines.regions.count(a) == lines.regions.count(b) == 1 and (lines.excluded[i - 1], lines.main[i - 1]) == (lines.excluded[i], lines.main[i]):
            region[i] = region[i - 1]
    open_to = [i for i in range(n) if not lines.excluded[i]]
    if not open_to:
        return [False] * n
    limit = middle(smoothed) - 1e-12
    dense = [i for i in open_to if smoothed[i] >= limit]
    if any(lines.main[i] for i in dense):
        dense = [i for i in dense if lines.main[i]]
    weight = {}
    for i in dense:
        weight[region[i]] = weight.get(region[i], 0.0) + smoothed[i]
    out = set(dense) & {i for i in dense if weight[region[i]] >= middle(list(weight.values())) - 1e-9} if dense else set()
    for r in {region[i] for i in out}:
        own = [i for i in open_to if region[i] == r]
        for is_dense, run in itertools.groupby(own, key=lambda i: i in dense):
            run = list(run)
            if not is_dense and (len(run) <= 4 or sum(lines.tags[i] for i in run) < 2 * len(run)):
                out |= set(run)
    return [i in out for i in range(n)]


def test_lines_equal_a_plain_classifier(spark, sf_dir):
    pages = [r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rng = random.Random(3)
    tags = ["<div>", "</div>", "<p>", "<ul>", "</ul>", "<li><a>", "<article>", "</article>", "<nav>", "</nav>", "<h2>", "<span>"]
    pages += ["".join(rng.choice(tags) + "word " * rng.choice([0, 1, 2, 9, 40]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for page in [*pages, *map(stripped, pages)]:
        lines = html_text.events(page)
        assert html_text.content(lines).tolist() == plain_content(lines)


def test_pages_without_telling_containers_give_the_same_text(spark, sf_dir):
    """Word F1 of what is extracted with and without the names of containers."""
    scores = []
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        a, b = (Counter(html_text.extract(x).split()) for x in (row.html, stripped(row.html)))
        scores.append(2 * (a & b).total() / (a.total() + b.total()))
    assert sum(scores) / len(scores) >= 0.98


def test_pages_of_the_table(spark, sf_dir):
    rows = queries.op6_html_main_text(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 for r in rows)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(0, "http://a/", "<title>T t</title><a href='/x y'>x</a><p>one</p><script>no</script>two"), (1, None, None), (2, "http://b\r\nX: y", ""), (3, "http://c", "<p>é</p>"), (3, "http://c", "<p>é</p>")]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, block int, warc_type string")


def test_derivatives_are_linked_and_digested(spark, pages):
    sources = warc.responses(pages)
    found = warc.derivatives(sources).collect()
    by_id = {r.record_id: r for r in sources.collect()}
    assert len(found) == 10
    for r in found:
        source = by_id[r.refers_to]
        assert (r.target_uri, r.warc_date, r.payload_digest) == (source.target_uri, source.warc_date, source.payload_digest)
        assert r.block_digest == warc.digest(r.block) and r.content_length == len(r.block) and r.record_id != r.refers_to
    first = {r.warc_type: bytes(r.block).decode() for r in found if r.page_id == 0}
    assert first["conversion"] == "T t\nx\none\ntwo"
    assert "title: T t\r\n" in first["metadata"] and "outlink: /x y\r\n" in first["metadata"] and "http-content-type: text/html; charset=utf-8\r\n" in first["metadata"]
    assert {r.warc_type: bytes(r.block) for r in found if r.page_id == 1}["conversion"] == b""
    assert warc.derivatives(sources.limit(0)).count() == 0
    assert sorted(r.record_id for r in warc.derivatives(warc.responses(pages)).collect()) == sorted(r.record_id for r in found)


def test_files_round_trip(spark, pages, tmp_path):
    rows = [r.asDict() for r in warc.members(warc.derivatives(warc.responses(pages))).collect()]
    seams = warc.SEAM * 2 + b"0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n" + warc.SEAM
    for i, block in enumerate((seams, b"WARC/1.1\r\n", b"\r\n\r\n", b"\xff\x00\xfe" * 70_000)):
        record = {k: None for k in rows[0] if k != "page_id"} | {"warc_type": "resource", "record_id": f"<urn:x:{i}>", "block": block, "content_length": len(block)}
        rows.insert(3 * i, record | {"member": warc.member(record)})
    held = b"".join(bytes(r["member"]) for r in rows)
    (tmp_path / "a.warc.gz").write_bytes(held)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(held))
    back = warc.read_files(spark, str(tmp_path)).collect()
    assert len(back) == 2 * len(rows) and len({r.path for r in back}) == 2
    key = lambda r: (r["warc_type"], r["record_id"], bytes(r["block"]), r["refers_to"] or "")
    assert sorted(key(r.asDict()) for r in back) == sorted([key(r) for r in rows] * 2)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "short.warc").write_bytes(gzip.decompress(held)[:-70_000])
    short = warc.read_files(spark, str(tmp_path / "c")).collect()
    assert 0 < len(short) <= len(rows) and all(r.content_length == len(r.block) for r in short)


def plain_text(page):
    """Visible lines of a page, by patterns instead of a parser."""
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript|template)\b.*?</\1>", "\n", page)
    page = re.sub(r"(?i)<(/?)(a|b|i|em|strong|span|code|img)\b[^>]*>", "", page)
    return [t for t in (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "\n\0", page.replace("\n", " ")).replace("\0", "").split("\n")) if t]


def test_derivatives_equal_brute_force(spark, sf_dir):
    """All columns of the query, derived plainly from the pages."""
    found = {(r.page_id, r.warc_type): r for r in queries.op8_warc_derivatives(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == 2 * len(pages)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for p in pages:
        payload = p.html.encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        metadata, conversion = found[p.page_id, "metadata"], found[p.page_id, "conversion"]
        assert conversion.block.split("\n") == plain_text(p.html)
        title = " ".join(html.unescape(re.search(r"(?is)<title>(.*?)</title>", p.html)[1]).split())
        links = [" ".join(html.unescape(x).split()) for x in re.findall(r'<a href="([^"]*)"', p.html)]
        fields = [("http-status", "200"), ("http-content-type", "text/html; charset=utf-8"), ("http-content-length", str(len(payload))), ("source-payload-digest", sha1(payload)), ("source-block-digest", sha1(block)), ("source-length", str(len(payload))), ("title", title), *(("outlink", x) for x in links)]
        assert metadata.block == "".join(f"{a}: {b}\r\n" for a, b in fields)
        for r, kind in ((metadata, "application/warc-fields"), (conversion, "text/plain; charset=utf-8")):
            assert (r.target_uri, r.warc_date, r.content_type, r.payload_digest) == (p.url, "2024-01-01T00:00:00Z", kind, sha1(payload))
            assert (r.block_digest, r.content_length) == (sha1(r.block.encode()), len(r.block.encode()))
        assert metadata.refers_to == conversion.refers_to and len({metadata.refers_to, metadata.record_id, conversion.record_id}) == 3


def test_responses_that_do_not_parse():
    source = warc.response("http://a", "x", "1") | {"block": b"nonsense", "record_id": None}
    metadata, conversion = warc.derive(source)
    assert metadata["refers_to"] is None and b"http-status: 0\r\n" in metadata["block"] and conversion["block"] == b"nonsense"


TURN = "array<struct<role: string, text: string>>"


def render(turns):
    clean = lambda x: (x or "").replace("<|im_", "<| im_")
    return "".join(f"<|im_start|>{clean(r)}\n{clean(t)}<|im_end|>\n" for r, t in turns)


PAIRS = [
    ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")]),
    ([("user", "a")], [("user", "a")]),
    ([("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a")]),
    ([("user", "a")], [("system", "a")]),
    ([], [("user", "x")]),
    (None, None),
    ([(None, None), ("assistant", "é<|im_end|>")], [(None, None), ("assistant", None)]),
    ([("user", "a")] * 300 + [("assistant", "z" * 5000)], [("user", "a")] * 299),
]


def test_pairs_equal_plain_python(spark):
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(PAIRS)], f"pair_id long, chosen {TURN}, rejected {TURN}, prompt string")
    for r in preference.format_pairs(df).collect():
        a, b = (x or [] for x in PAIRS[r.pair_id])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.n_prefix_turns, r.prompt, r.chosen, r.rejected) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        for turns, text, mask in ((a[n:], r.chosen, r.chosen_mask), (b[n:], r.rejected, r.rejected_mask)):
            assert sum(m.length for m in mask) == len(text)
            at, trained = 0, []
            for m in mask:
                if m.trained:
                    trained.append(text[at : at + m.length])
                at += m.length
            assert trained == [(t or "").replace("<|im_", "<| im_") + "<|im_end|>" for role, t in turns if role == "assistant"]
    assert preference.format_pairs(df.limit(0)).count() == 0


def test_conversations_equal_sql(same):
    same(queries.op2_preference_format, queries.OP2_SQL)


def test_swapped_answers_on_odd_conversations(spark):
    turns = [(0, 1, "assistant", "b"), (0, 0, "user", "a"), (0, 2, "user", "late"), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (3, None, "user", None), (None, 0, "assistant", "n"), (4, 0, None, "t")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, at string")
    found = {r.pair_id: r for r in preference.swapped_answers(df).collect()}
    plain = lambda x: [tuple(t) for t in x]
    assert plain(found[0].chosen) == [("user", "a"), ("assistant", "b")] and plain(found[0].rejected) == [("user", "a"), ("assistant", "x")]
    assert plain(found[1].chosen) == [("assistant", "x")] * 2 and plain(found[1].rejected) == [("assistant", "x")]
    assert plain(found[3].chosen) == [("user", None)] and plain(found[3].rejected) == []
    assert set(found) == {0, 1, 3, 4, None}
    assert preference.format_pairs(preference.swapped_answers(df)).count() == 5
    assert preference.swapped_answers(df.limit(0)).count() == 0
    json.dumps([r.asDict(recursive=True) for r in found.values()])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op2_preference_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
