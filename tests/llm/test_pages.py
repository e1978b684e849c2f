"""Archives and page text, the registered queries, and the pipeline."""

import base64
import hashlib
from collections import Counter

import pytest

from hostlens.llm import html_text, queries, warc
from hostlens.llm.common import batches

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>%s
<div id="comments"><p>A reader's comment, long enough to look like text of the article itself.</p></div><footer>&copy; x</footer>"""
ARTICLE = "<article><h1>Head&amp;line</h1><p>One  two\n three <b>four<br>five &lt;six&gt;.<p>Short.<div class='ad'>Buy</div><form>Mail <input></form><p>End&nbsp;here.</article>"


def test_article_and_unmarked_body():
    want = "Head&line\nOne two three four five <six>.\nShort.\nEnd here."
    assert html_text.main_text(PAGE % ARTICLE) == want
    plain = "".join(f"<p>Paragraph {i} of the running text, which is long enough to count.</p>" for i in range(5))
    assert html_text.main_text(PAGE % f"<div><h1>Title</h1>{plain}</div>").split("\n")[0] == "Title"
    assert html_text.main_text(PAGE % plain).count("\n") == 4


PROSE = [f"Paragraph {i} of the running text, " + "which goes on for some while and " * 8 + "ends." for i in range(6)]


def body(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_surges_choose_among_marked_lines():
    # A second marked element behind a dive, without a surge of its own.
    page = PAGE % f"<article>{body(*PROSE)}</article>{'<div>Other</div>' * 3}<article><p>Tiny card</p></article>"
    assert html_text.main_text(page).split("\n") == PROSE
    # Furniture inside the article does not part it.
    page = PAGE % f"<article>{body(*PROSE)}<aside>{body('a', 'b', 'c', 'd')}</aside><p>Short end.</p></article>"
    assert html_text.main_text(page).split("\n") == [*PROSE, "Short end."]


def test_surges_and_dives_equal_plain_loops():
    import random

    import numpy as np

    def plain(weights, headings):
        n = len(weights)
        if not any(weights):
            return [False] * n
        sums = [sum(weights[i : i + html_text.WINDOW]) for i in range(n)]
        usual = sorted(w for w in weights if w >= min(html_text.PARAGRAPH[0], max(weights)))
        bar = html_text.SURGE * min(max(sums), html_text.WINDOW * min(usual[(len(usual) - 1) // 2], html_text.PARAGRAPH[1]))
        kept, done = [False] * n, 0
        for i in range(n):
            if i < done or sums[i] <= bar:
                continue
            start, end = i, i
            while start > 0 and (weights[start - 1] > 0 or headings[start - 1]):
                start -= 1  # the foot of the surge
            while weights[start] == 0 and not headings[start]:
                start += 1
            while end < n and sums[end] > 0:
                end += 1  # the dive
            for j in range(start, end):
                kept[j] = True
            done = end + 1
        return kept

    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randint(1, 25)
        weights = [rng.choice([0, 0, 0, 5, 30, 90, 400, 3000]) for _ in range(n)]
        headings = [rng.random() < 0.15 for _ in range(n)]
        assert html_text.between(np.array(weights), np.array(headings)).tolist() == plain(weights, headings), (weights, headings)


def test_teaser_cards_do_not_hide_the_text():
    cards = "".join(f'<article class="more-stories"><h3><a href="/{i}">Story {i}</a></h3><p>Teaser {i}.</p></article>' for i in range(3))
    links = "".join(f'<div><a href="/l{i}">More {i}</a></div>' for i in range(4))
    assert html_text.main_text(PAGE % f'<div class="content">{body(*PROSE)}</div>{links}{cards}').split("\n") == PROSE
    only = "".join(f'<p><a href="/{i}">Entry {i} of a long list of links</a></p>' for i in range(9))
    assert html_text.main_text(PAGE % f"<article>{only}</article><div>Hi</div>").count("\n") == 8


def test_parts_of_unmarked_text():
    links = "".join(f'<div><a href="/l{i}">Elsewhere {i}</a></div>' for i in range(3))
    code = "<pre>" + "x = 1; " * 3000 + "</pre>"
    assert [t for t in html_text.main_text(PAGE % f"<div>{code}{links}{body(*PROSE)}</div>").split("\n")[1:]] == PROSE
    form = "<form>" + body("Name", "Mail", "Send") + "</form>"
    advert = "<div class=advert>" + body("Buy", "this", "now") + "</div>"
    assert html_text.main_text(PAGE % f"<div>{body(*PROSE)}{form}<p>Short part.</p>{advert}<p>End.</p></div>").split("\n") == [*PROSE, "Short part.", "End."]
    heading = '<h2><a href="#own">Own link</a></h2>'
    assert html_text.main_text(PAGE % f"<div>{heading}{body(PROSE[0])}{heading}{body(PROSE[1])}</div>").split("\n") == ["Own link", PROSE[0], "Own link", PROSE[1]]


@pytest.mark.parametrize("page, text", [("", ""), ("a < b & c", "a < b & c"), ("<p>x</p><script>1<2", "x"), ("<!-- <p>no</p> -->yes", "yes"), ("<p>open <a ", "open"), ("<nav>only</nav>", "")])
def test_fragments(page, text):
    assert html_text.main_text(page) == text


def test_long_pages_take_linear_time():
    for page in ("<a " + 'x"' * 100_000, "<a" * 100_000, "<div>" * 50_000 + "x", "<p>" + "word " * 200_000, "&amp;" * 100_000):
        html_text.main_text(page)


@pytest.fixture(scope="module")
def pages(spark):
    big = "big payload é " * 200_000
    rows = [(5, "http://a/5", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (9, None, "<p>x</p>"), (4, "u", None), (6, "u", ""), (7, "u\r\nv", big), (8, "u", big), (None, "u", "<p>x</p>")]
    rows += [(10, "u", "has WARC/1.1\r\nWARC-Type: x\r\n\r\nin it\r\n\r\nWARC/1.1\r\n"), (11, "u", "\r\n\r\n"), (12, "u", "twice"), (12, "u", "twice")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as record_id", "1 as chunk").repartition(3)


def expected(rows, least_bytes=0):
    first = {}
    for page_id, _, page in rows:
        if page_id is not None:
            first[page or ""] = min(first.get(page or "", page_id), page_id)
    out = []
    for page_id, _, page in rows:
        data = (page or "").encode()
        revisit = len(data) >= least_bytes and first.get(page or "") != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[page or ""] if revisit else None, True))
    return out


@pytest.mark.parametrize("least_bytes", [0, 9])
def test_archives(spark, pages, least_bytes):
    rows, df = pages
    got = warc.round_trip(df, least_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows, least_bytes)))
    assert warc.round_trip(df.limit(0)).collect() == []


def test_chunks_carry_digests(spark, pages, tmp_path, monkeypatch):
    rows, df = pages
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    warc.write(df, str(tmp_path / "w"))
    chunks = [r for r in warc.read(spark, str(tmp_path / "w")).collect() if r["page_id"] == 7]
    payload = rows[5][2].encode()
    assert len(chunks) == -(-len(payload) // warc.CHUNK)
    so_far = b""
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        so_far += bytes(r["data"])
        assert (r["bytes_so_far"], r["digest_so_far"]) == (len(so_far), base64.b32encode(hashlib.sha1(so_far).digest()).decode())
    assert so_far == payload


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0\r\nWARC-Type: none\r\n\r\n</p>"
    sha1 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    big = bytes(range(256)) * 9000
    blocks = [
        ("1.0", {"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:i>", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        ("1.0", {"warc-type": "response", "warc-record-id": "<urn:uuid:r>", "WARC-TARGET-URI": "<http://a.com/x:y>", "WARC-Block-Digest": "sha1:" + sha1(body), "WARC-Payload-Digest": "sha1:OTHER"}, body),
        ("1.1", {"WARC-Type": "request", "WARC-Record-ID": "q"}, b""),
        ("1.1", {"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:b>", "WARC-Block-Digest": "sha1:WRONG"}, big),
        ("1.1", {"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:n>"}, b"\n\n"),
    ]
    data = b"".join(f"WARC/{v}\r\n{''.join(f'{k}: {x}' + chr(13) + chr(10) for k, x in h.items())}content-length:  {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for v, h, b in blocks)
    with gzip.open(tmp_path / "other.warc.gz", "wb") as f:
        f.write(data)
    chunks = warc.read(spark, str(tmp_path)).collect()
    joined = {}
    for r in sorted(chunks, key=lambda r: (r["record_id"], r["chunk"])):
        assert len(r["data"]) <= warc.CHUNK
        joined[r["record_id"]] = joined.get(r["record_id"], b"") + bytes(r["data"])
    assert joined == {"i": b"software: x\r\n", "r": body, "q": b"", "b": big, "n": b"\n\n"}
    found = {r["record_id"]: r for r in warc.records(warc.read(spark, str(tmp_path), with_data=False)).collect()}
    assert {k: (r["record_type"], r["whole"], r["page_id"]) for k, r in found.items()} == {
        "i": ("warcinfo", True, None), "r": ("response", True, None), "q": ("request", True, None), "b": ("resource", False, None), "n": ("resource", True, None),
    }
    assert found["r"]["url"] == "http://a.com/x:y" and found["b"]["payload_bytes"] == len(big)


def test_version_lines_in_a_payload_take_linear_time():
    import time

    def seconds(n):
        payload = (warc.VERSION + "x" * 9).encode() * n
        whole = warc._header("response", "r", len(payload), {"Payload-Length": len(payload), "WARC-Payload-Digest": "sha1:X"}) + payload + warc.END.encode()
        reader, start = warc._Reader(True), time.perf_counter()
        rows = [r for p in whole.split(warc.MARK.encode()) for r in reader.pieces(p)]
        assert b"".join(r[-1] for r in rows) == payload and not reader.held
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 60 * max(seconds(2_000), 0.002)


def test_page_rows(pages):
    rows, df = pages
    got = html_text.extract(df).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter((i, html_text.main_text(p or "")) for i, _, p in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and html_text.extract(df.limit(0)).collect() == []


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 5, None, "b" * 20, "", "c"]})
    assert [b.column("t").to_pylist() for b in batches([batch], 8, "t")] == [["aaaaa", None], ["b" * 20], ["", "c"]]


def test_every_operator_is_registered():
    numbers = Counter(name.split("_")[0] for name in queries.QUERIES)
    assert numbers == Counter([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert pieces and {p["doc_id"] for p in pieces} <= ids
    by_sequence = Counter()
    for p in pieces:
        by_sequence[p["sequence_id"]] += p["length"]
    assert sum(n == 2048 for n in by_sequence.values()) >= len(by_sequence) - 1
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {p["doc_id"] for p in pieces}
    assert sum(marks.get(i) == 0 for i in kept) == 0
