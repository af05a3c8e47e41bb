"""HTML extraction and WARC revisits."""

import gzip

from strandline.llm import html_text, warc

PAGE = "page_id bigint, url string, html string"


def test_text_of():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li>menu</li></ul></nav><div class="cookie-notice">We use</div><header><h1>Site</h1></header><main><article>
    <header><h1>Head &amp; more</h1><p>by me</p></header><p>One<br>two <b>x&eacute;<p>Three&nbsp;&lt;3<!-- no --></p>
    <aside>side</aside><div class="ad">buy</div><ul><li>a<li>b</ul><form>name <input></form><blockquote>quoted</blockquote>
    <section id="comments"><p>first!</p></section><footer>share</footer></article></main><footer>(c)</footer>"""
    assert html_text.text_of(page) == "Head & more\nOne two xé\nThree <3\na\nb\nquoted"


def test_text_of_odd_pages():
    assert html_text.text_of("") == ""
    assert html_text.text_of("plain &amp; simple") == "plain & simple"
    assert html_text.text_of("<p>cut <b>off &am") == "cut off &am"
    assert html_text.text_of("<div hidden>no</div><p style='display: none'>no</p><p>yes</p>") == "yes"
    assert html_text.text_of("<p>" * 5000 + "deep" + "<div>" * 5000 + "er").split() == ["deep", "er"]
    assert html_text.text_of("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert html_text.text_of("<article>a</article><p>out</p><article>b</article>") == "a\nb"
    assert html_text.text_of("<article><p>main</p></article><section class='comments'><article class='comment'>me too</article></section>") == "main"


def test_template_removal(spark):
    """A block that recurs over a host's pages goes; the same paragraph in articles of all pages stays, as do copies of a page."""
    rows = [(i, f"http://a.example/{i}", f"<body><div><span>Call us now</span></div><div><p>story {i} here</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>Shared paragraph.</p><p>own {i}</p><div><i>Follow our feed</i></div></article>") for i in range(30)]
    rows += [(200 + i, f"http://c.example/{i}", "<body><div><p>copied page</p></div></body>") for i in range(30)]
    rows += [(300, None, None), (301, "", ""), (302, "http://d.example/", "<div>only</div>"), (302, "http://d.example/", "<div>only</div>")]
    got = {(r["page_id"]): r for r in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i]["text"] == f"story {i} here" for i in range(30))
    assert all(got[100 + i]["text"] == f"Shared paragraph.\nown {i}" for i in range(30))
    assert all(got[200 + i]["text"] == "copied page" for i in range(30))
    assert (got[300]["text"], got[300]["n_chars"], got[302]["text"], got[302]["n_chars"]) == ("", 0, "only", 4)
    assert html_text.extract(spark.createDataFrame([], PAGE)).count() == 0
    assert html_text.extract(spark.createDataFrame(rows, PAGE)).count() == len(rows)


def test_text_of_names():
    """Inside an article a name counts whole, and not on paragraphs."""
    page = "<article><div class='share-price'><p>The share price rose.</p></div><p class='notice'>two</p><div class='cookie-notice'>no</div><ul class='share'><li>no</li></ul><div class='ad-300x250'>no</div><div id='discomments'>yes</div></article>"
    assert html_text.text_of(page) == "The share price rose.\ntwo\nyes"


def test_text_of_deep_and_long():
    deep = "<div>" * 100_000
    assert html_text.text_of(f"<article><header>{deep}<h2>Title</h2></header><p>body</p></article>") == "Title\nbody"
    assert html_text.text_of(f"<article>{'<p>word' * 100_000}</article>").count("\n") == 99_999
    assert html_text.text_of(f"{deep}{'</p></span>' * 1000}end") == "end"
    root = html_text.parse(f"<nav>{deep}menu</nav>")
    assert len(html_text.subtrees(root, html_text.main_parts(root))) == 100_001


def test_template_counts_brute_force(spark):
    """Subtrees of whole pages are counted as a plain count over another parser's trees does, and deleted from ten unlike pages on."""
    import random
    import xml.etree.ElementTree as ET
    from collections import defaultdict

    rng = random.Random(3)
    rows, host_of = [], ["h0.example", "h0.example", "h1.example", "h2.example"]
    for i in range(160):
        host = rng.choice(host_of)
        pick = lambda n: rng.randrange(n)  # noqa: E731, B023
        body = f"<nav><ul>{''.join(f'<li>item {pick(20)}</li>' for _ in range(3))}</ul></nav><div><span>promise {pick(6)}</span></div>"
        body += f"<article><p>same words</p><p>own {i // 2 * 2}</p><section><p>follow {pick(4)}</p></section><table><tr><td>cell {pick(3)}</td></tr></table></article><footer>by {host}</footer>"
        rows.append((i, f"https://{host}/{i}", f"<html><body>{body}</body></html>"))
    want, texts = defaultdict(set), {}

    def form(e):
        return f"<{e.tag}>{e.text or ''}{''.join(form(c) + (c.tail or '') for c in e)}</>"

    def candidates(e, inside):
        if e.tag not in ("html", "body", "article", "span") and not (inside and e.tag in ("p", "tr", "td")):
            yield e
        for c in e:
            yield from candidates(c, inside or e.tag == "article")

    for i, url, page in rows:
        root = ET.fromstring(page)
        for e in candidates(root, False):
            want[url.split("/")[2], form(e)].add(form(root.find("body/article")))
    for i, url, page in rows:
        article, out = ET.fromstring(page).find("body/article"), []
        for e in article:
            if e.tag == "p" or len(want[url.split("/")[2], form(e)]) < 10:
                out.append("".join(e.itertext()))
        texts[i] = "\n".join(out)
    made = spark.createDataFrame(rows, PAGE)
    found = html_text.page_subtrees(made)
    counts = found.select("host", "h", "main").distinct().groupBy("host", "h").count().collect()
    assert sorted((r["host"], r["count"]) for r in counts) == sorted((h, len(v)) for (h, _), v in want.items())
    assert html_text.templates(found, 10).count() == sum(len(v) >= 10 for v in want.values()) > 20
    for limit in (html_text.BROADCAST_ROWS, 0):
        assert {r["page_id"]: r["text"] for r in html_text.extract(made, broadcast_rows=limit).collect()} == texts
    assert len({t.count("\n") for t in texts.values()}) > 1


def test_extract_clashing_names(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(1, "u", "<p>x</p>")], PAGE).withColumns({n: F.lit("other") for n in ("text", "host", "h", "main", "page", "_host", "_page", "_html", "template", "n_chars")})
    assert [tuple(r) for r in html_text.extract(made).collect()] == [(1, "u", "x", 1)]


RECORD = "record_id string, type string, url string, ts bigint, status int, headers map<string,string>"


def resolve(spark, rows):
    return {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}


def test_revisits(spark):
    day = warc.BUCKET
    rows = [
        ("r1", "response", "http://www.Ex.org:80/a/?b=2&a=1&utm_source=x#f", 10, 200, {"etag": '"1"', "last-modified": "m1", "content-type": "text/html", "expires": "old"}),
        ("r2", "response", "https://ex.org/a?a=1&b=2", 5 * day, 200, {"etag": 'W/"2"', "last-modified": "m2"}),
        ("r3", "response", "https://ex.org/a?a=1&b=2", 5 * day, 404, {"etag": '"3"'}),
        ("v0", "revisit", "http://ex.org/a?a=1&b=2", 10, 304, {"etag": '"1"'}),
        ("v1", "revisit", "http://ex.org/a?a=1&b=2", 11, 304, {"etag": 'W/"1"', "expires": "new", "content-type": "no", "date": "d"}),
        ("v2", "revisit", "http://ex.org/a?a=1&b=2", 3 * day, 304, {"last-modified": "m1"}),
        ("v3", "revisit", "http://ex.org/a?a=1&b=2", 9 * day, 304, {"etag": '"1"'}),
        ("v4", "revisit", "http://ex.org/a?a=1&b=2", 9 * day, 304, None),
        ("v5", "revisit", "http://ex.org/other", 9 * day, 304, {}),
        ("v6", "revisit", None, 9 * day, 304, {}),
        ("v7", "revisit", "http://ex.org/a?a=1&b=2", None, 304, {}),
    ]
    got = resolve(spark, rows)
    assert {k: (r["response_id"], r["verdict"]) for k, r in got.items()} == {
        "v0": (None, "orphan"), "v1": ("r1", "match"), "v2": ("r1", "match"), "v3": ("r2", "mismatch"), "v4": ("r2", "unchecked"), "v5": (None, "orphan"), "v6": (None, "orphan"), "v7": (None, "orphan"),
    }
    assert got["v1"]["headers"] == {"etag": 'W/"1"', "last-modified": "m1", "content-type": "text/html", "expires": "new", "date": "d"}
    assert got["v3"]["headers"] is None and got["v3"]["status"] is None and got["v4"]["status"] == 200
    assert resolve(spark, []) == {}


def test_revisits_hot_url_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(f"x{i:04d}", rng.choice(["response", "revisit"]), "http://hot.example/", rng.randrange(40 * warc.BUCKET), 200, {}) for i in range(600)] + [(f"y{i:04d}", rng.choice(["response", "revisit"]), "http://hot.example/", rng.randrange(30), 200, {}) for i in range(200)]
    got = resolve(spark, rows)
    for k, r in got.items():
        before = [(x[3], x[0]) for x in rows if x[1] == "response" and x[3] < r["ts"]]
        assert r["response_id"] == (max(before)[1] if before else None)


def test_revisits_clashing_names_and_repeats(spark):
    from pyspark.sql import functions as F

    rows = [("r", "response", "http://e.org/", 1, 200, {"etag": "1"}), ("v", "revisit", "http://e.org", 2, 304, {"etag": "1"}), ("v", "revisit", "http://e.org", 2, 304, {"etag": "1"}), ("o", "revisit", None, 2, 304, None)]
    made = spark.createDataFrame(rows, RECORD).withColumns({n: F.lit("other") for n in ("bucket", "mark", "near", "found", "far", "url_key", "verdict", "_r", "r_status")})
    assert sorted((r["record_id"], r["verdict"], r["response_id"]) for r in warc.resolve_revisits(made).collect()) == [("o", "orphan", None), ("v", "match", "r"), ("v", "match", "r")]


def test_parse_warc(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nVary: a\r\nVary: b\r\n\r\n<p>hi</p>"
    def record(kind, n, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <u:{n}>\r\nWARC-Target-URI: http://e.org/\r\nWARC-Date: 2024-01-02T03:04:0{n}Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    data = record("response", 1, http) + record("revisit", 2, b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:150]) )
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("response", 3, http)) + gzip.compress(record("response", 4, http)))
    (tmp_path / "d.warc").write_bytes(b"junk")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    whole = {r["record_id"]: r for r in got if not r["error"]}
    assert sorted(whole) == ["<u:1>", "<u:2>", "<u:3>", "<u:4>"]
    assert whole["<u:1>"]["headers"] == {"etag": '"1"', "vary": "a, b"} and bytes(whole["<u:1>"]["body"]) == b"<p>hi</p>"
    assert sum(bool(r["error"]) for r in got) == 2
    # Of a file whose last member is cut, the records before it are kept; long ones are put together from pieces.
    members = [gzip.compress(record("response", n, http + b"x" * n * warc.PIECE)) for n in range(5)]
    for cut in (0, 5, len(members[4]) // 2, len(members[4])):
        rows = list(warc.parse(b"".join(members[:4]) + members[4][:cut]))
        whole = cut in (0, len(members[4]))
        assert [r["record_id"] for r in rows if not r["error"]] == [f"<u:{n}>" for n in range(4 + (cut > 5 and whole))]
        assert sum(bool(r["error"]) for r in rows) == (not whole) and all(len(r["body"]) == 9 + n * warc.PIECE for n, r in enumerate(rows) if not r["error"])
    assert [len(r["body"]) for r in warc.parse(b"".join(map(gzip.decompress, members)))] == [9 + n * warc.PIECE for n in range(5)]
    assert list(warc.parse(b"")) == []
    done = {r["record_id"]: r["verdict"] for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "a.warc"))).collect()}
    assert done == {"<u:2>": "match"}
