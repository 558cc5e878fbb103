"""Page text, URL rules and trees, WARC archives."""
import gzip
import re
import time
import zlib
from hashlib import sha1

import numpy as np
import pytest

from sparkraster.llm import html_text, url_filter, warc

PAGES = "page_id bigint, url string, html string, text string, host string, path string, features int, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, 1) for r in rows], PAGES)


# page text

PLAIN = ("<html><head><title>T</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>buy now, please.</div>"
         "<article><h1>Heading &amp; more</h1><p>First   block,\n with <b>bold</b> text and a&nbsp;space.<p>Second block&#33; It is long enough to be text.</article><footer>&copy; someone</footer></body></html>")
WANT = "Heading & more\nFirst block, with bold text and a space.\nSecond block! It is long enough to be text."


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(html_text.training_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def test_pages_of_the_table_give_their_article(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()

    def plain(h):
        a = re.search(r"(?s)<article>(.*?)</article>", h)[1]
        from html import unescape
        return "\n".join(x for x in (" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", a)) if x)
    good = sum(model.text(r[0]) == plain(r[0]) for r in rows)
    assert good >= 0.98 * len(rows)


def test_parts_of_other_kinds_stay_out(model):
    assert model.text(PLAIN) == WANT
    p = "It goes on for some time, with clauses and stops. That is how articles are."
    page = (f"<body><header><h1>Site</h1></header><div class='cookie-banner'><p>We use cookies. {p}</p></div><div class='wrap'><div class='menu'><a href=a>One</a></div>"
            f"<div class='post-content'><h2>Title</h2><p>{p}</p><aside class='related'><p>Read this too.</p></aside><ul><li>{p}</li></ul></div><div class='sidebar'><p>{p}</p></div>"
            f"<section id='comments'><div class='comment'><p>I think otherwise, {p}</p></div></section><form><p>Sign up</p></form></div><footer><p>{p}</p></footer>")
    assert model.text(page) == f"Title\n{p}\n{p}"


def test_marginals_are_exact():
    """Against the sum over all states of a small tree."""
    nodes = html_text.parse("<div><p>a b c</p><div><p>d</p>e<ul><li>f</li></ul></div></div>")
    rng = np.random.default_rng(1)
    own, pair = rng.normal(size=len(nodes)), rng.normal(size=(3, 4))
    at = {id(n): i for i, n in enumerate(nodes)}
    total = np.zeros((len(nodes), 2))
    for s in range(1 << len(nodes)):
        y = [s >> i & 1 for i in range(len(nodes))]
        w = np.exp(sum(o * v for o, v in zip(own, y)) + sum(pair[html_text.kind(n), 2 * y[at[id(n.parent)]] + y[i]] for i, n in enumerate(nodes) if n.parent is not None))
        for i, v in enumerate(y):
            total[i, v] += w
    assert np.allclose(html_text.marginals(nodes, own.tolist(), pair.tolist()), np.log(total[:, 1] / total[:, 0]))


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "<"), (5, "u", "</p></div>text only, without any tag. It is long enough."), (6, "u", "<p>" * 3000 + "x"), (None, "u", PLAIN), (7, "u", PLAIN), (7, "u", PLAIN),
            (8, "u", "<article>" + "<p>Long text, again and again. More of it.</p>" * 5000 + "</article>"), (9, "u", "<article><p>a &lt;b&gt; &#x41;&eacute; c</p></article>"), (10, "u", "<script>only</script>")]
    got = html_text.extract(pages(spark, rows), model).collect()
    t = {}
    for r in got:
        t.setdefault(r["page_id"], []).append(r["text"])
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert t[1] == t[2] == t[3] == t[10] == [""] and t[None] == [WANT] and t[7] == [WANT, WANT]
    assert t[8][0].count("\n") == 4999 and t[9] == ["a <b> Aé c"]
    assert html_text.extract(pages(spark, rows).filter("false"), model).count() == 0
    assert html_text.train([]).text(PLAIN)


# urls

def plain_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_rules(spark):
    urls = ["https://WWW.Example.com/en/1", "http://example.com/en/", "http://a.example.com/en/x?y#z", "http://example.com/fr/1", "http://x.net/es/a", "http://x.net/fr", "http://x.net/de/", "http://com/", "http://com", "http://notcom/",
            "http://xexample.com/en/", "http://www.example.com.net/fr/", None, "", "no scheme", "a://b://c.com/en/", "http://É.com/", "http://x.org/?a=b&c=1", "http://x.com?q=/en/", "http://example.com/en/\nx", "http://x.net/es/a", "h://" + "a" * 50000 + ".com/" + "b/" * 20000]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], None), (3, urls[3], None)]
    p = pages(spark, rows)
    labelled = spark.createDataFrame([(f"http://ads{i}.example.org/{i}?x=1&y=2&z=3", 1) for i in range(40)] + [(f"http://site{i}.example.org/page", 0) for i in range(40)] + [(None, 1), (urls[0], None)], "url string, bad int")
    for lab in (labelled, labelled.filter("bad = 1")):
        got = url_filter.judge(p, lab, url_filter.rule_table(spark)).collect()
        assert len(got) == len(rows)
        seen = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=str)
        assert seen == sorted(((i, *plain_judge(u)[:3]) for i, u, _ in rows), key=str)
        for r in got:
            assert r["verdict"] == (plain_judge(urls[r["page_id"] or 0])[3] or ("block" if r["probability"] >= 0.5 else "allow"))
    assert url_filter.judge(p.filter("false"), labelled, url_filter.rule_table(spark)).count() == 0


def test_trees_learn_lexical_marks(spark):
    def url(i, bad):
        return f"http://{'x9-k3' if bad else 'news'}{i}.example.org/{'p?a=1&b=22&c=333&d=4' if bad else 'story/today'}"
    lab = spark.createDataFrame([(url(i, i % 2), i % 2) for i in range(200)], "url string, bad int")
    p = pages(spark, [(i, url(1000 + i, i % 2), None) for i in range(100)])
    got = url_filter.judge(p, lab, url_filter.rule_table(spark)).collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 95


def test_suffix_figures_cover_all_labelled_urls(spark):
    """20,000 suffixes of five labelled urls each, many more than the sample holds; only the suffix tells bad from good."""
    lab = spark.range(100_000).selectExpr("concat('http://h', id div 20000, '.s', lpad(id % 20000, 5, '0'), '.org/p') url", "cast(id % 2 as int) bad")
    p = spark.range(20_000).selectExpr("id page_id", "concat('http://h9.s', lpad(id, 5, '0'), '.org/p') url")
    got = url_filter.judge(p, lab, url_filter.rule_table(spark)).collect()
    assert len(got) == 20_000 and sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 19_800


def test_labels_are_not_read_off_suffixes_of_one_url(spark):
    """The path tells nine in ten; the own label in a suffix's figures would tell all of the sample and none of the pages."""
    def url(i, bad, base):
        return f"http://www.{base}{i:05}.org/{'p?a=1&b=22&c=333&d=4' if bad != (i % 20 in (4, 7)) else 'story/today'}"
    lab = spark.createDataFrame([(url(i, bool(i % 2), "s"), i % 2) for i in range(2000)], "url string, bad int")
    p = pages(spark, [(i, url(i, bool(i % 2), "s"), None) for i in range(2000)] + [(5000 + i, url(i, bool(i % 2), "n"), None) for i in range(400)])
    got = [r for r in url_filter.judge(p, lab, url_filter.rule_table(spark)).collect() if r["page_id"] >= 5000]
    assert len(got) == 400 and sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 340


# archives

def test_round_trip(spark):
    big = "<p>" + "long é " * 400
    rows = [(1, "http://a/\r\nx", big), (2, "http://b", big), (9, None, big), (3, "u", None), (4, "u", ""), (5, "u", "same small"), (6, "u", "same small"), (7, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (None, "u", "z" * 2000),
            (12, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50), (13, "u", "é" * 2_000_000)]
    mono = warc.write_monolithic(warc.decide(pages(spark, rows)), archive_bytes=5000)
    normal = warc.normalise(mono).cache()
    got = {r["page_id"]: r for r in warc.read_members(normal).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None and len(b) >= 1000]
        keep = max(same, default=i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), sha1(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
    before = b"".join(gzip.decompress(r["content"]) for r in mono.orderBy("archive").collect())
    for r in mono.collect():
        z = zlib.decompressobj(31)
        z.decompress(r["content"])
        assert z.eof and not z.unused_data  # one member
    after = normal.orderBy("archive").collect()
    assert b"".join(gzip.decompress(r["content"]) for r in after) == before
    at = {r["archive"]: r["content"] for r in after}
    side = warc.sidecar(normal).collect()
    assert len(side) == len(rows)
    for s in side:
        z = zlib.decompressobj(31)
        raw = z.decompress(at[s["archive"]][s["offset"]:s["offset"] + s["length"]])
        assert z.eof and raw.startswith(b"WARC/1.1\r\n") and s["record_id"].encode() in raw
    assert warc.read_members(warc.normalise(warc.write_monolithic(warc.decide(pages(spark, rows).filter("false"))))).count() == 0


def test_damaged_and_mixed_streams():
    raw = warc.record_bytes(1, "u", b"abc", sha1(b"abc").hexdigest(), None)
    mixed = gzip.compress(raw + raw) + b"\0" * 20 + gzip.compress(raw)
    assert list(warc.inflate_records(mixed)) == [raw] * 3
    assert list(warc.inflate_records(b"")) == []
    with pytest.raises((ValueError, zlib.error)):
        list(warc.inflate_records(gzip.compress(raw + raw[:-10])))


def blocks_of(html):
    return [n.text for n in html_text.parse(html) if n.tag == "#text" and n.text]


def test_pages_with_odd_markup_are_read():
    assert blocks_of("<p>a</p><![foo[bar]]><p>b</p>") == ["a", "b"]
    assert blocks_of("<p>x</p><![if !IE]><p>y</p><![endif]>") == ["x", "y"]
    assert blocks_of("<p>the value <math><mi>x</mi></math> holds") == ["the value x holds"]
    assert blocks_of("<p>press <svg><path/><g><title>t</title></g></svg> now</p>") == ["press now"]
    assert blocks_of("<p>an <x-icon>odd</x-icon> <nobr>tag</nobr> and <output>out</output></p><div>next</div>") == ["an odd tag and out", "next"]
    assert blocks_of("<div><a>in<p>par</b></div>after</i>") == ["in", "par", "after"]


@pytest.mark.parametrize("html", ["<div>" * 20000 + "x", "<i>b</b>" * 20000, "<p><table><td>" + "<div>" * 20000 + "y", "<b><div>" + "<i></b>" * 20000 + "z", "<a>" * 20000 + "w"])
def test_deep_pages_take_linear_time(html):
    t = time.time()
    d = html_text.Dom()
    d.feed(html)
    d.close()
    assert time.time() - t < 3 and len(d.nodes) > 1


def test_ids_beyond_doubles_and_null_ids_come_back(spark):
    big = "long enough " * 200
    rows = [(9007199254740993, "u", big), (9007199254740995, "v", big), (None, "w", big), (9223372036854775807, "x", "short"), (None, None, None), (7, "y", "only nulls " * 200), (None, "z", "no id " * 300), (None, "z", "no id " * 300)]
    got = warc.read_members(warc.normalise(warc.write_monolithic(warc.decide(pages(spark, rows))))).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(9007199254740993, "revisit", 9007199254740995), (9007199254740995, "response", None), (None, "revisit", 9007199254740995), (9223372036854775807, "response", None),
                                                       (None, "response", None), (7, "response", None), (None, "response", None), (None, "response", None)], key=str)
