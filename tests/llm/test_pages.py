"""Main text and language of pages: by hand, on made-up sites, and on the table."""

import html
import re
from collections import Counter
from math import exp, log

import pytest

from quarry.llm import language_id, page_text
from quarry.llm.queries import op8_language_id, op9_html_extraction

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; bare", "plain & bare"),
        ("<nav>menu</nav><article><h1>A&eacute;</h1><p><b>one<br><p>t<i>w</i>o\n\t x&nbsp;y</article><footer>f</footer>", "Aé one two x y"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><script>var t='</p>';</script><p>a</p><div class='comment-list'>c</div><form>f</form></article>", "a"),
        ("<div class='sidebar'>s</div><div id=cookie-bar>k</div><p>body <a href='x'>link</a> text</p><aside>z</aside>", "body link text"),
        ("<main><p>1 < 2 and 3 > 2</p></main>", "1 < 2 and 3 > 2"),
        ("<article><header><h1>head</h1></header><p>x</p></article>", "head x"),
        ("<p title=\"a>b\">quoted</p><!-- <p>no</p> -->", "quoted"),
        ("</div></p><li>stray", "stray"),
        ('<article><p>a</p><script>var x="<body>";alert(1)</script><p>b</p></article>', "a b"),
        ("<article><p>x is <math><mi>y</mi></math> and <button>go</button> on</p><button>Share</button></article>", "x is y and go on"),
        ("<article><div class='legal'>Its legal side.</div><p class='tags-note'>Of tags.</p></article>", "Its legal side. Of tags."),
        ("<div class='post'><p>main text</p></div><section class='comments'><article><p>first!</p></article></section>", "main text"),
        ("<article><p>text</p></article><article class='comment'><p>first!</p></article>", "text"),
        ("<div class='has-sidebar'><p>a</p></div><div class='content-with-sidebar'><article><p>b</p></article></div>", "b"),
        ("<div class='sidebar-left'><article><p>held</p></article><p>no</p></div>", "held"),
        ("<nav><article><p>teaser</p></article></nav><p>body</p>", "body"),
        ("<head><title>t<p>one</p><select><p>two</p>", "one two"),
        ("<p>a</p><style>p{}", "a"),
        ("<title>t</title><p>a <svg/>b<svg><text>no</text></svg></p><template><p>no</p></template>", "a b"),
        ("<div>" * 700 + "deep" + "</div>" * 700 + "<p>after</p>", "deep after"),
        ("<article>" + "<div>" * 40 + "<p>in</p><nav>no</nav>" + "</div>" * 40 + "</article><p>out</p>", "in"),
        ("<p class=it's>one</p><p>two</p><p cut", "one two"),
    ],
)
def test_main_text(page, text):
    assert page_text.main_text(page) == text


def test_site_style_tree(spark):
    news = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    pages = [(i, f"http://a.example.org/{i}", f"<body><div class='same'>Always the same {'words ' * 5}</div><div class='news'><p>{news(i)}</p></div></body>", "e") for i in range(12)]
    pages += [(99, None, "<p>alone</p>", "e"), (98, "http://b.example.org/", None, "e"), (98, "http://b.example.org/", None, "e")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in page_text.extract(df).collect()}
    assert all(got[i] == news(i) for i in range(12)) and got[99] == "alone" and got[98] == ""
    assert page_text.extract(df.limit(0)).count() == 0


def test_tree_alone_tells_what_is_noise(spark):
    """No names, no article: deep boxes that say the same everywhere go, class names beyond the third count, boxes of an article go where 20 pages agree."""
    same, nest = "Read our other stories and follow us everywhere", "<div>" * 30
    pages, want = [], {}
    for i in range(40):
        news = " ".join(f"n{i}x{j}" for j in range(20))
        pages.append((i, f"http://deep.example/{i}", f"<body>{nest}<div class='a b c d'>{news}</div><div class='a b c e'>{same}</div>{'</div>' * 30}</body>"))
        pages.append((100 + i, f"http://art.example/{i}", f"<article><p>{news}</p><div class='x'>{same}</div><p>The same every day.</p></article>"))
        pages.append((200 + i, f"http://few{i % 14}.example/{i}", f"<article><p>{news}</p><div class='x'>{same}</div></article>"))
        want |= {i: news, 100 + i: f"{news} The same every day.", 200 + i: f"{news} {same}"}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in page_text.extract(df).collect()} == want


def test_importance_by_brute_force(spark):
    """Entropies of every node, counted page by page."""
    pages = [f"<body><div class=k>{'same' if i % 3 else i}</div><ul><li>a{i % 2}</li>{'<li>b</li>' * (i % 4)}</ul></body>" for i in range(20)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.node: r for r in page_text.style_tree(df).collect()}
    contents, shapes, lines = {}, {}, {}
    for p in pages:
        for node, _, kind, value, line in page_text.observations(p):
            (shapes if kind else contents).setdefault(node, Counter())[value] += 1
            lines[node] = line or lines.get(node)
    assert got.keys() == shapes.keys()
    for node, shape in shapes.items():
        m = sum(shape.values())
        presentation = -sum(n / m * log(n / m, m) for n in shape.values())
        below = [(sum(c.values()), 1 - sum(n * log(n) for n in c.values()) / sum(c.values()) / log(sum(shapes[x].values()))) for x, c in contents.items() if node in lines[x]]
        news = sum(n * max(0, x) for n, x in below) / sum(n for n, _ in below)
        weight = page_text.GAMMA ** len(shape)
        assert got[node].pages == m and got[node].importance == pytest.approx((1 - weight) * presentation + weight * news)


def test_a_very_long_page(spark):
    long = "<article>" + "<p>some text here</p>" * 100_000 + "<select>" * 1000 + "</article>"
    df = spark.createDataFrame([(1, "http://a.example/", long, 5)], "page_id long, url string, html string, n_chars int")
    assert page_text.extract(df).first().text == " ".join(["some text here"] * 100_000)


def test_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op9_html_extraction(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        bare = re.sub(r"<[^>]*>?", " ", re.sub(r"</?(b|i|a)\b[^>]*>", "", inner))
        assert r.text == " ".join(html.unescape(bare).split()) and r.n_chars == len(r.text)


def test_language_like_address(spark):
    rows = op8_language_id(spark, SF).collect()
    said = [(r.lang, m[1]) for r in rows if (m := re.search(r"//[^/]+/(en|fr|de|es)/", r.url))]
    assert len(said) > 100 and sum(a == b for a, b in said) / len(said) > 0.97
    assert all(0 < r.probability <= 1 for r in rows)


def test_language_evidence(spark):
    docs = spark.createDataFrame([(i, t, g) for i in range(20) for t, g in ((f"the and with from that {i}", "en"), (f"der und nicht mit das {i}", "de"))] + [(50, None, "fr"), (51, "x", None)], "doc_id long, text string, lang string")
    de = [(i, f"http://www.host.de/{i}", "<p>der und nicht mit das</p>") for i in range(8)]
    odd = [(20, "http://www.host.de/x", "<p>1</p>"), (21, None, None), (22, "http://new.com", "<html lang='de'><p></p>"), (22, "http://new.com", "<html lang='de'><p></p>")]
    df = spark.createDataFrame(de + odd, "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.identify(df, docs).collect()}
    assert got[20].lang == "de" and got[20].text_lang is None  # its host's other pages
    assert got[22].lang == "de" and got[22].declared == "de" and got[3].text_lang == "de"
    assert got[21].lang is not None
    assert language_id.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(df, docs.limit(0)).collect()} == {None}


def _domain(host):
    parts = host.split(".")
    short = len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in ("co", "com", "net", "org", "ac", "gov", "edu", "ne", "or", "go")
    return ".".join(parts[-3 if short else -2 :])


def _posteriors(pages, languages, logs):
    """Dictionaries and loops over (page_id, url, html): page_id to (language, probability)."""
    k, seen = len(languages), []
    for page_id, url, page in pages:
        host = (re.match(r"[a-z]+://([^/?#:]*)", url or "", re.I) or ["", ""])[1].lower()
        raw = page_text.main_text(page).lower().encode()
        low = [48 if 48 <= x <= 57 else x for x in raw]
        slots = [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16 for a, b, c in zip(low, low[1:], low[2:], strict=False)]
        text = [sum(float(logs[i, s]) for s in slots) * language_id.TEMPER for i in range(k)]
        text = [t - max(text) for t in text]
        said = language_id.declared(page)
        seen.append((page_id, host, text, text.index(max(text)) if slots else None, said if said is None or said in languages else "other"))
    votes = Counter()
    for _, host, _, vote, _ in seen:
        for level in {("all",), ("suffix", host.split(".")[-1]), ("domain", _domain(host)), ("host", host)}:
            votes[level, vote] += vote is not None
    heard = Counter((vote, d) for *_, vote, d in seen if vote is not None and d is not None)
    names, out = [*languages, "other"], {}
    for page_id, host, text, vote, d in seen:
        total = []
        for i in range(k):
            prior = 1 / k
            for level in (("all",), ("suffix", host.split(".")[-1]), ("domain", _domain(host)), ("host", host)):
                whole = sum(votes[level, j] for j in range(k)) - (vote is not None)
                prior = (votes[level, i] - (vote == i) + language_id.STRENGTH * prior) / (whole + language_id.STRENGTH)
            told = 0.0
            if d is not None:
                true = 0.9 if d == languages[i] else 0.1 / k
                told = log((heard[i, d] + language_id.STRENGTH * true) / (sum(heard[i, x] for x in names) + language_id.STRENGTH))
            total.append(log(prior) + text[i] + told)
        best = max(range(k), key=lambda i: (total[i], -i))
        out[page_id] = (languages[best], 1 / sum(exp(t - total[best]) for t in total))
    return out


def test_language_posterior_by_brute_force(spark):
    """A hot host, "co.uk", nulls, a very long page, clashing columns: the posterior of every page."""
    words = {"en": "the and with from that", "de": "der und nicht mit das", "fr": "les des dans pour avec"}
    docs = spark.createDataFrame([(i, f"{w} {i}", g) for i in range(15) for g, w in words.items()] + [(99, "x y z", "??"), (98, "les", "FR-ca")], "doc_id long, text string, lang string")
    pages, hosts = [], ("www.shop.co.uk", "a.b.de", "a.c.de", "news.fr", "shop.co.uk", "other.co.uk")
    for i in range(400):
        host = "hot.example.com" if i % 3 == 0 else hosts[i % len(hosts)]
        g = ("en", "de", "fr", "de", "en")[i % 5]
        lang = (f" lang='{g}'", "", " lang=sv", " lang=fr")[i % 4]
        pages.append((i, f"http://{host}/{i}", f"<html{lang}><p>{words[g] if i % 7 else 'der les'} {i}</p></html>"))
    pages += [(900, None, None), (901, "http://solo.it/", ""), (902, "http://news.fr/x", None), (903, "http://long.de/", f"<p>{words['en'] * 30_000}</p>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, lang string, host int")
    languages, logs = language_id.fit(docs)
    assert languages == ["de", "en", "fr"]
    want = _posteriors(pages, languages, logs)
    got = {r.page_id: (r.lang, r.probability) for r in language_id.identify(df, docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-6 for p in want)
