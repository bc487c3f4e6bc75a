import random
import re
import html as entities

import numpy as np

from threadtide.llm import hostarray, markup

PAGES = "/root/testdata/sf0.001/pages.parquet"


def text_of(page):
    return "\n".join(t for k, t in markup.blocks(page) if k == markup.CONTENT)


def test_marked_elements_and_references():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no";</script></head>
    <body><header>no</header><nav class=x><ul><li><a href="/a>b">no</a></ul></nav><!-- <p>no</p> --><div class="top-banner">no<div>no</div></div>
    <article><h1>A  &amp; B&nbsp;c</h1><p><b>one<br>two</b> &lt;p&gt; x&#233;<p>th<i>r</i>ee 1 < 2
    <div id='ad-1'>no<p>no</p></div><p class="notice">no<p>four &amp</p><form>no<p>no</form><section class="comments"><p>no</p></section>
    <ul><li>five</li><li>six</ul><span class="ad">no</span>end</article><aside>no</aside><footer>&copy; no</footer>"""
    assert text_of(page).split("\n") == ["A & B c", "one two <p> xé", "three 1 < 2", "four &", "five", "six", "end"]


def test_cut_and_odd_pages():
    assert markup.blocks(None) == markup.blocks("") == []
    assert text_of("<article><p>a</p><p>b") == "a\nb"
    assert text_of("<article><p>a<script>x") == "a"
    assert text_of("<article>a<!-- x") == "a"
    assert text_of('<article><p title="x>a</p><p>b</p></article>') in ("b", "a\nb")
    assert text_of("<article>" + "<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert len(text_of("<article>" + "<p>word" * 50_000).split("\n")) == 50_000
    assert markup.blocks("<" * 50_000) and markup.blocks("<a '" * 20_000)


def test_driver_pages_match_their_articles(spark):
    rows = spark.read.parquet(PAGES)
    got = {r.page_id: r for r in hostarray.extract(rows).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert got[r.page_id].text == "\n".join(filter(None, want))
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_ranks_order_runs():
    rng = random.Random(1)
    for _ in range(50):
        words = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))], np.uint64)
        rank = hostarray.suffix_ranks(words, 5)
        runs = [tuple(words[i : i + 5]) for i in range(len(words))]
        for i in range(len(words)):
            for j in range(len(words)):
                assert (rank[i] == rank[j]) == (runs[i] == runs[j]) and (rank[i] < rank[j]) == (runs[i] < runs[j])


def brute(pages):
    """Open words of each page without runs that stand on another page of the host."""
    streams = {i: " ".join(t for _, t in markup.blocks(h)).split() for i, _, h in pages}
    host = {i: u.split("/")[2] for i, u, _ in pages}
    out = {}
    for i, words in streams.items():
        gone = set()
        for a in range(len(words) - hostarray.RUN + 1):
            run = words[a : a + hostarray.RUN]
            if any(j != i and host[j] == host[i] and any(o[b : b + hostarray.RUN] == run for b in range(len(o) - hostarray.RUN + 1)) for j, o in streams.items()):
                gone.update(range(a, a + hostarray.RUN))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def test_open_pages_lose_repeats_of_their_host(spark, monkeypatch):
    monkeypatch.setattr(hostarray, "CHUNK_WORDS", 200)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [" ".join(word() for _ in range(n)) for n in (5, 12, 30)]
    pages = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(3)] + [common[rng.randrange(3)]]
        rng.shuffle(parts)
        pages.append((i, f"http://h{i % 3}.org/{i}", "".join(f"<div>{p}</div>" for p in parts)))
    frame = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text.split() for r in hostarray.extract(frame).collect()}
    assert got == brute(pages)


def test_null_columns_repeats_and_empty_tables(spark):
    same = "<p>" + " ".join(f"x{i}" for i in range(20)) + "</p>"
    rows = [(1, None, "<article>a</article>"), (2, "http://h/1", None), (None, None, "<nav>x</nav>"), (3, "http://h/", same), (3, "http://h/", same), (4, None, "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.text) for r in hostarray.extract(frame).collect())
    only = " ".join(f"x{i}" for i in range(20))
    assert got == [(0, ""), (1, "a"), (2, ""), (3, only), (3, only), (4, "x")]
    assert hostarray.extract(frame.limit(0)).count() == 0


def test_copies_and_shared_passages_stay_on_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(hostarray, "CHUNK_WORDS", 2000)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu, quotation = text(12), text(30)
    pages, want = [], {}
    for i in range(200):
        parts = [text(40)] + ([quotation] if i < 4 else [])
        pages.append((i, f"http://large.org/{i}", f"<div>{menu}</div>" + "".join(f"<div>{p}</div>" for p in parts)))
        want[i] = "\n".join(parts)
    for i in (7, 8):
        pages.append((200 + i, f"http://large.org/copy/{i}", pages[i][2]))
        want[200 + i] = want[i]
    alone = text(50)
    for i in (300, 301):
        pages.append((i, f"http://small.org/{i}", f"<p>{alone}</p>"))
        want[i] = alone
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in hostarray.extract(frame).collect()} == want


def test_articles_lose_the_boilerplate_of_their_host(spark, monkeypatch):
    monkeypatch.setattr(hostarray, "CHUNK_WORDS", 300)
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    call, quotation, headline, pages, want = text(12), text(30), text(10), [], {}
    for i in range(60):
        a, b, c = text(20), text(9), text(5)
        if i % 3 == 0:  # the call stands in the article, between its own words
            html, want[i] = f"<nav>{text(9)}</nav><article><h1>{a}</h1><p>{b} {call} {c}</p><p>{quotation}</p></article>", "\n".join([a, f"{b} {c}", quotation])
        elif i % 3 == 1:
            html, want[i] = f"<article><p>{a}</p><p>{quotation}</p></article><div class='promo'>{call}</div>", "\n".join([a, quotation])
        else:
            html, want[i] = f"<p>{a}</p><div>{call}</div>", a
        pages.append((i, f"http://h{i % 2}.org/{i}", html))
        pages[-1] = (*pages[-1][:2], pages[-1][2] + f"<aside>{headline}</aside>")
    for i in (60, 61):  # announced by every page
        pages.append((i, f"http://h{i % 2}.org/{i}", f"<article><h1>{headline}</h1><p>{quotation}</p></article>"))
        want[i] = f"{headline}\n{quotation}"
    pages.append((99, "http://alone.org/", f"<article>{call}</article>"))  # another host
    want[99] = call
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (1000, 0):
        monkeypatch.setattr(hostarray, "BROADCAST_RUNS", most)
        assert {r.page_id: r.text for r in hostarray.extract(frame).collect()} == want
