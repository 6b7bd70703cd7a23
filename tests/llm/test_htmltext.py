import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import htmltext as H
from tests.conftest import SMALL

NONE = np.zeros(0, np.int64)


def test_query_against_the_article_element(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = H.op2_html_extraction(spark, SMALL).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("no markup &amp; more", "no markup & more"),
        ("<p>a &lt;b&gt; &#x41;&#66; &nbsp;c<br>d", "a <b> AB c d"),
        ("<p>1 < 2 and <3 and a<b>b</b>c", "1 < 2 and <3 and abc"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>x</p><noscript>y</noscript><template>z</template>", "x"),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><!-- open", "yes"),
        ("<header>h</header><nav><ul><li>n</ul></nav><main><h1>T</h1><p>body</main><footer>f</footer>", "T body"),
        ("<div class='site-header'>h</div><div id=sidebarLeft>s</div><article><p>one</p><aside>no</aside><form>no</form><div class='share-buttons'>no</div><p>two</article><section class=comments><article class='comment'>rude</article></section>", "one two"),
        ("<div class='content'><p>main</p></div><ul><li><a href=1>link</a><li><a href=2>other</a></ul><div role='contentinfo'>c</div><p hidden>h</p><p>end", "main end"),
        ("<p class='ad'>buy<p>text<p class='cookie-notice'>ok?<p>more", "text more"),
        ("<article><p>badge adrenaline header-free</p><div class='lead adapted'>kept</div></article>", "badge adrenaline header-free kept"),
        ("<div class='ad'>buy now<article><h1>T</h1><p>never closed</article>", "T never closed"),
        ("<div class='ad'>buy</div><p>text</p><div class='comments'><article>rude</article></div><aside><article>teaser</article></aside>", "text"),
        ("<article><header><h1>Title</h1></header><p class='search-methods'>We search a tree.</p><div class='related-work'>So did others.</div><div class='share-price'>It rose.</div><footer>f</footer></article>", "Title We search a tree. So did others. It rose."),
        ("<header>site</header><p><a href=1>A paragraph that is one link.</a></p><p><a href=1>two</a> <a href=2>links</a></p><ul><li><a href=3>item</a></ul>", "A paragraph that is one link."),
        ("<article><p>text</p><div class='ad-box'>buy</div><div class=shareButtons>x</div><p class='comment-policy'><a href=1>policy</a></p></article><div class='price-alert'>p</div>", "text p"),
        ("<p title=it's>a</p><p class=x data='>'>b", "a b"),
        ("<p title=\"open>a<b>c", "ac"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ],
)
def test_blocks(page, text):
    assert H.main_text(page, NONE, NONE) == text


SHARED = "all rights reserved by the people who made this site in two thousand"


def brute(pages):
    """The texts of all pages of one host, by plain counting of strings of REPEAT tokens."""
    blocks = [[(m, t) for m, t in H.blocks_of(p) if m != H.CHROME_BLOCK] for p in pages]
    words = [[(w, m) for m, t in b for w in t.split(" ")] for b in blocks]
    strings = lambda ws: [tuple(w for w, _ in ws[i : i + H.REPEAT]) for i in range(len(ws) - H.REPEAT + 1)]
    count = Counter(x for ws in words for x in set(strings(ws)))
    out = []
    for ws in words:
        cover = [False] * len(ws)
        for i, x in enumerate(strings(ws)):
            for j in range(i, i + H.REPEAT):
                inside = ws[j][1] == H.ARTICLE_BLOCK
                enough = count[x] >= 10 and 2 * count[x] >= len(pages) if inside else count[x] >= 2 and 5 * count[x] >= len(pages)
                cover[j] = cover[j] or enough
        copy = sum(cover) > 0.8 * len(ws)
        out.append(" ".join(w for (w, _), c in zip(ws, cover, strict=True) if copy or not c))
    return out


def own(i, n=20):
    return " ".join(f"w{i}x{j}" for j in range(n))


def host_pages():
    """Boilerplate in and out of articles, copies, passages of few pages, and pages that have none of it."""
    rng, pages = random.Random(3), []
    for i in range(47):
        page = f"<nav>{SHARED} menu</nav><div>{own(i)}</div>"
        if i % 3:
            page += f"<p>{own(i, 3)} {SHARED} {i}</p>"
        if i % 5 < 4:
            page += f"<article><p>story {own(f's{i}')}</p><p>never miss a story again sign up for our letter today</p></article>"
        if i % 9 == 0:
            page += "<p>once upon a time there was a king who had three sons</p>"
        if i % 7 == 0:
            page = "<div>" + " ".join(f"copy{j}" for j in range(60)) + f" {i}</div>"
        pages.append(page)
    rng.shuffle(pages)
    return [*pages, None, "", "<p>short"]


def texts_of(spark, hosts, partitions, **more):
    rows = [(f"{h}/{i}", f"http://{h}/{i % 4}", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return {r.page_id: r.text for r in H.main_texts(df, **more).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("partitions", "group_chars"), [(1, 3_000_000), (8, 3_000_000), (37, 300), (1, 300), (5, 2_000)])
def test_query_against_brute_force_whatever_the_partitions(spark, partitions, group_chars):
    """All pages of a host count, however they are dealt over tasks and suffix arrays."""
    hosts = {"a.example": host_pages(), "b.example": [f"<p>{own(i)} {SHARED} {i}</p>" for i in range(6)], "c.example": [f"<p>{SHARED}</p>"], "d.example": [f"<div>{own(0, 30)} {i}</div>" for i in range(4)]}
    want = {f"{h}/{i}": t for h, pages in hosts.items() for i, t in enumerate(brute(pages))}
    assert texts_of(spark, hosts, partitions, group_chars=group_chars) == want
    joined = " ".join(t for i, t in want.items() if i[0] == "a")
    assert SHARED not in joined and "never miss" not in joined and "once upon a time" in joined and "copy7" in joined
    assert SHARED in want["c.example/0"]


def test_without_the_suffix_array_boilerplate_stays(spark, monkeypatch):
    pages = [f"<article><p>{own(i)}</p><p>{SHARED} {i}</p></article><p>{own(i, 9)} {SHARED}</p>" for i in range(12)]
    assert texts_of(spark, {"a": pages}, 4) == {f"a/{i}": f"{own(i)} {i} {own(i, 9)}" for i in range(12)}
    monkeypatch.setattr(H, "host_strings", lambda pages, *_: pages.sparkSession.createDataFrame([], "host bigint, plain array<bigint>, inside array<bigint>"))
    assert all(t.count(SHARED) == 2 for t in texts_of(spark, {"a": pages}, 4).values())


def test_a_hint_and_its_repeat_on_the_host_are_chrome(spark):
    """Names that only have a word for chrome in them: words differ on every page, the name is what repeats."""
    pages = [f"<article><p>{own(i)}</p><div class='promo-teas-{i}'>{own(f'p{i}')}</div></article><div class='login-hint'>{own(f'h{i}')}</div>" for i in range(12)]
    pages += [f"<article><p>{own(99)}</p><p class='search-methods'>{own(98)}</p></article>"]
    found = texts_of(spark, {"a": pages, "b": pages[:1]}, 4)
    assert found == {f"a/{i}": own(i) for i in range(12)} | {"a/12": f"{own(99)} {own(98)}", "b/0": f"{own(0)} {own('p0')} {own('h0')}"}


def test_repeated_strings_against_brute_force():
    rng = np.random.default_rng(7)
    pages = [[f"t{x}" for x in rng.integers(0, 4, n)] for n in (40, 0, 1, 60, 25, 7, 8)]
    pages += [pages[0][5:30] + ["x"] + pages[3][:20]]
    windows = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - H.REPEAT + 1):
            windows.setdefault(tuple(p[i : i + H.REPEAT]), set()).add(k)
    blocks = [[(H.PLAIN_BLOCK, " ".join(p))] if p else [] for p in pages]
    for least in (1, 2, 3):
        hashes, counts = H.repeated_strings(blocks, least)
        got = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
        want = {}
        for x, own_pages in windows.items():
            if len(own_pages) >= least:
                want[H.stream([[(H.PLAIN_BLOCK, " ".join(x))]])[2].tolist()[0]] = len(own_pages)
        assert got == want and len(hashes) == len(want)
    assert len(H.repeated_strings([[], []], 1)[0]) == 0


def test_table_edges(spark):
    schema = "page_id bigint, url string, html string, text string, host string, __path string"
    rows = [(1, None, "<p>a"), (2, "http://x/", None), (3, "nonsense", "<p>c"), (None, "http://y/", "<p>d"), (5, "http://x/", "<p>e"), (5, "http://x/", "<p>e")]
    pages = spark.createDataFrame([(*r, "t", "h", "p") for r in rows], schema)
    found = sorted(((r.page_id, r.text) for r in H.main_texts(pages).collect()), key=repr)
    assert found == sorted([(1, "a"), (2, ""), (3, "c"), (None, "d"), (5, "e"), (5, "e")], key=repr)
    assert H.main_texts(pages.limit(0)).count() == 0


def test_a_hot_host_is_spread(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://hot.example/a").alias("url"), F.concat(F.lit("<p>page "), F.col("id").cast("string"), F.lit(" says things of its own</p>")).alias("html"))
    out = H.main_texts(pages, group_chars=2000)
    assert out.count() == 400 and out.where("text LIKE 'page % own'").count() == 400
