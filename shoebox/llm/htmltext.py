"""HTML extraction with host suffix arrays.

Pages are range-partitioned by host and path, so that a host's pages stand together and a host with very many of them is
spread over several tasks. Each task takes its pages group by group: those of one host, up to about GROUP_CHARS. The token
streams of a group's pages are concatenated and their suffix array is built; its runs of suffixes that share REPEAT tokens
are the strings, and how many of the group's pages have each.

Boilerplate is what a share of all pages of the host have, whatever groups these were in. A string that one in five of all
pages have is on one in five of some group's. So each group names the strings that one in ten of its pages have, with their
counts; of a host of several groups those stay that could reach one in five with the groups that did not name them, a
bounded number, and are counted on all its pages. So partitions and groups leave the result alone.

On a page the tokens that such strings cover go and the unique runs stay. What markup says is weighed in: chrome that one
page only has shows no repeat and goes without one, if it is what its element, its role or its being hidden says (menus,
forms, asides), or if a name of it consists of nothing but words for chrome and layout (`share-buttons`). A name that only has such
a word in it (`search-methods`) is no more than a hint: the block goes if it is nothing but links or if blocks of
that tag and name are on one in five of the host's pages, which stands in the suffix array as a string of its own. Inside
`article` or `main` a repeated string of words must be on half of the host's pages, ARTICLE_PAGES at least, and a header is
the article's own. A page of which more than COPY is covered is a copy of others and keeps all of its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.common import Scratch, slices, table, written
from shoebox.llm.urlrules import url_parts

#: Tokens of a repeated string, and the pages of its host that it must be on: so many at least, and one in so many.
REPEAT, MIN_PAGES, ONE_IN = 8, 2, 5
#: The same inside an article.
ARTICLE_PAGES, ARTICLE_ONE_IN = 10, 2
#: From this share of covered tokens on a page is a copy of others.
COPY = 0.8
#: Characters of the pages of one suffix array.
GROUP_CHARS = 3_000_000

#: Attribute values may hold '>' in quotes; one whose quote never ends stops at the first '>'.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""", re.S)
NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s/"'])(hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
#: What HTML says of its elements.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video".split())
CHROME = frozenset("nav header footer aside form button select dialog menu fieldset label option datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_STACK = frozenset("p br hr li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that name chrome.
CHROME_WORDS = frozenset(
    "ad ads adv alert alerts announcement advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus feedback footer form gdpr header masthead menu menubar menus nav navbar navigation newsletter notice notices notification pagination pager popup popular promo promos promotion promoted recommended related respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags teaser toolbar trending tooltip widget widgets modal overlay login search replies reply discussion".split()
)
#: Words beside these that say where or how large something is, or what it is made of.
LAYOUT_WORDS = frozenset("area article articles bar block body bottom box button buttons col column container content fixed global head icon icons inline inner item items left link links list main outer page post posts primary right row secondary section site slot sticky stories story text title top unit wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
#: Marks of a block, in the order of what wins.
CHROME_BLOCK, ARTICLE_BLOCK, PLAIN_BLOCK = 0, 1, 2
#: An article inside something that is only named like chrome, as where that was never closed.
ENCLOSED_BLOCK = 3
#: Blocks of which a name hints at chrome, inside an article and outside.
HINTED_ARTICLE, HINTED_PLAIN = 4, 5
IN_ARTICLE = (ARTICLE_BLOCK, HINTED_ARTICLE)
HINT_NAME = 6
#: What markup says of an element.
NO_CHROME, HINT, BY_NAME, BY_ELEMENT = range(4)


def is_chrome(tag: str, attributes: str, article: bool = False) -> int:
    """BY_ELEMENT as its tag or role says or as it is hidden, BY_NAME or HINT by its class or id, else NO_CHROME."""
    if tag in CHROME and not (tag == "header" and article):
        return BY_ELEMENT
    if not attributes:
        return NO_CHROME
    if HIDDEN.search(attributes):
        return BY_ELEMENT
    found = NO_CHROME
    for m in NAMED.finditer(attributes):
        if tag in ("body", "html", "main"):
            break
        for name in m[2].strip("\"'").split():
            if m[1].lower() == "role":
                if name.lower() in ROLES:
                    return BY_ELEMENT
                continue
            words = [w.lower() for w in NAME_PARTS.findall(name) if len(w) > 1]
            if any(w in CHROME_WORDS for w in words):
                found = max(found, BY_NAME if all(w in CHROME_WORDS or w in LAYOUT_WORDS for w in words) else HINT)
    return found


def name_of(tag: str, attributes: str) -> str:
    """The tag with its class and id, without digits, as they may number things."""
    names = sorted(w for m in NAMED.finditer(attributes) for w in m[2].strip("\"'").split())
    return ".".join([tag, *(re.sub(r"\d+", "", w) for w in names)])


def blocks_of(page: str | None, names: list[str] | None = None) -> list[tuple[int, str]]:
    """(mark, text) of each block with text in page order, with character references decoded and white space merged; names
    gets what each hinted block's element is called."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    #: (tag, in chrome as in is_chrome(), in article, what hinted) of the open containers
    stack = [("", NO_CHROME, False, "")]
    piece: list[str] = []
    open_tags: Counter = Counter()
    linked = free = links = anchors = at = 0
    listed = False

    def close() -> None:
        nonlocal linked, free, links
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                _, chrome, article, hinted = stack[-1]
                if chrome > HINT:
                    mark = ENCLOSED_BLOCK if chrome == BY_NAME and article else CHROME_BLOCK
                elif linked and not free and (chrome == HINT or not article and (links > 1 or listed)):
                    mark = CHROME_BLOCK  # nothing but links: a menu, though a paragraph may be one link
                elif chrome == HINT:
                    mark = HINTED_ARTICLE if article else HINTED_PLAIN
                    if names is not None:
                        names.append(hinted)
                else:
                    mark = ARTICLE_BLOCK if article else PLAIN_BLOCK
                out.append((mark, text))
            piece.clear()
        linked = free = 0
        links = anchors

    def put(text: str) -> None:
        nonlocal linked, free
        piece.append(text)
        if not text.isspace():
            linked, free = linked + (anchors > 0), free + (anchors == 0)

    size, last = len(page), page.rfind(">") + 1
    while at < size:
        m = MARKUP.search(page, at) if at < last or "<!" in page[at:] else None
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if tag in BLOCKS:
                close()
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            if end is None:
                at = size if tag in ("script", "style", "title") else at
            else:
                at = end.start()
            continue
        if tag == "a":
            anchors = 0 if m[1] else 1
            links += anchors
            continue
        if tag in BLOCKS:
            close()
            listed = tag == "li" and not m[1]
        named = is_chrome(tag, m[3], stack[-1][2]) if not m[1] else NO_CHROME
        if tag in VOID or tag in NO_STACK and not (m[3] and named) and not open_tags[tag]:
            continue
        if m[1]:
            if open_tags[tag]:
                close()
                while (gone := stack.pop()[0]) != tag:
                    open_tags[gone] -= 1
                open_tags[tag] -= 1
        elif tag in BLOCKS or m[3] and named:
            close()
            if tag in NO_STACK and stack[-1][0] == tag:  # a new p ends the last
                stack.pop()
                open_tags[tag] -= 1
            open_tags[tag] += 1
            _, chrome, article, hinted = stack[-1]
            inside = tag in ("article", "main")
            stack.append((tag, max(NO_CHROME if tag == "main" else chrome, named), article or inside, name_of(tag, m[3]) if named == HINT else hinted))
    close()
    alone = not any(mark not in (CHROME_BLOCK, ENCLOSED_BLOCK) for mark, _ in out)
    return [(mark if mark != ENCLOSED_BLOCK else ARTICLE_BLOCK if alone else CHROME_BLOCK, text) for mark, text in out]


def suffix_order(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by prefix doubling up to REPEAT tokens or more, and the ranks after each doubling.

    Suffixes that a shorter prefix already tells apart from all others are not sorted again.
    """
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    order, n = np.argsort(ranks[0], kind="stable"), len(tokens)
    step = 1
    while step < REPEAT:
        rank = ranks[-1]
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        sorted_rank = rank[order]
        same = np.flatnonzero(sorted_rank[1:] == sorted_rank[:-1])
        tied = np.zeros(n, bool)
        tied[same] = tied[same + 1] = True
        places = np.flatnonzero(tied)
        mine = order[places]
        mine = mine[np.lexsort((second[mine], rank[mine]))]
        order[places] = mine
        sorted_rank, sorted_second = rank[order], second[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum((sorted_rank[1:] != sorted_rank[:-1]) | (sorted_second[1:] != sorted_second[:-1]))])
        ranks.append(new)
        step *= 2
    return order, ranks


def shared_with_next(order: np.ndarray, ranks: list[np.ndarray], limit: int) -> np.ndarray:
    """The common prefix of each two neighbours in the suffix array, up to limit tokens, by the kept ranks."""
    n = len(order)
    i, j = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << level, ranks[level]
        while len(live):
            a, b = i[live], j[live]
            fits = (a < n) & (b < n) & (shared[live] < limit)
            live_fit = live[fits]
            same = live_fit[rank[i[live_fit]] == rank[j[live_fit]]]
            i[same] += width
            j[same] += width
            shared[same] += width
            if level < len(ranks) - 1:
                break
            live = same
        live = np.arange(n - 1)
    return shared


def parsed(pages: list[str | None]) -> list[list[tuple[int, str]]]:
    """The blocks of each page, and behind them the names of its hinted ones as blocks of marks of their own: each is a
    string of REPEAT tokens, which repeats where the name does."""
    out = []
    for page in pages:
        names: list[str] = []
        blocks = blocks_of(page, names)
        out.append(blocks + [(HINT_NAME, name_string(n)) for n in dict.fromkeys(names)])
    return out


def name_string(name: str) -> str:
    """No white space is in a name, and no token of a text has a tab."""
    return " ".join(f"\t{k}{name}" for k in range(REPEAT))


def stream(pages: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pages' tokens as numbers, each page ended by a negative number of its own; whether a string of REPEAT tokens
    of one page begins at a token; and that string's hash, which is the same on every page and machine. Chrome is left out."""
    kinds: dict[str, int] = {}
    ids: list[int] = []
    for k, blocks in enumerate(pages):
        for mark, text in blocks:
            if mark != CHROME_BLOCK:
                ids += [kinds.setdefault(w, len(kinds)) for w in text.split(" ")]
        ids.append(-1 - k)
    tokens = np.array(ids, np.int64)
    whole, hashes = np.zeros(len(tokens), bool), np.zeros(len(tokens), np.uint64)
    n = len(tokens) - REPEAT + 1
    if n > 0 and kinds:
        ends = np.cumsum(np.append(0, tokens < 0))
        whole[:n] = ends[REPEAT : REPEAT + n] == ends[:n]
        of_token = pd.util.hash_array(np.array(list(kinds), dtype=object))[np.maximum(tokens, 0)]
        for k in range(REPEAT):
            hashes[:n] = hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + of_token[k : k + n]
        hashes ^= hashes >> np.uint64(31)
    return tokens, whole, hashes.view(np.int64)


def repeated_strings(pages: list[list[tuple[int, str]]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, pages) of each string of REPEAT tokens that so many of the pages have, by their suffix array."""
    tokens, whole, hashes = stream(pages)
    if len(pages) < least or not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, ranks = suffix_order(tokens)
    run = np.concatenate([[0], np.cumsum(shared_with_next(order, ranks, REPEAT) < REPEAT)])
    page_of = np.cumsum(np.append(0, tokens[:-1] < 0))
    first = np.append(True, run[1:] != run[:-1])
    counts = np.bincount(np.unique(run * len(pages) + page_of[order]) // len(pages))
    found = order[first]  # where each different string begins
    named = whole[found] & (counts >= least)
    return hashes[found][named], counts[named]


def string_hash(text: str) -> int:
    return int(stream([[(PLAIN_BLOCK, text)]])[2][0])


def main_text(page: str | None, plain: np.ndarray, inside: np.ndarray) -> str:
    """The page's text without chrome and without what the strings of its host cover; `inside` are those that go inside
    articles, too."""
    names: list[str] = []
    found = blocks_of(page, names)
    if names:
        known = {n: string_hash(name_string(n)) for n in set(names)} if len(plain) else {}
        repeats = {n for n, h in known.items() if (plain == h).any()}
        own = iter(names)
        found = [(mark, text) for mark, text in found if mark not in (HINTED_ARTICLE, HINTED_PLAIN) or next(own) not in repeats]
    kept = [(mark, text) for mark, text in found if mark != CHROME_BLOCK]
    if len(plain):
        tokens, whole, hashes = stream([kept])
        n = len(tokens) - 1
        covers = []
        for strings in (plain, inside):
            edges = np.zeros(n + REPEAT + 1, np.int64)
            at = np.flatnonzero(whole & np.isin(hashes, strings))
            np.add.at(edges, at, 1)
            np.add.at(edges, at + REPEAT, -1)
            covers.append(np.cumsum(edges)[:n] > 0)
        sizes = [text.count(" ") + 1 for _, text in kept]
        cover = np.where(np.repeat([mark in IN_ARTICLE for mark, _ in kept], sizes), covers[1], covers[0])
        if cover.any() and cover.mean() <= COPY:
            words = [w for _, text in kept for w in text.split(" ")]
            return " ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c)
    return " ".join(text for _, text in kept)


def host_strings(pages: DataFrame, scratch: Scratch, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(host, plain array<bigint>, inside array<bigint>) of the hosts that have boilerplate: hashes of its strings, and of
    those that go inside articles, too. pages: (host, html, and others to sort by).

    An array holds at most 2 * ONE_IN times the strings of an average page of the host.
    """
    order = [c for c in pages.columns if c != "html"]
    ranged = pages.repartitionByRange(*order).sortWithinPartitions(*order).select("host", "html")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str | None] = []
        size, last, part = 0, None, True  # the first and the last group of a partition may be parts of a host

        def done(part: bool) -> pa.RecordBatch:
            n = len(held)
            hashes, counts = repeated_strings(parsed(held), max(1, -(-n // (2 * ONE_IN))) if part else max(MIN_PAGES, -(-n // ONE_IN)))
            column = lambda first, rest: pa.concat_arrays([pa.array([first], pa.int64()), pa.array(rest, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array([last] * (len(hashes) + 1), pa.int64()), column(None, hashes), column(0, counts), pa.array([n] * (len(hashes) + 1), pa.int64())], names=["host", "string", "n_pages", "of_pages"])

        for batch in batches:
            for i in range(batch.num_rows):
                host, page = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if held and (host != last or size + len(page or "") > group_chars):
                    cut = host == last
                    yield done(part or cut)
                    held, size, part = [], 0, cut
                held.append(page)
                size += len(page or "")
                last = host
        if held:
            yield done(True)

    found = scratch.written(ranged.mapInArrow(named, "host bigint, string bigint, n_pages bigint, of_pages bigint"), "named")
    sizes = found.where("string IS NULL").groupBy("host").agg(F.sum("of_pages").alias("size"))
    strings = found.where("string IS NOT NULL").groupBy("host", "string").agg(F.sum("n_pages").alias("n"), F.sum("of_pages").alias("of")).join(sizes, "host")
    # with the groups that did not name it, n + (size - of) / (2 * ONE_IN) pages at most have the string
    strings = scratch.written(strings.where(f"{2 * ONE_IN} * n >= size + of"), "strings")
    open_ = strings.where("of < size")
    counted = pages.select("host", "html").join(open_.groupBy("host").agg(F.collect_list("string").alias("strings")), "host")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: Counter = Counter()
            for host, page, strings in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, whole, hashes = stream(parsed([page]))
                seen.update((host, x) for x in np.intersect1d(hashes[whole], strings).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([x for _, x in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "string", "n"])

    exact = counted.select("host", "html", "strings").mapInArrow(counts, "host bigint, string bigint, n bigint").groupBy("host", "string").agg(F.sum("n").alias("n"))
    exact = exact.join(sizes, "host").unionByName(strings.where("of = size").select("host", "string", "n", "size"))
    exact = exact.where(f"n >= {MIN_PAGES} AND {ONE_IN} * n >= size")
    inside = F.expr(f"CASE WHEN n >= {ARTICLE_PAGES} AND {ARTICLE_ONE_IN} * n >= size THEN string END")
    return exact.groupBy("host").agg(F.collect_list("string").alias("plain"), F.collect_list(inside).alias("inside"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_chars: int = GROUP_CHARS) -> DataFrame:
    """(id_col, url_col, text) for each row of pages; null html gives an empty text.

    Null urls and urls without a host form one host of their own. Rows that repeat stay and count as pages of their host.
    Only the three named columns are read. No pages: no rows.
    """
    host, path = url_parts(F.col(url_col))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host).alias("host"), path.alias("path"))
    with Scratch(pages.sparkSession, "pages") as scratch:
        strings = written(host_strings(source.select("host", "path", "id", "html"), scratch, group_chars), "host-strings")
    # few hosts' strings are broadcast, as their size at run time allows; else the join is by host, hot ones split
    joined = source.join(strings, "host", "left").select("id", "url", "html", "plain", "inside")
    kinds = [T.StructField(id_col, source.schema["id"].dataType), T.StructField(url_col, source.schema["url"].dataType), T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page, np.array(plain or [], np.int64), np.array(inside or [], np.int64)) for page, plain, inside in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return joined.mapInArrow(run, T.StructType(kinds))


def op2_html_extraction(spark, sf_dir):
    """The main text of every page; null and empty html have an empty one, repeated rows one each; no pages: no rows."""
    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
