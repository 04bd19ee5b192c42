"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block nodes (inline markup belongs to the block around it). Each
node has features of its tag, its class, id and role tokens, the density of text and links
in its subtree, its depth, its siblings and its ancestors. Boosted trees give the odds that
a node holds main text. Decoding picks the most likely consistent labelling: a node that
is left out takes its whole subtree along, and nothing is kept below it.

The trees learn from a bounded sample of pages (``sample_pages``, those with the smallest
hash of their id) in two ways: the pages themselves, labelled by their semantic tags, and
the sample's sentences set into many other layouts, where every node's label is known.

Text inside a block has its white space turned into single spaces; blocks are joined by an
empty line in page order. Null and empty pages have an empty text. Unclosed and misnested
markup is read as browsers do in the common cases. Each page is handled alone: copies get
equal texts and no row leaves its task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Boosted, fit
from .common import pick

# fixed values: element names of the HTML standard by the role they have here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math canvas head title select option button "
                   "textarea input audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary "
                  "table caption thead tbody tfoot tr td th ul".split())
CLOSES_P = BLOCK - frozenset("html body dd dt li tr td th thead tbody tfoot caption legend summary".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}, "p": {"p"},
                "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl div article section main body html td th blockquote form aside nav header footer".split())
# fixed values: attribute tokens by the part of a page that they name
TOKENS = {
    "content": "article content main post entry story body text prose page blog news".split(),
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "frame": "header masthead footer topbar bottom copyright legal logo branding colophon site".split(),
    "side": "sidebar aside side rail widget widgets secondary complementary".split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner dfp".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe newsletter signup".split(),
    "comment": "comment comments disqus reply replies respond discussion reviews reader".split(),
    "share": "share sharing social related recommended more tags meta byline author follow popular trending".split(),
    "form": "form search login register contact input".split(),
}
WORD_GROUP = {w: i for i, group in enumerate(TOKENS.values()) for w in group}
TAG_GROUPS = ["article main", "p", "h1 h2 h3 h4 h5 h6", "div", "section", "ul ol dl menu", "li dt dd", "nav", "header hgroup",
              "footer address", "aside", "form fieldset legend", "table thead tbody tfoot tr td th caption",
              "blockquote pre figure figcaption", "html body"]
TAG_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}

# a quote that is never closed does not open a value: such a tag ends at the next >
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[\"'])*+)>", re.S)
#: what may stand in a head; any other start tag begins the body
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
_FOREIGN = frozenset(["svg", "math"])
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAY_HIDE = re.compile("hidden|style", re.I)
_NAMED = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
_NO_DECLARATION = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^)]*\)", re.S)
_WORDS = re.compile(r"[A-Za-z]+")


def hides(attrs: str) -> bool:
    """Whether a tag's attributes hide its subtree: hidden, aria-hidden or display:none."""
    if not _MAY_HIDE.search(attrs):
        return False
    value: dict[str, str] = {}
    for m in _NAMED.finditer(attrs):  # of equal names the first counts
        value.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip().lower())
    if value.get("hidden", "false") != "false" or value.get("aria-hidden") == "true":
        return True
    display, fixed = "", False
    for part in _NO_DECLARATION.sub(" ", value.get("style", "")).split(";"):
        name, _, to = part.partition(":")
        important = "!" in to
        if name.strip() == "display" and (important or not fixed):  # the last declaration counts
            display, fixed = to.split("!")[0].strip(), important
    return display == "none"


class Page:
    """Block nodes in document order and the text runs between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attrs = ["#"], [-1], [0], [""]
        self.chars, self.link_chars, self.tags, self.stops = [0], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []  # (node, text), a break is (node, None)
        self._read(source)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.attrs.append(attrs)
        for col in (self.chars, self.link_chars, self.tags, self.stops):
            col.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("#", 0, False, False)]  # tag, node, unseen, link
        at, n = 0, len(source)

        def text(s: str) -> None:
            _, node, unseen, link = stack[-1]
            if unseen or not s:
                return
            s = html.unescape(s)
            self.runs.append((node, s))
            size = len(s) - s.count(" ") - s.count("\n")
            self.chars[node] += size
            self.link_chars[node] += size * link
            self.stops[node] += s.count(".") + s.count(",")

        def pop() -> None:
            tag, node, *_ = stack.pop()
            if tag in BLOCK:
                self.runs.append((stack[-1][1], None))

        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                rest = source[at:]
                cut = re.search(r"<[A-Za-z/!][^>]*\Z", rest)  # a page that ends inside a tag
                text(rest[:cut.start()] if cut else rest)
                break
            text(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        while len(stack) > i:
                            pop()
                        break
                continue
            if tag not in _IN_HEAD and any(t == "head" for t, *_ in stack[:4]):  # its end tag is omitted
                while any(t == "head" for t, *_ in stack):
                    pop()
            closes = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in SCOPE and stack[i][0] not in closes:
                        break
            _, node, unseen, link = stack[-1]
            self.tags[node] += 1
            if tag == "br":
                text(" ")
                continue
            if tag in BLOCK:
                self.runs.append((node, None))
            if tag in VOID or (tag in _FOREIGN and m[3].rstrip().endswith("/")):
                continue
            unseen = unseen or tag in UNSEEN or hides(m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                at = end.start() if end else n
            if tag in BLOCK:
                node = self._open(tag, m[3], node)
            stack.append((tag, node, unseen, link or tag == "a"))
        while len(stack) > 1:
            pop()

    def token_groups(self, i: int) -> list[int]:
        """The part of a page that each known class, id or role token of a node names."""
        words = [w.lower() for a in _ATTR.finditer(self.attrs[i])
                 for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a[2] or a[3] or a[4] or ""))]
        return [WORD_GROUP[w] for w in words if w in WORD_GROUP]

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent, own = np.array(self.parent), np.array([self.chars, self.link_chars, self.tags, self.stops], float).T
        total, kids = own.copy(), np.zeros((n, 3))
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
            kids[parent[i], 0] += 1
            kids[parent[i], 1] += self.tag[i] == "p"
        groups = np.zeros((n, len(TOKENS)))
        tags = np.zeros((n, len(TAG_GROUPS)))
        above = np.zeros((n, len(TOKENS) + len(TAG_GROUPS)))
        order = np.zeros(n)
        for i in range(n):
            for g in self.token_groups(i):
                groups[i, g] += 1
            g = TAG_GROUP.get(self.tag[i])
            if g is not None:
                tags[i, g] = 1
            if i:
                p = parent[i]
                above[i] = np.maximum(above[p], np.concatenate([groups[p], tags[p]]))
                order[i] = kids[p, 2]
                kids[p, 2] += 1
        page = max(1.0, total[0, 0])
        rank = np.cumsum(own[:, 0]) / page
        siblings = np.where(parent >= 0, kids[np.maximum(parent, 0), 0], 1)
        around = np.where(parent >= 0, total[np.maximum(parent, 0), 0], page)
        return np.column_stack([
            total[:, 0], own[:, 0], total[:, 0] / page, total[:, 1] / np.maximum(1, total[:, 0]), own[:, 1] / np.maximum(1, own[:, 0]),
            total[:, 0] / np.maximum(1, total[:, 2] + 1), total[:, 3] / np.maximum(1, total[:, 0]), self.depth, kids[:, 0], kids[:, 1],
            order, siblings, total[:, 0] / np.maximum(1, around), rank, groups, tags, above])

    def keep(self, margin: np.ndarray) -> np.ndarray:
        """The best labelling in which a node that is left out takes its subtree along."""
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
        yes[0], no[0] = 0.0, -1e9
        out_all, best = no.copy(), yes.copy()
        for i in range(n - 1, 0, -1):
            best[i], out_all[i] = max(best[i], out_all[i]), out_all[i]
            out_all[self.parent[i]] += out_all[i]
            best[self.parent[i]] += best[i]
        kept = np.zeros(n, bool)
        kept[0] = True
        kids_best = np.zeros(n)
        for i in range(n - 1, 0, -1):
            kids_best[self.parent[i]] += best[i]
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and yes[i] + kids_best[i] >= out_all[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks, now = [], []
        for node, s in [*self.runs, (0, None)]:
            if s is None:
                block = " ".join("".join(now).split())
                if block:
                    blocks.append(block)
                now = []
            elif kept[node]:
                now.append(s)
        return "\n\n".join(blocks)


# ---- training -------------------------------------------------------------------------

def semantic_labels(page: Page) -> np.ndarray | None:
    """1 for nodes on the way to or inside an article, 0 for others, NaN inside an article
    where attribute tokens name another part of a page; None without an article."""
    n = len(page.tag)
    inside, label, doubt = np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
    for i in range(1, n):
        p = page.parent[i]
        doubt[i] = doubt[p] or any(g != 0 for g in page.token_groups(i))
        drop = page.tag[i] in ("nav", "aside", "footer", "form")
        inside[i] = not drop and (inside[p] or page.tag[i] in ("article", "main"))
    if not inside.any():
        return None
    label[inside] = 1
    for i in range(n - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = 1
    label[doubt & inside] = np.nan
    return label


def layout(sentences: list[str], rng: np.random.Generator) -> str:
    """A page whose main-text blocks carry the attribute data-k."""
    some = lambda *xs: xs[rng.integers(len(xs))]
    said = lambda n: " ".join(sentences[j] for j in rng.integers(0, len(sentences), n))
    word = lambda: (sentences[rng.integers(len(sentences))].split() or ["x"])[0]
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    maybe = lambda p, s: s if rng.random() < p else ""

    def named(tag: str, *names: str) -> str:
        name = some(*names)
        return f"<{tag} {some('class', 'class', 'id')}=\"{name}{some('', '', '-wrap', ' box', '-1')}\">"

    def para(mark: str = " data-k") -> str:
        s = said(rng.integers(1, 7))
        if rng.random() < 0.2:
            s = s[:len(s) // 2] + f'<a href="/x">{word()}</a> ' + s[len(s) // 2:]
        return f"<p{mark}>{s}</p>"

    short = lambda: f"<{some('p', 'div', 'span')}>{said(1)[:rng.integers(15, 120)]}</{some('p', 'div', 'span')}>"
    ad = lambda: some(named("div", "ad", "ads", "advert", "sponsored", "promo", "banner-ad"), "<aside>") + said(rng.integers(1, 3)) + some("</div>", "</aside>")
    header = lambda: some("<header>", named("div", "header", "masthead", "site-header", "topbar")) + maybe(0.7, f"<h1>{word()} {word()}</h1>") + maybe(0.6, short()) + some("</header>", "</div>")
    nav = lambda: some("<nav>", named("div", "nav", "menu", "navbar", "breadcrumb"), '<div role="navigation">') + f"<ul>{links(rng.integers(2, 9))}</ul>" + some("</nav>", "</div>")
    notice = lambda: named(some("div", "section"), "cookie-notice", "notice", "alert", "consent", "gdpr-banner", "newsletter", "paywall") + f"<p>{said(rng.integers(1, 3))}</p>" + maybe(0.5, "<button>ok</button>") + "</div>"
    side = lambda: some("<aside>", named("div", "sidebar", "side", "widget", "rail", "secondary")) + f"<h3>{word()} {word()}</h3>" + some(f"<ul>{links(4)}</ul>", para(""), short()) + maybe(0.4, para("")) + some("</aside>", "</div>")
    form = lambda: "<form>" + f"<label>{word()}</label><input name=q>" + maybe(0.5, f"<p>{said(1)}</p>") + "</form>"
    more = lambda: named("div", "related", "share", "social", "recommended", "tags", "author", "popular") + some(f"<ul>{links(4)}</ul>", short(), para("")) + "</div>"
    comments = lambda: some(named("section", "comments", "comment-list", "responses discussion"), named("div", "comments", "disqus", "reader-comments")) + f"<h3>{word()}</h3>" + "".join(some(f'<div class="comment">{para("")}</div>', f'<li class="reply">{para("")}</li>', f'<article class="comment">{para("")}</article>', para("")) for _ in range(rng.integers(1, 6))) + some("</section>", "</div>")
    footer = lambda: some("<footer>", named("div", "footer", "site-footer", "colophon", "copyright")) + some(f"&copy; {said(1)}", short(), f"<ul>{links(3)}</ul>", f"<p>{said(2)}</p>") + some("</footer>", "</div>")

    body = [f"<h1 data-k>{said(1)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.integers(1, 10)):
        body.append(some(para(), para(), para(), para(), f"<h2 data-k>{said(1)[:60]}</h2>", f"<ul data-k><li data-k>{said(1)}</li><li data-k>{said(1)}</li></ul>",
                         f"<blockquote data-k><p data-k>{said(2)}</p></blockquote>", f"<div data-k>{said(rng.integers(1, 5))}</div>",
                         f"<table data-k><tr data-k><td data-k>{said(1)}</td><td data-k>{word()}</td></tr></table>",
                         f"<section data-k><h3 data-k>{word()} {word()}</h3>{para()}</section>"))
        if rng.random() < 0.12:
            body.append(some(ad, ad, more, form, notice)())
    tail = "".join(some(more, comments, form, ad, nav)() for _ in range(rng.integers(0, 3)))
    main = "".join(body)
    head, end = some(("<article data-k>", "</article>"), ("<main data-k>", "</main>"), ("<main data-k><article data-k>", "</article></main>"),
                     ('<div data-k class="content">', "</div>"), ('<div data-k class="post-body entry">', "</div>"), ("<div data-k>", "</div>"),
                     ('<div data-k id="main"><div data-k class="story">', "</div></div>"), ("<section data-k>", "</section>"), ("", ""))
    inner = maybe(0.2, f"<header data-k><h1 data-k>{said(1)}</h1></header>") + main + (tail if rng.random() < 0.5 else "")
    page = [*([header()] if rng.random() < 0.6 else []), *([nav()] if rng.random() < 0.8 else []), *([notice()] if rng.random() < 0.4 else []),
            *([ad()] if rng.random() < 0.4 else []), *([side()] if rng.random() < 0.3 else []), head + inner + end,
            *([tail] if rng.random() < 0.4 else []), *([side()] if rng.random() < 0.4 else []), *([comments()] if rng.random() < 0.35 else []),
            *([form()] if rng.random() < 0.3 else []), *([footer()] if rng.random() < 0.85 else [])]
    body_html = "".join(page)
    if rng.random() < 0.3:
        body_html = f'<div class="{some("wrapper", "container", "page", "site")}">{body_html}</div>'
    return f"<html><head><title>{said(1)}</title></head><body>{body_html}</body></html>"


def layout_labels(page: Page) -> np.ndarray:
    label = np.array(["data-k" in a for a in page.attrs], float)
    for i in range(len(label) - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = 1
    return label


def train(sources: list[str], layouts: int = 600) -> Boosted | None:
    rng = np.random.default_rng(11)
    xs, ys, sentences = [], [], []
    for s in sources:
        page = Page(s or "")
        label = semantic_labels(page)
        if label is not None:
            sure = ~np.isnan(label)
            xs.append(page.features()[sure])
            ys.append(label[sure])
        sentences += [t.strip() for _, run in page.runs if run for t in re.findall(r"[^.]{20,200}\.", run)[:20]]
    if not sentences:
        return None
    for _ in range(layouts):
        page = Page(layout(sentences, rng))
        xs.append(page.features())
        ys.append(layout_labels(page))
    return fit(np.concatenate(xs), np.concatenate(ys), trees=45, depth=5, rate=0.25)


def _extract(model: Boosted | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, texts = batch.column(2), []
            for at in range(0, len(sources), 256):
                pages = [Page(s or "") for s in sources.slice(at, 256).to_pylist()]
                if model is None:
                    texts += [p.text(np.ones(len(p.tag), bool)) for p in pages]
                    continue
                margin = model.margin(np.concatenate([p.features() for p in pages]))
                edges = np.cumsum([len(p.tag) for p in pages])[:-1]
                texts += [p.text(p.keep(m)) for p, m in zip(pages, np.split(margin, edges))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
    return run


def main_text(pages: DataFrame, sample_pages: int = 400, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every page."""
    src = pick(pages, page_id=id_col, url=url_col, html=html_col)
    ids = [r[0] for r in src.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()]
    sample = src.where(F.col("page_id").isin(ids)).orderBy("page_id", "html").limit(sample_pages).select("html").collect() if ids else []
    model = train([r[0] for r in sample])
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(_extract(model), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
