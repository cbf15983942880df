"""Main text of web pages: site templates found by subtree hashes, then the article's blocks.

1. Every page is read once, element by element.  An element's hash covers its tag and all text and
   elements below it, so equal subtrees have equal hashes wherever they stand.
2. Spark counts, per host and per section of it (the first part of the path), the distinct articles whose
   pages hold each subtree: pages with the same main text count once, however their menus differ.  A
   subtree is a template of the host or the section if at least ``needed`` of them hold it: ``MIN_PAGES``
   and, as hosts grow, ``ROOT`` times the root of their pages, a share that falls.
3. Every page is read again with its host's and section's list.  Templates are deleted, and so are menus,
   headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known
   by their element, by their role or a whole token of their class or id (no part of a longer name, as
   ``related`` in ``related-work``), or by a class that begins or ends with a word for adverts or comments.
   If the page has ``article`` (else ``main``) elements that are not deleted by these marks and hold at least
   ``LEAST`` of the visible text, only the text of such elements counts, after the headings and paragraphs
   directly in front of the first, from the first heading on; else that of the whole body without
   ``article`` elements, which are then teasers.  Inside them ids mark reader comments, adverts and
   bars alone: others are anchors.

Inside the article, text elements (paragraphs, headings, list items, quotes, cells) are content even if
they recur, except at its end: a block among the last ``EDGE`` that follows as many different blocks as
``END_SHARE`` of the host's or section's articles (``END_PAGES`` at least) is a notice, and goes while it is
the last.  A line that fewer articles end with is their own.

Blocks end where a block element starts or ends and at ``br``; white space inside a block becomes
one space, character references are decoded, and empty blocks go.

Defined cases: null or empty html gives an empty text; a null url counts as a host of its own;
unclosed and stray tags are tolerated as browsers do; repeated rows are answered one by one; an
empty table gives an empty result; pages of any length and depth are read whole; columns named text or
n_chars give way to the new ones, other columns are passed on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.support import OWN, cut, small_batches
from tillroll.llm.url_filter import host_of, path_of

MIN_PAGES, ROOT = 5, 1.5
#: Share of the visible text that makes ``article`` elements the article, and blocks at its end that can be notices.
LEAST, EDGE, END_SHARE, END_PAGES = 0.25, 3, 0.5, 20
#: Entries of all lists up to which they are broadcast; a shuffle joins more.
BROADCAST_TEMPLATES = 500_000

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption".split()) | INLINE
GONE = frozenset("head script style noscript template nav header footer aside form button select textarea iframe svg "
                 "canvas object dialog menu audio video math".split())
RAW = frozenset(("script", "style", "textarea", "title"))
#: An open paragraph ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                   "p pre section table ul".split())
#: An open element of the key ends where one of the values starts.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "option": {"option"}}
#: Nothing is closed implicitly beyond these.
SCOPE = frozenset("article main section div ul ol dl table td th body html blockquote".split())
#: Roles and tokens of class or id that mark what is not the article; a token may join several of
#: them, and words for places and boxes.
MARK = (
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|"
    r"notices?|notification|alerts?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|masthead|footers?|site-header|"
    r"comments?|comment-?list|respond|disqus|share|sharing|social|related|newsletter|subscribe|signup|login|popup|modal|"
    r"search|complementary|contentinfo)")
PLACE = (r"(?:site|page|main|top|bottom|left|right|side|primary|secondary|box|bar|area|wrap|wrapper|container|buttons?|"
         r"widget|form|links)")
MARKS = re.compile(rf"(?:{PLACE}[_-]+)*{MARK}(?:[_-]+(?:{MARK}|{PLACE}))*", re.I)
#: Classes that begin or end with a word for adverts or comments, or are bars; words that only say whether there are any.
PARTS = re.compile(
    r"(?!(?:has|with|no|without)[_-])(?:(?:ads?|adverts?|comments?)[_-][\w-]+|[\w-]+[_-](?:ads?|adverts?|comments?)|"
    r"(?:top|main|side|sub|bottom|foot)[_-]?(?:nav|bar|menu))(?<![_-]open)(?<![_-]closed)(?<![_-]off)(?<![_-]on)(?<![_-]count)", re.I)
#: Ids that mark reader comments, adverts and bars, inside the article too.
INSIDE = re.compile(r"(?:reader[_-]?)?comments?|comment[_-]?list|respond|disqus(?:_thread)?|ads?(?:[_-]?\d+)?|ad[_-](?:slot|box|unit|top|bottom)|"
                    r"cookie[_-]?(?:bar|banner|notice|consent)?|sidebar|(?:top|side)[_-]?(?:nav|bar)|navbar|newsletter", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*'|["'])*+)>|<[!?][^>]*>""", re.S)


def marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether class, id or role mark an element (``inside`` the article) as no part of it."""
    for name, a, b, c in NAMED.findall(attributes):
        tokens, name = (a or b or c).split(), name.lower()
        if name == "id" and inside:
            found = tag not in HEADINGS and any(map(INSIDE.fullmatch, tokens))
        else:
            found = not (name == "id" and tag in HEADINGS) and any(map(MARKS.fullmatch, tokens))
            found = found or (name == "class" and any(map(PARTS.fullmatch, tokens)))
        if found:
            return True
    return False


def end_key(block: str) -> int:
    """A block's number as one at the article's end: below -1, where subtrees' are not."""
    return -2 - (xxhash.xxh3_64_intdigest(block) >> 2)


class Frame:
    """An open element: what its hash covers so far, and where its blocks start.

    ``flat`` elements can be no template; what they hold is noted with their parent's.
    """

    __slots__ = ("tag", "parts", "flat", "first", "hidden", "main", "text", "front")

    def __init__(self, tag: str, parts: list[str], flat: bool, first: int, hidden: bool, main: bool) -> None:
        self.tag, self.parts, self.flat, self.first = tag, parts, flat, first
        self.hidden, self.main, self.text, self.front = hidden, main, False, None


class Reader:
    """One page, element by element."""

    def __init__(self, page: str, templates: Container[int], whole: str) -> None:
        self.whole, self.inside, self.outside = whole, 0, 0  # the element that counts ("": all); visible text in and beside it
        self.front: list[tuple[Frame, str, str]] = []  # visible text elements before the first one: parent, tag, block
        self.ahead: list[str] = []
        self.met = False
        self.templates, self.blocks, self.now, self.seen = templates, [], [], set()
        self.stack = [Frame("", [], False, 0, False, not self.whole)]
        at = 0
        for token in TOKEN.finditer(page):
            start = token.start()
            if start < at:  # inside a script or the like
                continue
            if start > at:
                self.says(page[at:start])
            at = token.end()
            tag = token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                self.ends(tag)
            elif tag in VOID:
                if tag == "br" or tag == "hr":
                    self.flush()
            else:
                self.starts(tag, token[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    stop, after = (end.start(), end.end()) if end else (len(page), len(page))
                    self.says(page[at:stop])
                    self.close()
                    at = after
        self.says(page[at:])
        while len(self.stack) > 1:
            self.close()
        self.flush()
        self.trim()

    def trim(self) -> None:
        """Notes the article's last blocks, and takes off those that are templates; puts what stood in front first."""
        blocks, end = self.blocks, len(self.blocks)
        #: (key, the block before it, which tells pages apart)
        self.edges: list[tuple[int, int]] = []
        if self.whole and len(blocks) > 1:
            keys = list(map(end_key, blocks[-EDGE - 1:]))
            self.edges = sorted(set(zip(keys[1:], keys)))
            while end > 1 and end_key(blocks[end - 1]) in self.templates:
                end -= 1
        self.blocks = self.ahead + blocks[:end]

    def flush(self) -> None:
        if self.now:
            block = " ".join("".join(self.now).split())
            if block:
                self.blocks.append(block)
            self.now.clear()

    def says(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        top = self.stack[-1]
        if text and not text.isspace():
            top.parts.append(text)
            top.text = True
            if not top.hidden and top.main:
                self.inside += len(text)
            elif not top.hidden:
                self.outside += len(text)
                if not self.met:
                    for frame in reversed(self.stack):
                        if frame.tag not in INLINE:
                            break
                    if frame.front is not None:
                        frame.front.append(text)
        if top.main and not top.hidden:
            self.now.append(text)

    def starts(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag in ENDS_P or tag in ENDED_BY:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if (open_tag == "p" and tag in ENDS_P) or tag in ENDED_BY.get(open_tag, ()):
                    while len(stack) > depth:
                        self.close()
                    break
                if open_tag in SCOPE:
                    break
        if tag not in INLINE:
            self.flush()
        top = stack[-1]
        hidden = top.hidden or tag in GONE or (tag == "article" and self.whole == "")
        if not hidden and attributes and tag not in ("body", "html", "main"):
            hidden = marked(tag, attributes, top.main and self.whole != "")
        flat = tag in INLINE or (tag in TEXTUAL and top.main and self.whole != "")
        if flat:
            top.parts.append(f"<{tag}>")
        if tag == self.whole and not hidden and not self.met:
            self.met = True
            ahead = [(t, block) for parent, t, block in self.front if parent in stack]
            starts = [i for i, (t, _) in enumerate(ahead) if t in HEADINGS]
            self.ahead = [block for _, block in ahead[starts[0]:]] if starts else []
        frame = Frame(tag, top.parts if flat else [], flat, len(self.blocks), hidden, top.main or tag == self.whole)
        if not (self.met or hidden or not self.whole) and (tag in HEADINGS or tag == "p"):
            frame.front = []
        stack.append(frame)

    def ends(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                while len(self.stack) > depth:
                    self.close()
                return

    def close(self) -> None:
        frame = self.stack.pop()
        top = self.stack[-1]
        if frame.tag not in INLINE:
            self.flush()
        if frame.text:
            top.text = True
        if frame.front:
            block = " ".join("".join(frame.front).split())
            if block:
                self.front.append((top, frame.tag, block))
        if frame.flat:
            return
        if not frame.text or frame.tag in ("body", "html", "head", self.whole) or frame.tag in RAW:
            top.parts.extend(("<", frame.tag, *frame.parts, ">"))
            return
        key = xxhash.xxh3_64_intdigest("\x00".join((frame.tag, *frame.parts))) >> 1
        top.parts.append(f"<{key}>")
        self.seen.add(key)
        if key in self.templates:
            del self.blocks[frame.first:]


def read(page: str | None, templates: Container[int] = ()) -> Reader:
    """The page's blocks that are left, and the hashes of what can be templates."""
    page = page or ""
    for whole in ("article", "main"):
        if re.search(rf"<{whole}[\s/>]", page, re.I):
            reader = Reader(page, templates, whole)
            if reader.inside and reader.inside >= LEAST * (reader.inside + reader.outside):
                return reader
    return Reader(page, templates, "")


def subtree_counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, section, subtree, n: in how many ways pages of the section hold the subtree; subtree -1 counts its articles.

    A subtree beside the article is told apart by the main text, a block at the article's end by its neighbour.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, section, x in zip(batch["host"], batch["section"], batch["html"]):
                page = read(x)
                text = xxhash.xxh3_64_intdigest("\n".join(page.blocks)) >> 1
                rows += [(host, section, key, text) for key in (-1, *sorted(page.seen))]
                rows += [(host, section, key, way) for key, way in page.edges]
            yield pd.DataFrame(rows, columns=["host", "section", "subtree", "way"])

    slim = pages.select(host_of(F.col(url_col)).alias("host"), section_of(F.col(url_col)).alias("section"), F.col(html_col).alias("html"))
    rows = slim.mapInPandas(work, "host string, section string, subtree long, way long")
    # both steps combine before they shuffle
    once = rows.groupBy("host", "section", "subtree", "way").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("host", "section", "subtree").agg(F.count(F.lit(1)).alias("n"))


def section_of(url: Column) -> Column:
    """The first part of the path that is not the page itself; empty if there is none."""
    return F.regexp_extract(path_of(url), "^/([^/]+)/", 1)


def needed(subtree: Column, n: Column) -> Column:
    """Articles that must hold a template, of a host's or section's n."""
    at_end = F.greatest(F.lit(END_PAGES).cast("double"), n * END_SHARE)
    return F.when(subtree < -1, at_end).otherwise(F.greatest(F.lit(MIN_PAGES).cast("double"), F.lit(ROOT) * F.sqrt(n)))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, section and the template subtrees of both."""
    counts = cut(subtree_counts(pages, url_col, html_col))
    of_host = counts.groupBy("host", "subtree").agg(F.sum("n").alias("n"))
    often = []
    for found, keys in ((of_host, ["host"]), (counts, ["host", "section"])):
        totals = found.where("subtree = -1").select(*keys, F.col("n").alias("articles"))
        often.append(found.where((F.col("subtree") != -1) & (F.col("n") >= MIN_PAGES)).join(totals, keys)
                     .where(F.col("n") >= needed(F.col("subtree"), F.col("articles"))).select(*keys, "subtree"))
    sections = counts.where("subtree = -1").select("host", "section")
    both = often[0].join(sections, "host").select("host", "section", "subtree").unionByName(often[1])
    return both.groupBy("host", "section").agg(F.collect_set("subtree").alias("templates"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (in place of columns with these names)."""
    small_batches(pages.sparkSession)
    lists = cut(site_templates(pages, url_col, html_col))
    if (lists.agg(F.sum(F.size("templates"))).first()[0] or 0) <= BROADCAST_TEMPLATES:
        lists = F.broadcast(lists)
    own, part, host, section, templates, block_text = (f"{OWN}{x}" for x in ("own_host", "part", "host", "section", "templates", "text"))
    lists = lists.select(F.col("host").alias(host), F.col("section").alias(section), F.col("templates").alias(templates))

    @F.pandas_udf("string")
    def main_text(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(read(x, () if t is None else set(t.tolist())).blocks) for x, t in zip(texts, found)],
                         dtype=object)

    joined = pages.withColumns({own: host_of(F.col(url_col)), part: section_of(F.col(url_col))}).join(
        lists, (F.col(own) == F.col(host)) & (F.col(part) == F.col(section)), "left")
    text = joined.withColumn(block_text, main_text(html_col, templates))
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    return text.select(*names, F.col(block_text).alias("text"), F.char_length(block_text).cast("long").alias("n_chars"))
