"""HTML extraction by line-block distribution.

A page is stripped of its markup and becomes lines, one per text block, with
a length (characters outside links). Blank lines stand for container borders
and longer runs of them for removed parts (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments). What only a name in a
class, id or role marks for removal stays if it holds the article element or
most of the page's text. Lengths are summed over
a sliding window of lines; a point where the sum surges from nothing opens a
text region and one where it dives to nothing closes it. The heaviest region
shows where the article is. Where the page marks an article or main part, all
of the outermost marked element is kept; elsewhere the lowest container of all
text in that branch of the page, so that short paragraphs and lists at its
edges and parts behind an advert stay.

Scale: one pass over the pages, no shuffle; a page is handled alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines summed at each point.
WINDOW = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the text block before them.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose borders are blank lines.
CONTAINERS = frozenset("article aside body details div dl fieldset main menu ol section table ul".split())
#: Elements that never hold article text.
REMOVED = frozenset(
    "applet aside audio button canvas dialog embed footer form frame frameset head iframe input map menu nav "
    "noframes noscript object script select style svg template textarea title video".split())
#: Elements without text of their own to read: the source of a formula beside its signs.
UNREAD = frozenset(("annotation", "annotation-xml"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in a class, id or role that mark what is not the article.
REMOVED_WORDS = frozenset(
    "ad adbox ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs captcha "
    "complementary comment commentlist comments consent contentinfo cookie cookies copyright cta dialog disclaimer "
    "discussion disqus footer gdpr legal login menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup "
    "privacy promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Words that may follow one of them in a name: parts and holders of such a box.
BOX_WORDS = frozenset(
    "area articles banner bar block body bottom box button buttons card cards container content cta dialog feed footer form header icons "
    "inline inner item items left link links list main menu message modal nav notice outer overlay panel placeholder popup posts prompt "
    "right row section signup slot stories thread top unit widget widgets wrap wrapper".split())
#: Those of the removed words that name what readers write, which may outweigh a short article.
DISCUSSION = frozenset("comment commentlist comments discussion disqus replies reply respond".split())
#: Words that do so outside the article only, where they name its own title part inside.
HEADER_WORDS = frozenset("header masthead".split())
MAIN = frozenset(("article", "main"))


class _Element:
    __slots__ = ("tag", "removed", "link", "mark", "holder", "named", "article")

    def __init__(self, tag: str, removed: bool, link: bool, mark: int, holder: int, named: int, article: int):
        self.tag, self.removed, self.link, self.mark = tag, removed, link, mark
        self.holder, self.named, self.article = holder, named, article


class _Named:
    """An element that a name marks for removal: the one around it, its lines, whether it is a discussion."""

    __slots__ = ("up", "first", "end", "talk")

    def __init__(self, up: int, first: int, end: int, talk: bool):
        self.up, self.first, self.end, self.talk = up, first, end, talk


class PageLines(HTMLParser):
    """The lines of a page: texts, lengths, their article or main element, and their containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", False, False, 0, 0, 0, 0)]
        self.parent = [0]  # of each container
        self.tops = {0}  # containers that are the page itself
        self.marks = [""]  # "main" or "article" of each outermost marked element; 0 is none
        self.articles = [[0, 0]]  # first line and end of each article that is in no other, also in main; 0 is none
        self.named = [_Named(0, 0, 0, False)]  # 0 is none
        self.line_named: list[int] = []  # the innermost named element of each line
        self.borders: list[tuple[int, int]] = []  # (line after it, named element)
        self.open: Counter[str] = Counter()
        self.menus: list[tuple[int, int]] = []  # lines of each list
        self.lists: list[tuple[int, int]] = []  # depth and first line of the open lists
        self.lines: list[tuple[str, int, int, int, int]] = []  # text, length, mark, container, blank lines before
        self.parts: list[str] = []
        self.length, self.blank = 0, 0

    def break_line(self, blank: int = 0) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.lines.append((text, self.length, top.mark, top.holder, self.blank))
            self.line_named.append(top.named)
            self.blank = 0
        self.parts, self.length = [], 0
        self.blank = max(self.blank, blank)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.break_line()
            if tag != "br":
                self.close_implied(tag)
        if tag in VOID:
            return
        up = self.stack[-1]
        removed = up.removed or self.is_removed(tag, attrs, up.mark > 0)
        named = up.named
        if not removed and (words := self.removing_names(tag, attrs, up.mark > 0)):
            self.break_line()
            self.named.append(_Named(named, len(self.lines), -1, words <= DISCUSSION))
            named = len(self.named) - 1
            self.borders.append((len(self.lines), named))
        holder = up.holder
        if tag in CONTAINERS and not removed:
            self.break_line(1)
            self.parent.append(holder)
            holder = len(self.parent) - 1
            if tag == "body":
                self.tops.add(holder)
        elif removed and not up.removed and tag in BLOCKS:
            self.break_line(WINDOW)
        if tag in ("ul", "ol"):
            self.lists.append((len(self.stack), len(self.lines)))
        self.open[tag] += 1
        mark, article = (0, 0) if removed else (up.mark, up.article)
        if not removed and not article:
            main = tag == "main" or ("role", "main") in attrs
            if main or tag in MAIN or ("itemprop", "articleBody") in attrs:
                self.break_line()
                if not mark:
                    self.marks.append("main" if main else "article")
                    mark = len(self.marks) - 1
                if not main:
                    self.articles.append([len(self.lines), -1])
                    article = len(self.articles) - 1
        self.stack.append(_Element(tag, removed, up.link or tag == "a", mark, holder, named, article))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; a list item or table part ends the one before."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at].tag
            if open_tag == "p" or open_tag in ends:
                self.pop_to(at)
                if open_tag != "p":
                    break
            elif open_tag in BLOCKS:
                break

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.break_line()
        if self.open[tag]:
            at = next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag)
            self.pop_to(at)

    def pop_to(self, at: int) -> None:
        """Close the elements of the stack from ``at`` on."""
        for k in range(len(self.stack) - 1, at - 1, -1):
            element = self.stack[k]
            self.open[element.tag] -= 1
            if element.tag in BLOCKS:
                self.break_line(1 if element.tag in CONTAINERS and not element.removed else 0)
            if element.removed and not self.stack[at - 1].removed and element.tag in BLOCKS:
                self.break_line(WINDOW)
            if element.mark and not self.stack[at - 1].mark:
                self.break_line()
            if element.article and not self.stack[k - 1].article:
                self.break_line()
                self.articles[element.article][1] = len(self.lines)
            if element.named != self.stack[k - 1].named:
                self.break_line()
                self.named[element.named].end = len(self.lines)
                self.borders.append((len(self.lines), element.named))
        while self.lists and self.lists[-1][0] >= at:
            self.menus.append((self.lists.pop()[1], len(self.lines)))
        del self.stack[at:]

    @staticmethod
    def is_removed(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        if tag in REMOVED or tag in UNREAD or tag == "header" and not inside:
            return True
        for name, value in attrs:
            if name == "hidden" or (name, value) == ("aria-hidden", "true"):
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                return True
        return False

    @staticmethod
    def removing_names(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> set[str]:
        """The removed words that are a name in a class, id or role, alone or with words for a box, as in ad-box.

        An id on a heading, or on a section of the article, is where links
        lead; it does not say what the text is.
        """
        if tag in ("html", "body", "main", "article"):
            return set()
        found: set[str] = set()
        for name, value in attrs:
            if name in ("class", "role") or name == "id" and not (tag in HEADINGS or inside and tag == "section"):
                for token in (value or "").split():
                    head, *rest = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) or [""]
                    if not set(rest) - BOX_WORDS - REMOVED_WORDS:
                        found.add(head)
        return found & REMOVED_WORDS or (set() if inside else found & HEADER_WORDS)

    def gone(self) -> list[bool]:
        """Whether each named element is removed.

        It stays if it holds the heaviest article or outermost marked element,
        or if no article stands beside it and it has most of the page's text
        (of a discussion: all of it).
        """
        total = [0]
        for _, n, *_ in self.lines:
            total.append(total[-1] + n)
        where: dict[int, list[int]] = {}  # first line and end of each marked element
        for k, (_, _, mark, _, _) in enumerate(self.lines):
            if mark:
                where.setdefault(mark, [k, k])[1] = k + 1
        talk = [False] * len(self.named)
        for k, e in enumerate(self.named[1:], 1):
            talk[k] = e.talk or talk[e.up]
        heaviest, ends, firsts = [], len(self.lines) + 1, -1
        for parts in (list(where.values()), [p for p in self.articles if p[1] > p[0]]):
            quiet = [p for p in parts if not talk[self.line_named[p[0]]]]
            heaviest += sorted(quiet or parts, key=lambda p: (total[p[0]] - total[p[1]], p[0]))[:1]
            for first, end in parts:
                if not self.line_named[first]:
                    ends, firsts = min(ends, end), max(firsts, first)
        out = [False] * len(self.named)
        for k, e in enumerate(self.named[1:], 1):
            n = total[e.end] - total[e.first]
            holds = any(e.first <= first and end <= e.end for first, end in heaviest)
            beside = ends <= e.first or firsts >= e.end
            most = n > 0 and (n == total[-1] if e.talk else 2 * n > total[-1])
            out[k] = out[e.up] or not holds and (beside or not most)
        return out

    def drop_gone(self) -> None:
        """Take the removed named elements' lines away and leave blank lines for them."""
        gone = self.gone()
        if not any(gone):
            return
        gaps = {at for at, e in self.borders if gone[e]}
        lines, now, blank = [], [0], 0
        for k, (text, n, mark, holder, before) in enumerate(self.lines):
            blank = max(blank, before, WINDOW if k in gaps else 0)
            if not gone[self.line_named[k]]:
                lines.append((text, n, mark, holder, blank))
                blank = 0
            now.append(len(lines))
        self.lines, self.menus = lines, [(now[a], now[b]) for a, b in self.menus]

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.removed:
            self.parts.append(data)
            if not top.link:
                self.length += len(data) - data.count(" ")

    def finish(self) -> None:
        self.close()
        self.break_line()
        self.pop_to(1)
        self.drop_gone()


def regions(lengths: list[int], blanks: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, end) of the lines between each surge and the next dive of the windowed lengths."""
    series, where = [], []
    for k, (n, blank) in enumerate(zip(lengths, blanks)):
        series += [0] * min(blank, window) + [n]
        where += [-1] * min(blank, window) + [k]
    out, total, opened = [], sum(series[:window]), -1
    for i in range(len(series) + 1):
        # total: the sum of the window that starts at line i
        if total > 0 and opened < 0:
            opened = i
        elif total <= 0 and opened >= 0:
            inside = [k for k in where[opened:i] if k >= 0]
            out.append((inside[0], inside[-1] + 1))
            opened = -1
        if i < len(series):
            total += (series[i + window] if i + window < len(series) else 0) - series[i]
    return [(a, b) for a, b in out if b > a]


def lowest_common(holders: list[int], parent: list[int]) -> int:
    """The lowest container that holds all of ``holders``."""
    count = [0] * len(parent)
    for c in holders:
        count[c] += 1
    for c in range(len(parent) - 1, 0, -1):
        if count[c] == len(holders):
            return c
        count[parent[c]] += count[c]
    return 0


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by line feeds; '' if there is none.

    Character references are decoded and white space within a block becomes
    one space. Where the page marks an article or main part, only its lines
    have a length, so the heaviest region lies in it. Of several outermost
    marked elements those of that region's kind (main or article) in its
    branch of the page are kept.
    """
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.finish()
    lines = page.lines
    menu = set()
    for first, end in page.menus:
        if end - first >= 2 and not any(n for _, n, *_ in lines[first:end]):
            menu.update(range(first, end))  # a list of links alone
    marked = any(mark for _, _, mark, _, _ in lines)
    lengths = [0 if k in menu or marked and not mark else n for k, (_, n, mark, _, _) in enumerate(lines)]
    found = regions(lengths, [blank for *_, blank in lines])
    if not found:  # links or nothing: what is marked as the article
        return "\n".join(t for k, (t, _, mark, _, _) in enumerate(lines) if mark and k not in menu)
    first, end = max(found, key=lambda r: (sum(lengths[r[0]:r[1]]), -r[0]))
    holders = [line[3] for line in lines]
    holder = lowest_common([holders[k] for k in range(first, end) if lengths[k]], page.parent)
    if holder not in page.tops:
        # A container's number is above its parent's.
        branch = list(range(len(page.parent)))
        for c in range(1, len(branch)):
            if page.parent[c] not in page.tops:
                branch[c] = branch[page.parent[c]]
        holder = lowest_common([h for h, n in zip(holders, lengths) if n and branch[h] == branch[holder]], page.parent)
    held = [c == holder for c in range(len(page.parent))]
    for c in range(holder + 1, len(held)):
        held[c] = held[page.parent[c]]
    if not marked:
        return "\n".join(t for k, (t, *_) in enumerate(lines) if k not in menu and held[holders[k]])
    kind = page.marks[lines[max(range(first, end), key=lambda k: (lengths[k], -k))][2]]
    marks = {line[2] for line, n in zip(lines, lengths) if n and held[line[3]] and page.marks[line[2]] == kind}
    return "\n".join(t for k, (t, _, mark, _, _) in enumerate(lines) if k not in menu and mark in marks)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page, and one without an article, has the text ''.
    Repeated rows and null ids each get their row; columns that are not kept
    are ignored, whatever their names.
    """
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    schema.names)

    return pages.select(*keep, html_col).mapInArrow(run, schema)
