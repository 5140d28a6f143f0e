"""HTML main-text extraction by tree scoring.

A page is read into a tree of its block elements and a list of text runs in page order (a run is the
text of one block between two block boundaries; inline elements only mark link text).  Elements that
never hold the article are left out with all they hold: scripts, styles, forms, menus, page headers,
footers, sidebars, hidden parts, and elements whose class, id or role names such a part, unless a name says
that they are content or they hold the page's only article, main or h1 element.  Within an article or main
element only a class or role that is such a part's name and nothing else counts (ids may be anchors of
sections), for headings and paragraphs only that of an advert, comment or consent notice.  A form is left out
like a named part, so not where it holds the article or outscores the rest of the page.  Then

1. each run of 25 characters or more gets points: one, one for each comma, and one for each 100
   characters up to three, less the share of its characters that are links;
2. the points go to the block that holds the paragraph, half of them to that one's parent, and less
   to the next ancestors; a container's sum is discounted by its own share of link characters;
3. the best container is kept (the article or main element around it, if there is one; else the largest one
   around it whose other parts are no menus), and beside an article the articles next to it that aren't mostly links; of
   other containers' siblings those with a fifth of its score, paragraphs that
   read like text, what lies between these and isn't mostly links, and headings, lists and short paragraphs
   right before them;
4. parts of them that are mostly links are left out at the end and, without an article or main element, at the start.

Without any points the article, main or body element is taken as it is.

Defined results: null and empty pages have the empty text; unclosed and misnested tags close as
browsers close them (a paragraph ends at the next block, a list item at the next item, an end tag closes
what is open inside, one without a start is ignored); an end tag or a comment that is missing ends with
the page; text without any markup is one block.  If the class names would leave nothing, the page is
read again without them; if the largest part that they leave out has more points than all that is left of a page without
an article or main element, it is kept (not advertisements, comments and cookie notices).  Repeated rows give repeated rows; an empty table gives an empty result.

Scale: one pass, no shuffle; a task holds one page's tree, which is built and scored in time that grows with the
page, however deep its elements are nested.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe title svg object annotation annotation-xml noembed noframes xmp".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s
samp small span strike strong sub sup time tt u var wbr nobr center math semantics mrow mi mn mo ms mtext mspace
mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts
mtable mtr mtd""".split()) - {"center"}
#: Blocks that are paragraphs: their points go to their parent.
PARAGRAPH = set("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption td th tr summary".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What is kept right before the first kept block.
BEFORE = HEADINGS | set("p pre blockquote ul ol dl hgroup".split())
#: Elements that never hold the article.
NEVER = set("nav footer aside label button select option menu dialog fieldset head datalist audio video canvas map".split())
CLOSES_P = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third is in between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
        "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Words in a class, id or role that name other parts than the article.
OTHER_PARTS = set("""ad ads advert adverts advertisement advertising adsense alert alertdialog banner breadcrumb
breadcrumbs comment comments commentlist complementary contentinfo consent cookie cookies copyright dialog disqus
footer gdpr header infobar legal login masthead menu menubar modal nav navbar navigation newsletter notice
notification notifications outbrain pager pagination paywall popup promo promotion recommended related replies
respond rss search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription
taboola toolbar tooltip topbar widget widgets""".split())
CONTENT = set("article body content entry hentry main post story text".split())
#: What follows one of these in a class or id is not what the element is (``has-sidebar``).
NOT_NAMING = {"has", "with", "no", "without"}
#: Parts that are left out by name, however much text they have.
SURE_PARTS = set("""ad ads advert adverts advertisement advertising adsense outbrain taboola sponsor sponsored comment comments
commentlist replies respond disqus cookie cookies consent gdpr""".split())
#: What names leave out within an article or main element too, as a class of nothing but such words.
INSIDE_PARTS = SURE_PARTS | set("""alert banner breadcrumb breadcrumbs dialog infobar menu modal nav navbar navigation newsletter
notification notifications pager pagination paywall popup promo promotion recommended related share sharing sidebar signup
social subscribe subscription toolbar tooltip widget widgets""".split())
#: Words that tell where or how a part is laid out, not what it is.
LAYOUT = set("""area bar block bottom box button buttons card col column container content group header inner item items left line
link links list panel right row section slot top unit wrap wrapper""".split())
#: Points of a part left out by name that is taken for the article if all else has fewer.
LEAST_PART = 5.0

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACES = re.compile(r"\s+")
_COMMAS = re.compile(r"[,،、，]")
LEAST_RUN = 25


class _Element:
    __slots__ = ("tag", "parent", "dropped", "good", "named", "sure", "score", "chars", "links", "outer", "mark")

    def __init__(self, tag, parent, dropped, good, named=False, sure=False):
        self.tag, self.parent, self.dropped, self.good, self.named, self.sure = tag, parent, dropped, good, named, sure
        self.score, self.chars, self.links = 0.0, 0, 0
        self.outer = self.mark = None


def _marks(attributes: str) -> tuple[set[str], bool, bool, bool]:
    """Words of class, id and role, whether the element is hidden, whether a name says that it is content, and
    whether a class or role is nothing but the name of another part (an id may be a section's anchor).

    A name is what its last word says (``main-content``, but not ``content-ads``); a header is part of what it heads."""
    words: set[str] = set()
    hidden = content = bare = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for token in _CAMEL.sub(r"\1-\2", value).lower().split():
                own = _WORD.findall(token)
                own = own[:next((i for i, w in enumerate(own) if w in NOT_NAMING), len(own))]
                words.update(own)
                bare |= name != "id" and (bool(own) and own[-1] in SURE_PARTS or not INSIDE_PARTS.isdisjoint(own)
                                          and (INSIDE_PARTS | LAYOUT).issuperset(own))
                content |= bool(own) and (own[-1] in CONTENT or own[-1] == "header" and not CONTENT.isdisjoint(own))
        elif name == "hidden":
            hidden |= value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return words, hidden, content, bare


def _read(html: str, by_names: bool) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """The elements, parents first, and the runs (element, text, link characters) outside dropped ones."""
    root = _Element("#page", None, False, False)
    elements, stack, runs = [root], [root], []
    places: dict[str, list[int]] = {}  # places of open elements by tag, so that none is searched for
    texts: list[tuple[str, bool]] = []
    link = 0

    def end_run():
        if texts:
            text = "".join(t for t, _ in texts)
            text = _SPACES.sub(" ", text).strip()
            if text:
                links = sum(len(_SPACES.sub(" ", t).strip()) for t, inside in texts if inside)
                runs.append((stack[-1], text, min(links, len(text))))
            texts.clear()

    def add(text: str):
        if text and not stack[-1].dropped:
            texts.append((unescape(text) if "&" in text else text, link > 0))

    def pop_to(i: int):
        nonlocal link
        end_run()
        for e in stack[i:]:
            places[e.tag].pop()
        del stack[i:]
        link = 0

    def last(tags) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at = 0
    while (m := _TOKEN.search(html, at)) is not None:
        add(html[at:m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                link = max(0, link - 1)
            elif tag == "br":
                add(" ")
            elif tag not in INLINE:
                i = last((tag,))
                if i:
                    pop_to(i)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = end.end() if end else len(html)
            add(" ")
            continue
        if tag == "a":
            link = 1  # a link can't hold a link
            continue
        if tag in ("br", "wbr", "img"):
            add(" " if tag != "wbr" else "")
            continue
        if tag in INLINE:
            continue
        if tag in CLOSES_P:
            i = last(("p", "td", "th", "button", "table"))
            if i and stack[i].tag == "p":
                pop_to(i)
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            above = last(barrier)
            low = min((places[t][i] for t in ended if places.get(t) and (i := bisect_right(places[t], above)) < len(places[t])),
                      default=0)
            if low:
                pop_to(low)
        if tag in VOID:
            end_run()
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        end_run()
        parent = stack[-1]
        inside = last(("article", "main")) > 0
        dropped = parent.dropped or tag in NEVER or (tag == "header" and not inside)
        good = sure = False
        named = tag == "form"  # left out, unless it holds the article (a template may wrap the whole page in one)
        if not dropped and attributes:
            words, hidden, content, bare = _marks(attributes)
            parts = words & OTHER_PARTS
            if inside:
                # Within the article only by a class that is a part's name, and no heading or paragraph but adverts.
                parts = parts & (SURE_PARTS if tag in PARAGRAPH else INSIDE_PARTS) if bare else set()
            named = named or by_names and bool(parts) and not content and tag not in ("html", "body", "main", "header")
            if tag == "article" and not words & {"comment", "comments", "sponsored", "ad", "promo", "related"}:
                named = False
            dropped = hidden
            sure = bool(parts & SURE_PARTS)
            good = bool(words & CONTENT)
        element = _Element(tag, parent, dropped, good, named, sure)
        elements.append(element)
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
    add(html[at:])
    end_run()
    return _without_named(elements, runs)


def _points(text: str, links: int) -> float:
    if len(text) < LEAST_RUN:
        return 0.0
    return (1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)) * (1 - links / len(text))


def _named_around(element: _Element | None) -> list[_Element]:
    """The element and its ancestors that a name marks as other parts."""
    found = []
    while element is not None:
        if element.named:
            found.append(element)
        element = element.parent
    return found


def _without_named(elements: list[_Element], runs: list[tuple[_Element, str, int]]
                   ) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """Leave out the parts that names mark, but not those with the page's article, main or h1 element, nor
    one that outscores all the rest of a page without an article."""
    if not any(e.named for e in elements):
        return elements, runs
    for tags in (("article", "main"), ("h1",)):
        around = [_named_around(e) for e in elements if e.tag in tags and not e.dropped and not e.named]
        if all(around):
            for e in (e for found in around for e in found if not e.sure or tags != ("h1",)):
                e.named = False
    # The outermost named element around each (parents first), whether a sure one is around, and an article.
    for e in elements:
        up = e.parent
        e.outer = up.outer if up is not None and up.outer is not None else e if e.named else None
        around_sure, around_article = up.mark if up is not None else (False, False)
        e.mark = (around_sure or e.named and e.sure, around_article or e.tag in ("article", "main"))
    left, parts = 0.0, {}
    bounded = False
    for element, text, links in runs:
        points = _points(text, links)
        sure, within = element.mark
        if element.outer is None:
            left += points
            bounded = bounded or within
        elif not sure:
            outer, before = parts.get(id(element.outer), (element.outer, 0.0))
            parts[id(element.outer)] = outer, before + points
    if parts and not bounded:
        found, points = max(parts.values(), key=lambda x: x[1])
        if points >= LEAST_PART and points > left:
            found.named = False
    for e in elements:  # parents first
        e.dropped = e.dropped or e.named or (e.parent is not None and e.parent.dropped)
    return elements, [r for r in runs if not r[0].dropped]


def _holder(element: _Element) -> _Element:
    """The container that a run's points go to."""
    while element.tag in PARAGRAPH and element.parent is not None:
        element = element.parent
    return element


def _inside(elements: list[_Element], chosen: set[int]) -> set[int]:
    """The chosen elements and all below them."""
    found = set()
    for e in elements:  # parents first
        if id(e) in chosen or e.parent is not None and id(e.parent) in found:
            found.add(id(e))
    return found


def _choose(elements: list[_Element], runs: list[tuple[_Element, str, int]]) -> set[int]:
    """The elements whose text is kept."""
    for element, text, links in runs:
        points = _points(text, links)
        element.chars += len(text)
        element.links += links
        holder, level = _holder(element) if points else None, 0
        while holder is not None and points and level < 5:
            holder.score += points / (1, 2, 6, 9, 12)[level]
            holder, level = holder.parent, level + 1
    for e in reversed(elements):  # children first
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.links += e.links

    def score(e: _Element) -> float:
        own = e.score + (5 if e.good and e.score else 0)
        return own * (1 - e.links / e.chars) if e.chars else 0.0

    best = max(elements, key=score)
    if not score(best):
        kept = [e for tag in ("article", "main", "body", "#page") for e in elements if e.tag == tag and e.chars and not e.dropped]
        return {id(kept[0])} if kept else set()
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around if around is not None else best
    children: dict[int, list[_Element]] = {}
    for e in elements:
        if e.parent is not None and e.chars and not e.dropped:
            children.setdefault(id(e.parent), []).append(e)

    def dense(e: _Element) -> bool:
        return e.links >= 0.5 * e.chars

    # Up to the common container, as long as no other part of it is a menu.
    while around is None and best.parent is not None and best.tag != "body" \
            and not any(dense(e) for e in children[id(best.parent)] if e is not best):
        best = best.parent
    if around is not None and around.tag == "article" and around.parent is not None:
        # A page of several articles, side by side; not lists of links to others.
        return {id(e) for e in children[id(around.parent)] if e is around or e.tag == "article" and not dense(e)}
    if best.parent is None or best.tag in ("body", "main"):
        return {id(best)}
    least, row = max(10.0, 0.2 * score(best)), children[id(best.parent)]
    kept = [e is best or score(e) >= least and not dense(e) or e.tag == "p" and e.links < 0.25 * e.chars and e.chars > 80
            for e in row]
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    headed = set()
    for e in reversed(elements):  # children first
        if e.chars and e.tag in HEADINGS or id(e) in headed:
            headed.add(id(e))
            headed.add(id(e.parent))
    while around is None and first and not dense(row[first - 1]) and (row[first - 1].tag in BEFORE or id(row[first - 1]) in headed):
        first -= 1
    return {id(e) for e, k in zip(row[first:last + 1], kept[first:last + 1]) if k or not dense(e)}


def extract(html: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by two line ends."""
    if not html:
        return ""
    for by_names in (True, False):
        elements, runs = _read(html, by_names)
        if runs:
            break
    else:
        return ""
    chosen = _choose(elements, runs)
    inside = _inside(elements, chosen)
    kept = [r for r in runs if id(r[0]) in inside]
    # Parts that are mostly links at the end (lists of related pages, shares, tags), or before all else on pages
    # without an article; those between are part of the text.
    menus = {id(e) for e in elements if e.tag in ("ul", "ol", "dl", "table", "div", "section") and id(e) not in chosen
             and e.chars and e.links > 0.5 * e.chars}
    listed = _inside(elements, menus) if menus else set()
    prose = [i for i, (element, _, _) in enumerate(kept) if id(element) not in listed]
    if prose:
        bounded = any(e.tag in ("article", "main") for e in elements if id(e) in chosen)
        kept = kept[0 if bounded else prose[0]:prose[-1] + 1]
    return "\n\n".join(text for _, text, _ in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    T.ship(pages.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(one, "page_id long, url string, text string, n_chars long"))
