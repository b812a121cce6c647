"""Blocks of one HTML page: its text runs, where they stand, and what their surroundings say of them."""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

#: Comments and raw text that never close match up to the end; a tag with an open quote ends at the next `>`.
#: Nothing is tried twice at one place, and beyond the last `>` nothing is tried: the time grows with the page alone.
TOKEN = re.compile(
    r"<!--.*?(?:-->|(?P<open>\Z))|<(?P<raw>script|style|title|textarea|iframe|noframes|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|(?P<cut>\Z))"
    r"""|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?:(?P<attr>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|(?P<odd>[^>]*+)>)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Elements that end a run of text, elements and names that hold no article text, names of articles.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav noscript ol option p pre section "
            "select summary svg table tbody td template tfoot th thead tr ul".split())
NO_TEXT = set("aside button dialog footer form head header menu nav noscript option select svg template".split())
NO_TEXT_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment "
    "comments commentlist disqus respond reply replies widget toolbar pagination pager login search skip".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ARTICLE_NAMES = set("article post entry content story main".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"},
           "dd": {"dl"}, "option": {"select"}}
#: Texts of an article that may be a menu inside it: list items of at most so many words.
ITEMS, BRIEF = {"li", "dt", "dd"}, 5
#: What a block is: its host's template may claim it, it is all links, or it is a text of an article, which none may claim.
LOOSE, LINKS, FIRM = 0, 1, 2
#: Without any article zone, a template that leaves less than one part in so many of a page's text is no template.
LEAST = 10
#: A paragraph that is still open ends before these.
ENDS_PARAGRAPH = BLOCK - {"button", "option", "noscript", "template", "svg", "select", "html", "head", "body"}


def judged(tag: str, attributes: str, article: bool) -> tuple[str, bool, int]:
    """The name an element has in paths, whether it holds no article text, and its zone (2 article, 1 main, 0 neither)."""
    name, drop, zone = tag, tag in NO_TEXT, 2 if tag == "article" else 1 if tag == "main" else 0
    if tag == "header" and article:
        drop = False  # an article's own header has its title
    if attributes:
        words: set[str] = set()
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role":
                drop |= value in NO_TEXT_ROLES
                zone = max(zone, value == "main")
            elif key == "itemprop":
                zone = 2 if value == "articlebody" else zone
            else:
                words.update(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(values)).lower()))
                name += ("." if key == "class" else "#") + value
        about = words & ARTICLE_NAMES
        if words & (NO_TEXT_NAMES - {"header", "banner"} if about else NO_TEXT_NAMES) and tag not in ("html", "body", "article", "main"):
            drop = True
        elif tag == "article" and words & {"comment", "comments", "reply"}:
            drop = True
        elif about and tag in ("div", "section", "td"):
            zone = max(zone, 1)
        drop |= bool(HIDDEN.search(attributes))
    return name, drop, zone


@lru_cache(maxsize=100_000)
def below(path: str, name: str) -> str:
    """The path of an element inside another: a digest, so that deep markup costs no more than flat markup."""
    return hashlib.blake2b(f"{path}/{name}".encode("utf-8", "replace"), digest_size=8).hexdigest()


class Open:
    """The elements that are open, (tag, path, dropped, zone) each, and where each tag stands among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
        self.spots: dict[str, list[int]] = {}

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 for none."""
        return max((self.spots[t][-1] for t in tags if self.spots.get(t)), default=0)

    def push(self, *element) -> None:
        self.spots.setdefault(element[0], []).append(len(self.stack))
        self.stack.append(element)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.spots[self.stack.pop()[0]].pop()

    def close_before(self, tag: str) -> None:
        """End the elements that cannot hold a new block of this tag: an open paragraph, or the row or item before."""
        paragraph = {"p"} if tag in ENDS_PARAGRAPH or tag == "p" else set()
        shut = CLOSES.get(tag, set()) if tag != "p" else set()
        if shut:
            barrier = self.last(BARRIER.get(tag, ()))
            while (at := self.last(shut | paragraph)) > barrier:
                self.cut(at)
                if tag != "tr":
                    break
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in paragraph:
                self.cut(at)
                break
            if self.stack[at][0] in BLOCK:
                break


def blocks(page: str) -> tuple[list[tuple[str, str, int, int]], list[str]]:
    """Blocks (path, text, zone, kind) that may be article text, and the paths of all blocks and dropped parts."""
    opened = Open()
    stack = opened.stack
    found, stream, run = [], [], []
    linked = plain = 0
    in_link, at = False, 0

    def flush() -> None:
        nonlocal linked, plain
        if run:
            text = "".join(run)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                tag, path, _, zone = stack[-1]
                item = tag in ITEMS and text.count(" ") < BRIEF
                kind = LINKS if linked > 9 * plain else FIRM if zone and not item else LOOSE
                found.append((path, text, zone, kind))
                stream.append(path)
            run.clear()
            linked = plain = 0

    def add(text: str) -> None:
        nonlocal linked, plain
        if not stack[-1][2]:
            run.append(text)
            n = len(text.strip())
            if in_link:
                linked += n
            else:
                plain += n

    for m in TOKEN.finditer(page, 0, page.rfind(">") + 1):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end() if m["open"] is None and m["cut"] is None else len(page)
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                in_link = False
            elif opened.spots.get(tag):
                if tag in BLOCK:
                    flush()
                opened.cut(opened.last((tag,)))
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link = True
        block = tag in BLOCK
        if block:
            flush()
            in_link = in_link and tag != "p"
            opened.close_before(tag)
        attributes = m["attr"] if m["attr"] is not None else m["odd"]
        if not block and not attributes:
            continue
        _, path, dropped, zone = stack[-1]
        name, drop, own = judged(tag, attributes, zone == 2)
        if not block and not (drop and not dropped):
            continue
        where = path if tag in ("html", "body") else below(path, name)
        if drop and not dropped:
            stream.append(where + "!")
        opened.push(tag, where, dropped or drop, max(zone, own))
    if at < len(page):
        # a comment that opens behind the last tag
        add(page[at:].split("<!--", 1)[0])
    flush()
    return found, stream


def shape(stream: list[str]) -> tuple[list[str], list[int]]:
    """The stream with neighbouring repeats of up to four items folded into one, and each item's place in it."""
    out: list[str] = []
    place: list[int] = []
    for item in stream:
        out.append(item)
        place.append(len(out) - 1)
        folded = True
        while folded:
            folded = False
            for n in range(1, 5):
                if len(out) >= 2 * n and out[-n:] == out[-2 * n:-n]:
                    first = len(out) - n
                    del out[-n:]
                    for i in range(len(place) - 1, -1, -1):
                        if place[i] < first:
                            break
                        place[i] -= n
                    folded = True
                    break
    return out, place


def places(spots: list[int]) -> list[int]:
    """Where each block stands: its item in the folded stream, and how often that item came before."""
    seen: dict[int, int] = {}
    out = []
    for spot in spots:
        n = seen[spot] = seen.get(spot, -1) + 1
        out.append(spot << 32 | n)
    return out


def chosen(texts: list[str], zones: list[int], kinds: list[int], where: list[int], fixed: set[int]) -> str:
    """The text of the blocks that are not of the template; where a page has articles, of those in the innermost zone."""
    left = [(t, z, k) for t, z, k, w in zip(texts, zones, kinds, where) if k == FIRM or w not in fixed]
    zone = max((z for _, z, _ in left), default=0)
    if zone:
        return " ".join(t for t, z, _ in left if z == zone)
    every = [t for t, z, k in zip(texts, zones, kinds) if k != LINKS and not z]
    some = [t for t, _, k in left if k != LINKS]
    return " ".join(every if LEAST * sum(map(len, some)) < sum(map(len, every)) else some)


def parts(page: str) -> tuple[list[str], list[str], list[int], list[int], list[int]]:
    """The folded stream of a page, and of its blocks the texts, places, zones and kinds."""
    found, stream = blocks(page)
    folded, place = shape(stream)
    where = places([p for s, p in zip(stream, place) if not s.endswith("!")])
    return folded, [b[1] for b in found], where, [b[2] for b in found], [b[3] for b in found]


def article(page: str, fixed: set[int]) -> str:
    """The article text of one page; `fixed` are the places of template blocks."""
    _, texts, where, zones, kinds = parts(page)
    return chosen(texts, zones, kinds, where, fixed)
