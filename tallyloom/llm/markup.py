"""Pages of HTML as block elements and runs of text; reads broken markup to the end."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import xxhash

# Element names of HTML and words usual in class names.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr "
    "q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source "
    "track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset(
    "p li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure "
    "figcaption address details summary hr".split())
NOT_TEXT = RAW | frozenset(
    "head nav header footer aside form button select option datalist fieldset legend template "
    "object embed applet svg math canvas audio video dialog menu map meter progress output "
    "label".split())
NOT_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar "
    "toolbar tablist status form".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adbox adsbygoogle advert adverts advertisement advertisements advertising adslot "
    "sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu "
    "menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay paywall "
    "newsletter subscribe subscription signup login search searchform share sharing social "
    "comment comments commentlist respond replies disqus discussion related recommended "
    "recommendations widget widgets pagination pager hidden copyright".split())
MAIN_WORDS = frozenset(
    "articlebody articlecontent articletext storybody entrycontent postcontent postbody "
    "maincontent maintext bodytext".split())
#: Open elements that an opening tag ends, up to the elements that hold them.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "select"),
    "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Ends an open paragraph unless one of these stands between.
P_HOLDERS = frozenset("td th caption button object table html template".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
KEPT_ATTRIBUTES = re.compile(r"(?i)class|id|role|itemprop|hidden|style")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_ENDS = {name: re.compile(f"(?i)</{name}", re.ASCII) for name in RAW}
NUMBER = re.compile(r"\d{2,}")
UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Element:
    """A block element; ``path`` names it and all elements around it, without longer numbers."""

    parent: int
    tag: str
    path: int
    words: frozenset[str] = frozenset()
    role: str = ""
    itemprop: str = ""
    unseen: bool = False


@dataclass
class Page:
    """``elements`` in page order, the first of which stands for the page, and ``texts``.

    A text is (element, block, in a link, characters); texts of equal block number run on.
    """

    elements: list[Element] = field(default_factory=lambda: [Element(-1, "", 0)])
    texts: list[tuple[int, int, bool, str]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if KEPT_ATTRIBUTES.search(raw):
        for name, value in ATTRIBUTE.findall(raw):
            if value[:1] in "\"'":
                value = value[1:-1]
            out.setdefault(name.lower(), value)
    return out


@lru_cache(65_536)
def described(above: int, tag: str, raw: str) -> tuple:
    """Path, words, role, item property and whether unseen, of an element below ``above``."""
    found = attributes(raw)
    named = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").strip().lower()
    joined = frozenset(w.replace("-", "").replace("_", "").lower() for w in named.split())
    words = frozenset(w.lower() for w in PARTS.findall(named)) | (joined & MAIN_WORDS)
    name = f"{above} {tag} {role} {NUMBER.sub('#', ' '.join(sorted(named.split())))}"
    unseen = "hidden" in found or bool(UNSEEN.search(found.get("style", "")))
    path = xxhash.xxh64_intdigest(name) >> 1
    return path, words, role, found.get("itemprop", "").lower(), unseen


def element(parent: int, above: int, tag: str, raw: str) -> Element:
    return Element(parent, tag, *described(above, tag, raw))


def tokens(source: str):
    """(kind, name, text): ``text``, ``open``, ``close``; raw text and comments are left out."""
    at, size, last_end = 0, len(source), source.rfind(">")
    while at < size:
        less = source.find("<", at)
        if less < 0 or less > last_end:
            # A tag cut off at the end of the page is no text.
            end = size if less < 0 or not re.match(r"<[a-zA-Z/!?]", source[less:less + 2]) else less
            if at < end:
                yield "text", "", source[at:end]
            return
        if less > at:
            yield "text", "", source[at:less]
        following = source[less + 1:less + 2]
        if source.startswith("<!--", less):
            short = 4 if source.startswith("<!-->", less) else 5 if source.startswith("<!--->", less) else 0
            end = less + short if short else source.find("-->", less + 4)
            if not short and end < 0:
                return
            at = end + (1 if short else 3)
        elif following in ("!", "?") or (following == "/" and not source[less + 2:less + 3].isalpha()):
            at = source.find(">", less) + 1
        else:
            found = TAG.match(source, less) or SIMPLE_TAG.match(source, less)
            if not found:
                yield "text", "", "<"
                at = less + 1
                continue
            name, at = found[2].lower(), found.end()
            if found[1]:
                yield "close", name, ""
                continue
            yield "open", name, found[3]
            if name in RAW:
                end = RAW_ENDS[name].search(source, at)
                at = end.start() if end else size


def parse(source: str) -> Page:
    """Elements and texts of a page; never fails, whatever the markup."""
    page = Page()
    stack, block, links = [0], 0, 0
    count: dict[str, int] = {}

    def close_to(depth: int) -> None:
        for i in stack[depth:]:
            count[page.elements[i].tag] -= 1
        del stack[depth:]

    def end(names: frozenset[str], holders: frozenset[str]) -> None:
        if not any(count.get(n) for n in names):
            return
        outermost = None
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[depth]].tag
            if tag in holders:
                break
            if tag in names:
                outermost = depth
        if outermost is not None:
            close_to(outermost)

    for kind, name, raw in tokens(source):
        if kind == "text":
            page.texts.append((stack[-1], block, links > 0, html.unescape(raw)))
        elif name == "a":
            links = int(kind == "open")
        elif kind == "open":
            if name in ("br", "wbr"):
                page.texts.append((stack[-1], block, False, " " if name == "br" else ""))
            elif name == "span" or name not in INLINE:
                above = page.elements[stack[-1]].path
                made = element(stack[-1], above, name, raw)
                if name == "span":
                    if not (made.unseen or made.words & NOT_TEXT_WORDS):
                        continue
                else:
                    block += 1
                    if name != "span" and count.get("p") and name not in RAW:
                        end(frozenset(("p",)), P_HOLDERS)
                    if name in ENDS:
                        end(*ENDS[name])
                    if name in HEADINGS and page.elements[stack[-1]].tag in HEADINGS:
                        close_to(len(stack) - 1)
                    if page.elements[stack[-1]].path != above:
                        made = element(stack[-1], page.elements[stack[-1]].path, name, raw)
                    links = 0
                if name not in VOID:
                    page.elements.append(made)
                    stack.append(len(page.elements) - 1)
                    count[name] = count.get(name, 0) + 1
        elif count.get(name):
            block += name != "span"
            for depth in range(len(stack) - 1, 0, -1):
                if page.elements[stack[depth]].tag == name:
                    close_to(depth)
                    break
        elif name not in INLINE:
            block += 1
    return page
