"""HTML as a sequence of leaf blocks: the text between two boundaries of block elements, with its ancestors.

Lenient where browsers are: end tags may be missing, comments, scripts and
quotes may stay open, unknown tags are inline. Every page is read once from
front to back, whatever its nesting.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed names of HTML elements, by what they do to the text around them.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp svg math textarea title object canvas audio video".split())
SECTION = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol search section table td th ul".split())
#: What a start tag closes, and the elements at which the search for it ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Elements that a start tag of a block does not close a p through.
P_SCOPE = frozenset("table td th caption button object html template".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]++|=)*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))|(?=[\s/]|$))", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

# What names of classes, ids and roles speak for; pieces of names, as patterns.
NAMED: tuple[tuple[str, re.Pattern], ...] = tuple(
    (name, re.compile(pattern, re.I))
    for name, pattern in (
        ("menu", r"nav(?!y)|menu|breadcrumb|crumbs|pagination|pager|toc\b|tabs?\b|skip"),
        ("ad", r"(?:^|[\s_-])(?:ads?|adv)(?:$|[\s_\d-])|adslot|adsense|advert|anzeige|sponsor|promo|banner(?!$)|publi"),
        ("side", r"side|widget|related|recommend|popular|trending|rail|aside|complementary|more-|teaser|blogroll"),
        ("foot", r"foot|copyright|legal|imprint|impressum|contentinfo|colophon"),
        ("head", r"head(?!line)|masthead|logo|brand|top-?bar|site-?title|^banner$"),
        ("notice", r"cookie|consent|gdpr|notice|notif|popup|modal|overlay|alert|dialog|subscri|newsletter|paywall|toast|warning|hinweis"),
        ("form", r"form|search|login|sign-?(?:in|up)|register|contact|captcha|input"),
        ("comment", r"comment|reply|replies|discuss|disqus|respond|kommentar|thread|review"),
        ("share", r"share|social|follow|facebook|twitter|rating|vote"),
        ("meta", r"byline|author|meta|date|time|tags?\b|categor|posted|credit|avatar"),
        ("main", r"content(?!info)|article|post|entry|story|main|body|text|prose|page"),
        ("title", r"title|headline"),
        ("hidden", r"hidden|display:\s*none|visually|sr-only"),
    )
)


@lru_cache(maxsize=1 << 16)
def names(attributes: str) -> tuple[str, ...]:
    """The groups of NAMED that an element's class, id, role or style speaks for."""
    found: dict[str, None] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            found["hidden"] = None
        elif key == "style":
            if "none" in value.lower() and NAMED[-1][1].search(value):
                found["hidden"] = None
        elif key != "aria-hidden":
            found.update(dict.fromkeys(name for name, pattern in NAMED if pattern.search(value)))
    return tuple(found)


class Path:
    """An element's tag and what it and its ancestors are: equal paths of a page are one object."""

    __slots__ = ("tag", "has", "near", "below", "score")

    def __init__(self, tag: str, has: frozenset[str], near: str):
        self.tag, self.has, self.near, self.below, self.score = tag, has, near, {}, None

    def child(self, tag: str, attributes: str) -> Path:
        groups = names(attributes) if attributes and attributes != "/" else ()
        key = (tag, groups)
        found = self.below.get(key)
        if found is None:
            own = {f"in:{tag}", *(f"named:{g}" for g in groups)} if tag in BLOCK else set()
            found = self.below[key] = Path(tag if tag in BLOCK else self.tag, self.has | own, f"near:{groups[0]}" if groups else self.near)
        return found


@dataclass
class Block:
    text: str
    linked: int
    path: Path
    section: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Characters directly in each section, and the section around it.
    sizes: list[int] = field(default_factory=lambda: [0])
    around: list[int] = field(default_factory=lambda: [0])


def page(source: str, root: Path | None = None) -> Page:
    """The leaf blocks of a page in order; blocks without text do not count."""
    out, root = Page(), root or Path("html", frozenset(), "near:")
    stack: list[tuple[str, Path, int]] = [("", root, 0)]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked, at, end = 0, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, path, section = stack[-1]
                out.blocks.append(Block(text, linked, path, section))
                out.sizes[section] += max(0, len(text) - linked)
            parts.clear()
            linked = 0

    def pop(n: int) -> None:
        for name, _, _ in stack[n:]:
            count[name] -= 1
        del stack[n:]

    def close(wanted, stops) -> bool:
        """Pops through the outermost of wanted that lies above the nearest of stops."""
        if not any(count.get(w) for w in wanted):
            return False
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in wanted:
                found = i
            elif stack[i][0] in stops:
                break
        if found:
            flush()
            pop(found)
        return bool(found)

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if count.get("a"):
                linked += len(raw.strip())

    while at < end:
        left = source.find("<", at)
        if left < 0:
            text(source[at:])
            break
        tag = _TAG.match(source, left)
        if not tag:
            after = source[left + 1 : left + 2]
            if after in ("!", "?", "/"):
                text(source[at:left])
                comment = source.startswith("<!--", left)
                right = source.find("-->" if comment else ">", left + 2)
                at = end if right < 0 else right + (3 if comment else 1)
            elif after.isascii() and after.isalpha():  # a tag that the page's end cuts off
                text(source[at:left])
                break
            else:
                text(source[at : left + 1])
                at = left + 1
            continue
        text(source[at:left])
        at = tag.end()
        ending, name, attributes = tag[1], tag[2].lower(), tag[3]
        if not ending and name in RAW:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            closing = _ENDS[name].search(source, at)
            right = source.find(">", closing.end()) if closing else -1
            at = end if right < 0 else right + 1
            if name == "title":
                flush()
            continue
        if name == "br":
            parts.append("\n")
            continue
        block = name in BLOCK
        if ending:
            if not count.get(name):
                if block:
                    flush()
                continue
            if block:
                flush()
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop(i)
            else:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                count[name] -= 1
                del stack[i]
            continue
        if block:
            if count.get("p") and name not in ("option", "label", "button"):
                close(("p",), P_SCOPE)
            if name in CLOSES:
                close(*CLOSES[name])
            flush()
        if name in VOID:
            continue
        _, path, section = stack[-1]
        if name in SECTION:
            out.sizes.append(0)
            out.around.append(section)
            section = len(out.sizes) - 1
        stack.append((name, path.child(name, attributes) if block or attributes else path, section))
        count[name] = count.get(name, 0) + 1
    flush()
    return out
