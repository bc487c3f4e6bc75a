"""Blocks of text of an HTML page, and what the markup says about each: a helper for one row."""

from __future__ import annotations

import html
import re

CONTENT, BOILERPLATE, OPEN = "content", "boilerplate", "open"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)

#: Elements whose text is never the article's.
ASIDE_TAGS = frozenset("aside button dialog fieldset footer form head header menu nav object".split())
#: Words of class, id and role that mark such an element.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright footer "
    "gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo "
    "promoted related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next element of their kind, or the end of what they stand in, closes.
LOOSE_TAGS = frozenset("dd dt li p td th tr".split())


def _aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if tag in ("body", "html", "article", "main") or "=" not in attributes:
        return False
    return any(word in ASIDE_WORDS for value in _NAMED.findall(attributes) for word in re.split(r"[^a-z0-9]+", value.lower()))


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of every block with text, in page order; character references decoded, white space made single.

    CONTENT lies in an article or main element, BOILERPLATE in an element marked as such (also within an
    article), OPEN in neither.
    """
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    inside = 0  # open article and main elements
    aside = ""  # tag of the outermost marked element
    depth = 0  # open elements of that tag within it
    page = page or ""
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((BOILERPLATE if aside else CONTENT if inside else OPEN, text))

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(token[2] or token[5]), token[4] or token[7] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            if aside == tag:  # an inline element that is marked
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
                if depth <= 0:
                    flush()
                    aside = ""
            elif not closing and not aside and tag not in VOID_TAGS and _aside(tag, attributes):
                flush()
                aside, depth = tag, 1
            continue
        flush()
        if aside:
            if tag == aside and not (aside in LOOSE_TAGS and not closing):
                depth += -1 if closing else 1
                if depth <= 0:
                    aside = ""
                continue
            if aside not in LOOSE_TAGS:
                continue
            aside = ""  # another block ends a paragraph or item that was left open
        if tag in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
        elif not closing and tag not in VOID_TAGS and _aside(tag, attributes):
            aside, depth = tag, 1
    parts.append(page[at:])
    flush()
    return out
