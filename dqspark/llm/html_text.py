"""Main text of web pages by two-pass block rules.

The page is cut into blocks of text. Pass one decides each block on its own: parts that are never
article text (navigation, footers, asides, forms, scripts, comments, and elements named as adverts,
notices and the like that do not hold most of the page's good text) are boilerplate; elsewhere the
density of the stop words that fit the page, length and link density decide, or the last two alone
on a page in a language of no list.
Short blocks and such with few stop words stay open; long ones with hardly any need good neighbours
on both sides. Article elements frame the page if those with
good text hold most of the page's good text: what stands outside them is boilerplate then. Pass two
gives every open block the label of its nearest decided neighbours; inside a framing article the
neighbours are those of the article, and its edges count as good.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dqspark.llm.common import longs, map_batches

LENGTH_LOW, LENGTH_HIGH = 70, 140
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
LINKS_MOST = 0.33
#: A page of a lower density in every list is in a language of none.
LIST_FITS = 0.2
#: Frequent function words of some languages.
STOP_WORDS = {name: frozenset(words.split()) for name, words in {
    "en": """the and of to in is that it for was on are as with his they be at this from or one had by but not what all
were we when your can an which their if do will each how them then she many some so these would other into has more two
like him see could no than been its who now my made over did only you her our us me there about out up""",
    "de": """der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch es an werden aus er hat
dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber ich wir ihr man""",
    "fr": """le la les de des du et est un une en que qui dans pour pas sur plus par avec ce il elle au aux se ne sont son
sa ses nous vous ou mais comme été cette tout ils être avait leur je on""",
    "es": """el la los las y que es por una un en de con no para su al lo como más pero sus le ya este sí porque esta
entre cuando muy sin sobre también me hasta hay donde desde nos durante uno ni contra ese esto del se""",
    "it": """il lo la gli le di che non si da per sono come ma anche un una con del della nel in al ha più""",
    "pt": """os as um uma de do da que em no na não dos das mais por para com se ao como foi""",
    "nl": """het de een van en dat niet zijn op in te is voor met die ook aan er om maar dan bij""",
}.items()}

_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div
dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu
nav ol option p pre section summary table tbody tfoot thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER = frozenset("""head nav footer aside form noscript template svg math object canvas audio video
select button dialog menu map datalist""".split())
_NAMES = frozenset("""ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs
comment comments commentlist cookie cookies consent disqus footer gdpr login menu menubar modal nav
navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup
promo promoted promotion recommended related reply respond share sharing sidebar signup skip social
sponsor sponsored subscribe taboola toolbar widget widgets masthead""".split())
#: Names of readers' comments, which may well be longer than the article.
_COMMENTS = frozenset("comment comments commentlist disqus reply respond".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
_WRAPS = frozenset("has with no without is".split())
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)"
                  r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^\W\d_]+")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str
    links: int          # characters inside links
    never: bool         # in a part that is never article text
    article: int        # number of the article element it stands in, or 0
    named: tuple[int, ...] = ()     # elements around it whose name speaks against them
    label: str = ""     # good, bad, or open: short, near, low


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(text)}


def _hidden(attributes: dict[str, str]) -> bool:
    """Whether role or style say that an element is no article text."""
    return (attributes.get("role", "").lower() in _ROLES or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""))))


def _name(attributes: dict[str, str], last: bool = True) -> str:
    """The first or ``last`` part of a class or id that says that an element is no article text."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in _PIECES.findall(name)]
        if parts and parts[0] not in _WRAPS:
            if parts[0] in _NAMES:
                return parts[0]
            if last and parts[-1] in _NAMES:
                return parts[-1]
    return ""


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; white space inside a block is one space."""
    out: list[Block] = []
    # tag, never and named elements, article
    stack: list[tuple[str, tuple[bool, tuple[int, ...]], int]] = [("", (False, ()), 0)]
    parts: list[str] = []
    links = depth = articles = names = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            tag = next((t for t, *_ in reversed(stack) if t in _BLOCKS), "")
            (never, named), article = stack[-1][1:]
            out.append(Block(text, tag, min(links, len(text)), never, article, named))
        parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        parts.append(text)
        if depth and not text.isspace():
            links += len(text)

    def close(i: int) -> None:
        """End the elements from place i of the stack on."""
        nonlocal depth
        depth -= sum(t == "a" for t, *_ in stack[i:])
        del stack[i:]

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        m = _TAG.match(html, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if end:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if block:
                flush()
            elif tag in ("td", "th"):
                parts.append(" ")
            if where:
                if any(t in _BLOCKS for t, *_ in stack[where:]) or stack[where][1] != stack[where - 1][1]:
                    flush()
                close(where)
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if tag == "br" or tag in ("td", "th", "img"):
            parts.append(" ")
        if tag in _VOID and tag != "hr":
            continue
        if block:
            flush()
            # a block ends an open paragraph, a list item the one before it
            ends = "li" if tag == "li" else "p"
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == ends:
                    close(i)
                    break
                if stack[i][0] in _BLOCKS:
                    break
        if tag == "hr" or rest.rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        _, (never, named), article = stack[-1]
        given = _attributes(rest) if rest.strip() else {}
        main = tag == "main" or given.get("role") == "main"
        if main:
            never, named = False, ()
        elif tag in _NEVER or tag == "header" and not article or _hidden(given):
            never = True
        elif tag == "article" and "comment" in given.get("class", "").lower():
            never = True
        elif given and tag not in ("html", "body"):
            name = _name(given, tag != "article")      # an article's classes end in its categories
            if name in _COMMENTS:
                never = True
            elif name:
                names += 1
                named += (names,)
        if not never and (main or tag == "article" or given.get("itemprop") == "articleBody"):
            if not article:
                articles += 1
                article = articles
        if (never, named) != stack[-1][1] and not block:
            flush()
        stack.append((tag, (never, named), article))
        depth += tag == "a"
    flush()
    return out


def stop_density(text: str, stops: frozenset[str]) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in stops for w in words) / len(words) if words else 0.0


def page_stops(found: list[Block]) -> frozenset[str]:
    """The stop words that fit the page's text best; none if it is in a language of no list."""
    words = [w for b in found if not b.never and b.links <= LINKS_MOST * len(b.text)
             for w in _WORDS.findall(b.text.lower())]
    hits = {name: sum(map(stops.__contains__, words)) for name, stops in STOP_WORDS.items()}
    best = max(hits, key=lambda name: (hits[name], name))
    return STOP_WORDS[best] if words and hits[best] >= LIST_FITS * len(words) else frozenset()


def _alone(b: Block, stops: frozenset[str]) -> str:
    """The label of a block by its links, length and stop words, or by links and length alone."""
    if b.links / len(b.text) > LINKS_MOST:
        return "bad"
    if len(b.text) < LENGTH_LOW:
        return "bad" if b.links else "short"
    if not stops:
        return "good" if len(b.text) > LENGTH_HIGH else "near"
    density = stop_density(b.text, stops)
    if density >= STOPS_HIGH and len(b.text) > LENGTH_HIGH:
        return "good"
    return "near" if density >= STOPS_LOW else "low" if len(b.text) > LENGTH_HIGH else "bad"


def _settle_names(found: list[Block]) -> None:
    """A name speaks against an element unless it holds most of the page's good text, or all text of a
    page without good text, and no article stands outside it."""
    good = [b for b in found if b.label == "good"]
    some = good or [b for b in found if not b.never and b.links <= LINKS_MOST * len(b.text)]
    total = sum(len(b.text) for b in some)
    need = total / 2 if good else total - 1
    inside: dict[int, int] = {}
    for b in some:
        for n in b.named:
            inside[n] = inside.get(n, 0) + len(b.text)
    holds = {n for n, size in inside.items() if size > need and (good or any(n in b.named and b.label == "near" for b in some))}
    if holds:
        holds = {n for n in holds if all(n in b.named for b in found if b.article and not b.never)}
    for b in found:
        if not holds.issuperset(b.named):
            b.never, b.label = True, "bad"


def _frame(found: list[Block], unlinked: list[Block]) -> set[int]:
    """The articles that have good text, if they hold most of it. A page without good text goes by
    the nearly good, then by long texts and then by all."""
    for some in ([b for b in found if b.label == "good"], [b for b in found if b.label == "near"],
                 [b for b in unlinked if len(b.text) >= LENGTH_LOW], unlinked):
        if some:
            inside = [b for b in some if b.article]
            most = 2 * sum(len(b.text) for b in inside) > sum(len(b.text) for b in some)
            return {b.article for b in inside} if most else set()
    return set()


def first_pass(found: list[Block]) -> None:
    """Decide each block on its own, or leave it open. Blocks outside the frame lose their article."""
    stops = page_stops(found)
    for b in found:
        b.label = "bad" if b.never else _alone(b, stops)
    _settle_names(found)
    frame = _frame(found, [b for b in found if not b.never and b.links <= LINKS_MOST * len(b.text)])
    for b in found:
        if b.article not in frame:
            b.article = 0
            if frame:
                b.label = "bad"
        elif b.never:
            continue
        elif b.links > LINKS_MOST * len(b.text):
            b.label = "short" if re.fullmatch("h[1-6]", b.tag) else "bad"
        elif len(b.text) < LENGTH_LOW:
            b.label = "short"
        elif b.label in ("bad", "low"):
            b.label = "near"      # an article may hold text of names, or in a language of no known words
    if not any(b.label == "good" for b in found):
        for b in found:     # a page of few words: what is nearly good is all there is
            if b.label == "near":
                b.label = "good"


def second_pass(found: list[Block]) -> None:
    """Open blocks inherit from the nearest decided neighbours; their own labels stay out of it."""
    first = [b.label for b in found]
    before: list[tuple[str, int]] = []
    for step in (1, -1):
        seen: list[tuple[str, int]] = []
        last, where, article = "bad", -10 ** 9, None
        for i in range(len(found))[::step]:
            b = found[i]
            if b.article and b.article != article:
                last, where = "good", i - step     # an article's edge
            article = b.article
            seen.append((last, abs(i - where)))
            if first[i] in ("good", "bad"):
                last, where = first[i], i
        if step > 0:
            before = seen
        else:
            after = seen[::-1]
    for b, label, (up, i), (down, k) in zip(found, first, before, after):
        if label in ("good", "bad"):
            continue
        if up == down:
            b.label = up
        elif label == "low":
            b.label = "bad"
        elif label == "near" or b.article or re.fullmatch("h[1-6]", b.tag) and down == "good":
            b.label = "good"
        else:
            b.label = up if i < k else down if k < i else "good" if b.tag == "p" else "bad"


def main_text(html: str) -> str:
    """The article's blocks, joined by empty lines."""
    found = blocks(html)
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``.

    A null or empty page has the empty text. Pages are read whole; markup that is broken or not
    closed is read as far as it goes. Repeated rows are all returned; an empty table stays empty.
    """
    def make():
        def work(batch):
            found = [main_text(x.as_py() or "") for x in batch.column("html")]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"),
                    "text": pa.array(found, pa.string()), "n_chars": longs([len(t) for t in found])}
        return work

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"),
                        F.col(html).cast("string").alias("html"))
    return map_batches(slim, make, "page_id long, url string, text string, n_chars long")
