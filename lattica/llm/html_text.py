"""HTML extraction: the main text of raw pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each
block on its own, by its stop-word density, length and link density, and by the
element it stands in (navigation, forms, notices, adverts and the like are
never text). The second pass gives blocks that are too short to tell the label
of the nearest decided neighbour.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed word lists: frequent function words by language.
STOP_WORDS = {
    "en": "the of and to a in is it that for on with as was are by be this from or at an not have".split(),
    "de": "der die das und in den von zu mit ist des im dem nicht ein eine für auf als sich auch es an werden".split(),
    "fr": "le la les de des du et à un une en est que qui dans pour pas par sur au plus avec ce il".split(),
    "es": "el la los las de del y que en un una es por con para no se su al lo como más o".split(),
    "it": "il lo la gli di che è un una per non con del della sono da si come anche più".split(),
    "pt": "o os as de do da em um uma que e não para com por se na no mais dos".split(),
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words)

# Fixed names of elements and roles.
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
CHROME = frozenset("head nav footer aside button select menu dialog canvas audio video map datalist".split())
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that may be left open, or close by what follows; they are never kept on the stack.
LOOSE = frozenset("p li dd dt tr td th thead tbody tfoot option optgroup html body h1 h2 h3 h4 h5 h6 caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class names and ids that speak of page furniture, and parts that say nothing either way. A name such as
#: ``related-posts`` counts, one with any other part, such as ``has-sidebar`` or ``share-enabled``, does not.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement adsbygoogle banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr menu masthead modal nav navbar navigation newsletter notification notice pager pagination popup promo promotion related replies respond rss share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets alert overlay copyright signup login toc".split()
)
NEUTRAL = frozenset("box list bar block container wrapper wrap area section inner outer item items link links post posts form panel slot unit site page main left right top bottom primary secondary global header title text group row col column policy thread icons buttons button".split())
HEADERS = frozenset(["header", "topbar"])
NAME_PARTS = re.compile(r"[a-z]+(?=\d|$)|[a-z]+", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>|<[!?][^>]*+>|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
#: Limits of the rules: link density, the two stop-word densities of a block and that of a page, and lengths in characters.
LINKS_MOST, STOPS_HIGH, STOPS_LOW, STOPS_SPOKEN, SHORT_BELOW, LONG_FROM = 0.33, 0.30, 0.15, 0.10, 70, 200


class Block:
    """A run of text between block-level tags; ``chrome`` and ``named``: it stands in furniture by its elements, or by names only."""

    __slots__ = ("parts", "linked", "tag", "chrome", "named", "form", "inside", "text", "label")

    def __init__(self, tag: str, chrome: bool, named: bool, form: int, inside: int):
        self.parts: list[str] = []
        self.linked, self.tag, self.chrome, self.named, self.form, self.inside = 0, tag, chrome, named, form, inside


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _is_furniture(name: str, words: frozenset[str]) -> bool:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return any(p in words for p in parts) and all(p in words or p in FURNITURE or p in NEUTRAL for p in parts)


def _is_chrome(tag: str, raw: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element of this tag and attributes is page furniture: by what it is, and by its names."""
    if tag in CHROME or tag == "header" and not in_article:
        return True, False
    if not raw or raw.isspace() or tag in ("html", "body"):
        return False, False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True, False
    if a.get("role", "").lower() in ROLES:
        return True, False
    words = FURNITURE if in_article or tag in ("article", "main") else FURNITURE | HEADERS
    return False, any(_is_furniture(n, words) for n in f"{a.get('class', '')} {a.get('id', '')}".split())


def blocks(html: str) -> list[Block]:
    """The non-empty blocks of a page in order, white space folded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, furniture by kind, by name, is an article
    chrome = named = links = articles = 0
    n_articles = n_forms = breaks = 0
    inside = form = 0

    def fresh(tag: str, kind: bool = False, name: bool = False) -> Block:
        return Block(tag, kind or chrome > 0, name or named > 0, form, inside if articles else 0)

    now = fresh("")

    def close(tag: str, kind: bool = False, name: bool = False) -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        now = fresh(tag, kind, name)

    pos, end = 0, len(html)
    while pos < end:
        m = TOKEN.match(html, pos)
        pos = m.end()
        text = m[7]
        if text is not None:
            if "&" in text:
                text = unescape(text)
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())
            if not text.isspace():
                breaks = 0
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        ends, tag, raw = bool(m[1] or m[4]), name.lower(), m[3] if m[2] else m[6]
        if tag in RAW:
            # what these elements hold is no markup: go on behind their end tag
            if not ends and not raw.rstrip().endswith("/"):
                stop = RAW_ENDS[tag].search(html, pos)
                pos = stop.end() if stop else end
            continue
        if tag == "br":
            breaks += 1
            now.parts.append("\n")
            if breaks == 2:
                close(now.tag, now.chrome, now.named)
            continue
        if tag == "a":
            links = 0 if ends else 1
            continue
        if tag in VOID and tag != "hr":
            continue
        block = tag in BLOCKS
        if ends:
            if block:
                close("")
            if tag == "form":
                form = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for _, by_kind, by_name, a in stack[k:]:
                        chrome -= by_kind
                        named -= by_name
                        articles -= a
                    del stack[k:]
                    break
            if block:
                links = 0
                now = fresh("")
            continue
        kind, by_name = _is_chrome(tag, raw, articles > 0)
        if not block and not kind and not by_name:
            continue
        if tag in LOOSE or tag in VOID:
            # a paragraph or item of such a name is furniture on its own, for want of a sure end
            page = tag in ("html", "body")
            close(tag, kind and not page, by_name and not page)
            continue
        is_article = tag in ("article", "main") and not kind and not by_name and not chrome and not named
        if block:
            close(tag)
            links = 0
        if tag == "form":
            n_forms += 1
            form = n_forms
        if not raw.rstrip().endswith("/") or block:
            stack.append((tag, kind, by_name, is_article))
            chrome += kind
            named += by_name
            articles += is_article
        if is_article:
            n_articles += 1
            inside = n_articles
        if block:
            now = fresh(tag)
        else:  # an inline element such as a label of an advert
            close(tag)
    close("")
    return out


def _settle_furniture(found: list[Block], names: bool) -> None:
    """Count forms, and with ``names`` what only names speak of, as furniture.

    A form that most of the page's other text stands in, with a long paragraph
    or an article of its own, wraps the page and is none.
    """
    if names:
        for b in found:
            b.chrome = b.chrome or b.named
    free = [b for b in found if not b.chrome]
    total = sum(len(b.text) for b in free)
    for f in {b.form for b in free if b.form}:
        own = [b for b in free if b.form == f]
        holds = any(len(b.text) >= LONG_FROM and b.linked <= LINKS_MOST * len(b.text) for b in own)
        if not holds or 2 * sum(len(b.text) for b in own) <= total:
            for b in own:
                b.chrome = True


def _lists_speak(found: list[Block]) -> bool:
    """Whether the page's running text is in a language of the word lists."""
    words = [w for b in found if not b.chrome and len(b.text) >= SHORT_BELOW and b.linked <= LINKS_MOST * len(b.text) for w in WORD.findall(b.text.lower())]
    return not words or sum(w in STOPS for w in words) >= STOPS_SPOKEN * len(words)


def first_pass(block: Block, spoken: bool = True) -> str:
    """Label of a block on its own; ``spoken``: the word lists know the page's language."""
    text = block.text
    n = len(text)
    if block.chrome:
        return BAD
    links = block.linked / n
    if links > LINKS_MOST:
        return BAD
    if block.tag in HEADINGS:
        return SHORT
    if n < SHORT_BELOW:
        return BAD if block.linked or not block.inside and ("©" in text or "|" in text) else SHORT
    words = WORD.findall(text.lower())
    if not words:
        return SHORT if block.inside else BAD
    if not spoken or not LATIN.search(text):
        density = STOPS_HIGH  # no word list speaks for this text: its length and links decide
    else:
        density = sum(w in STOPS for w in words) / len(words)
    if density >= STOPS_HIGH:
        return GOOD if n >= LONG_FROM else NEAR
    if density >= STOPS_LOW:
        return NEAR
    return SHORT if block.inside else BAD


def second_pass(found: list[Block]) -> None:
    """Settle near and short blocks by the nearest decided block.

    Blocks of an article element look at that article only, and count as text
    where it holds nothing decided; elsewhere the ends of the page count as
    decided against.
    """
    marked = sum(len(b.text) for b in found if b.inside and b.label != BAD)
    free = sum(len(b.text) for b in found if not b.inside and b.label in (GOOD, NEAR))
    trusted = marked > 0 and 2 * marked >= free
    if trusted:
        for b in found:
            if not b.inside:
                b.label = BAD
    for b in found:
        if b.inside and b.label == NEAR:
            b.label = GOOD
    if not any(b.label == GOOD for b in found):
        for b in found:
            if b.label == NEAR:
                b.label = GOOD
    n = len(found)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    for seen, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, str]] = {}
        for k in order:
            group = found[k].inside
            if found[k].label in (GOOD, BAD) and not (group and found[k].chrome):
                last[group] = (k, found[k].label)
            seen[k] = last.get(group)
    for k, b in enumerate(found):
        if b.label in (NEAR, SHORT):
            sides = [s for s in (before[k], after[k]) if s]
            if not sides:
                b.label = GOOD if b.inside else BAD
            elif b.label == NEAR or b.tag in HEADINGS and not b.inside:
                # text-like blocks and headings need one good neighbour, headings below them
                ahead = after[k] if b.tag in HEADINGS else None
                b.label = GOOD if (ahead[1] if ahead else "") == GOOD or b.tag not in HEADINGS and any(s[1] == GOOD for s in sides) else BAD
            else:
                near = min(sides, key=lambda s: (abs(s[0] - k), s[1] == BAD if b.inside else s[1] == GOOD))
                b.label = near[1]


def main_text(html: str) -> str:
    """The main text of one page: its kept blocks, one to a line.

    Names are evidence only: a page of which nothing would be left is judged again without them.
    """
    found = blocks(html)
    kinds = [b.chrome for b in found]
    for names in (True, False):
        for b, kind in zip(found, kinds):
            b.chrome = kind
        _settle_furniture(found, names)
        spoken = _lists_speak(found)
        for b in found:
            b.label = first_pass(b, spoken)
        second_pass(found)
        if kept := [b.text for b in found if b.label == GOOD]:
            return "\n".join(kept)
        if not any(b.named for b in found):
            break
    return ""


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page of (page_id, url, html): rows (page_id, url, text, n_chars).

    Every page gives one row, whatever its length; nothing in the text is
    capped. A null, empty or text-less html gives an empty text. Nulls of
    page_id and url stay, repeated rows repeat, other columns are ignored. No
    shuffle: pages are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=SCHEMA.names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
