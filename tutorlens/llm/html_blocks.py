"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags (and at two line breaks in a row). The first pass decides each block for
itself from its length, link density and stop-word density; markup that names its part (navigation, footer,
advert, notice, form, comments, ...) is boilerplate whatever it holds. Stop words are known of English, German, French,
Spanish, Italian, Portuguese, Dutch, Swedish, Danish, Norwegian, Polish, Czech, Romanian, Hungarian, Turkish, Finnish,
Indonesian and Malay; a block's density is that of the language with most. A block whose letters are mostly of another script,
and every block of a page where none is rich in known stop words, is judged by its length and link density alone. Blocks that are too short to tell, or only
fairly rich in stop words, stay undecided; the second pass gives them the labels of the nearest decided
neighbours. Where a page marks its article (``article``, ``main``), neighbours are looked for inside it
only, and what stands outside is left out as soon as the article holds text.

A class or id may speak of something that its element only wraps. Names after ``has-``, ``no-``, ``with-`` do not count; the
verdict of the elements around the page's only marked article is lifted, and so is that of a name (comments apart) whose
elements together hold more than ``WRAPPER_SHARE`` of the good text that no other markup damns: page builders put every
paragraph into a ``widget`` of its own. Elements of one name inside each other are told apart by their level; those beyond
the ``LEVELS``-th are judged together.

Reading a page takes time in proportion to its length, whatever its markup: a tag whose quotes hide every further ``>``
makes the rest of the page be read without regard to quotes, and a tag that the page's end cuts off is dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPWORDS_LOW, STOPWORDS_HIGH = 0.12, 0.25
MAX_LINK_DENSITY = 0.4
WRAPPER_SHARE = 0.8
LEVELS = 3              # elements bad by one name inside each other that are told apart
HEADING_REACH = 200     # characters of short blocks that may stand between a heading and its text

#: frequent function words of English, German, French and Spanish
STOPWORDS = frozenset("""
the of and to in a is that it for on was as with be by are this at from or an not but have his they you which were her
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
le la les et des en un du une que est pour qui dans par sur au avec ne se pas plus ce il sont de elle
el los las del y por con una su para lo no al como más o pero sus entre cuando muy sin sobre
""".split())

#: of further languages in Latin script, a set each: Italian, Portuguese, Dutch, Swedish, Danish and Norwegian, Polish, Czech,
#: Romanian, Hungarian, Turkish, Finnish, Indonesian and Malay
MORE_STOPWORDS = [frozenset(x.split()) for x in (
    "di e il la che è un una per in non sono si con del della dei delle da le i gli al alla nel nella ma come più anche questo ha",
    "de e o a os as que do da dos das em um uma para com não por mais no na nos nas se como mas ao foi ele ela é são seu sua ou",
    "de het een en van in is dat op te zijn voor met die niet aan er om ook als bij maar door over naar uit hij ze wordt werd",
    "och att det som en på är av för med den till inte har de om ett var jag men så från vi kan när eller hade ska hon han",
    "og i at det som en på er af av for med den til ikke har de om et var jeg men så fra vi kan når eller havde hadde hun han ble blev",
    "i w na z się nie do to że jest o a jak po co od za ale tak przez dla był była było są oraz ze który która które tego jego już",
    "a v se na je že s z do to o i k jako za by ve ale pro po jsou od byl byla bylo který která které tak nebo jeho při si",
    "și în de la a cu pe nu că o un este sau din ce care au pentru mai se al lui prin dar fost sunt ca ale era după între",
    "a az és hogy nem is egy meg de ez volt ha csak már mint el vagy azt még van ki be minden lesz sem ezt azonban amely pedig",
    "ve bir bu da de için ile çok ne o gibi daha olarak olan ama kadar en sonra var değil ki her mi ya hem olduğu şey ise",
    "ja on ei se että oli joka hän mutta kun niin ovat olla tai sen kuin myös ole oli mukaan jos vain nyt sitä hänen jo tämä",
    "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena ada adalah oleh atau bisa mereka telah kami")]

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "object", "noembed", "xmp")
BAD_TAGS = frozenset("nav footer aside form select button menu dialog datalist head label fieldset".split())
ARTICLE_TAGS = frozenset(("article", "main"))
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs byline
comment comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer gdpr legal login
masthead menu modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay pager
pagination popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar signup skip
social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets""".split())
#: names after these are left out: the element has, lacks, shows or hides the part but is not the part
MODIFIERS = frozenset("has have no non not with without show hide".split())
#: parts that may hold more text than the article
DISCUSSION_NAMES = frozenset("comment comments complementary discussion disqus replies reply respond".split())

def token(attrs: str, unread: str) -> re.Pattern:
    """A comment, an element whose content is not text, a tag, or a declaration. Every alternative ends at the page's end."""
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
        r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>" + attrs + ")" + unread +
        r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)


#: tags with regard to quotes; ``open`` if no end can be found so
TOKEN = token(r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+""", ">|<(?P<open>/?[a-zA-Z])")
PLAIN_TOKEN = token("[^>]*+", r"(?P<open>)(?:>|\Z)")


def tokens(page: str) -> Iterator[re.Match]:
    for m in TOKEN.finditer(page):
        if m["open"]:
            yield from PLAIN_TOKEN.finditer(page, m.start())
            return
        yield m


NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")
#: letters that are not Latin; of these, the ones of scripts without spaces between words
OTHER_SCRIPT = re.compile("[^\\W\\d_\u0000-\u024f\u1e00-\u1eff\ua720-\ua7ff\uff21-\uff5a]")
DENSE_SCRIPT = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"

#: elements bad by name, from the outside in; each the (name, level) of its names, level 1 being the outermost of that name
Chain = tuple[tuple[tuple[str, int], ...], ...]


@dataclass
class Block:
    text: str
    linked: int        # characters inside links
    heading: bool
    zone: int          # number of the marked article it stands in; 0: none
    named_bad: bool    # inside markup that names itself boilerplate
    label: str = ""
    tag_bad: bool = False          # by a tag or because it is hidden
    names: Chain = ()              # elements around it that are bad by their class, id or role alone
    zone_names: Chain = ()         # those of them that stand around its marked article


def names_bad(tag: str, attrs: str, in_article: bool) -> bool | frozenset[str]:
    """True: bad by the tag or hidden; else the names that speak against the element (none: not bad)."""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return True
    found: set[str] = set()
    if not attrs or tag in ("body", "html"):
        return frozenset()
    for kind, *values in NAMED.findall(attrs):
        kind, value = kind.lower(), next(filter(None, values), "")
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return True
        if kind == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            continue
        if kind in ("class", "id", "role"):
            own: set[str] = set()
            for name in value.split():
                for part in NAME.findall(CAMEL.sub(" ", name).lower()):
                    if part in MODIFIERS:
                        break
                    own.add(part)
            found |= own & BAD_NAMES
            if "header" in own and tag not in ARTICLE_TAGS and not in_article:
                found.add("header")
    return frozenset(found)


def deeper(chain: Chain, names: frozenset[str]) -> Chain:
    """The chain with one more element inside: its names with their levels."""
    held = [key for element in chain for key in element]
    own = tuple((n, min(LEVELS, 1 + sum(n == x for x, _ in held))) for n in sorted(names))
    return chain if own in chain else (*chain, own)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple] = [("", False, (), 0, ())]   # tag, bad by tag, elements bad by name, article number, its elements bad by name
    places: dict[str, list[int]] = {}               # of the open tags in the stack
    chains: dict[tuple, Chain] = {}
    text: list[str] = []
    linked = links = breaks = articles = at = 0
    heading = False

    def flush():
        nonlocal text, linked, heading, breaks
        body = " ".join(html.unescape("".join(text)).split())
        if body:
            _, bad, names, zone, around = stack[-1]
            out.append(Block(body, linked, heading, zone, bad or bool(names), "", bad, names, around))
        text, linked, heading, breaks = [], 0, False, 0

    def add(piece):
        nonlocal linked, breaks
        if piece:
            text.append(piece)
            if breaks and not piece.isspace():
                breaks = 0
            if links:
                linked += len(" ".join(piece.split()))

    def close(tag, until=()):
        """Pop up to ``tag`` if it is open below none of ``until``."""
        own = places.get(tag)
        if not own or any(places[t][-1] > own[-1] for t in until if places.get(t)):
            return
        first = own[-1]
        for t, *_ in stack[first:]:
            places[t].pop()
        del stack[first:]

    for m in tokens(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            if breaks == 2:
                flush()
            else:
                text.append("\n")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if m["end"]:
            if tag == "a":
                links = 0
            if tag not in VOID_TAGS:
                close(tag, () if block else BLOCK_TAGS)
            continue
        if tag in VOID_TAGS:
            continue
        if block:
            links = 0
            close("p", BLOCK_TAGS - {"p"})
            if tag == "li":
                close("li", ("ul", "ol", "menu", "dir"))
            elif tag in ("dd", "dt"):
                close("dd", ("dl",))
                close("dt", ("dl",))
            elif tag in ("td", "th", "tr"):
                close("td", ("tr", "table"))
                close("th", ("tr", "table"))
                if tag == "tr":
                    close("tr", ("table",))
        _, bad, names, zone, around = stack[-1]
        if tag in ARTICLE_TAGS and not zone and not bad:
            articles += 1
            zone, around = articles, names
        own = frozenset() if bad else names_bad(tag, m["attrs"], zone > 0)
        if own and own is not True:
            if (names, own) not in chains:
                chains[names, own] = deeper(names, own)
            names = chains[names, own]
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, bad or own is True, names, zone, around))
        if tag == "a":
            links = 1
        if block:
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    add(page[at:])
    flush()
    lift(out)
    return out


def lift(blocks: list[Block]) -> None:
    """Lifts the verdicts of names on wrappers, and settles ``named_bad`` and ``zone`` of the blocks."""
    lifted: set[tuple[str, int]] = set()

    def damned(chain: Chain) -> list[tuple]:
        return [element for element in chain if not lifted.issuperset(element)]

    def part(element) -> bool:
        return not any(n in DISCUSSION_NAMES for n, _ in element)

    if any(b.names and not b.tag_bad for b in blocks):
        # the first pass without the verdicts of names
        labels = first_labels([Block(b.text, b.linked, b.heading, b.zone, b.tag_bad) for b in blocks])
        good = [(len(b.text), b) for b, label in zip(blocks, labels) if label in (GOOD, NEAR)]
        if not any(b.zone and not b.names for _, b in good):
            for _, b in good:
                if b.zone and b.names == b.zone_names:    # nothing inside the article damns it
                    lifted.update(key for element in b.names for key in element)
        size: dict[Chain, int] = {}
        for n, b in good:
            size[b.names] = size.get(b.names, 0) + n
        while True:
            inside: dict[tuple[str, int], int] = {}    # good text by the names of the outermost element that damns it
            total = 0
            for chain, n in size.items():
                left = damned(chain)
                if left and not all(map(part, left)):
                    continue
                total += n
                for key in left[0] if left else ():
                    if key not in lifted:
                        inside[key] = inside.get(key, 0) + n
            best = max(inside, key=inside.__getitem__, default=None)
            if best is None or inside[best] <= WRAPPER_SHARE * total:
                break
            lifted.add(best)
    for b in blocks:
        b.named_bad = b.tag_bad or bool(damned(b.names))
        if damned(b.zone_names):
            b.zone = 0


def off_limits(b: Block) -> bool:
    """Boilerplate by its markup, links or copyright sign, whatever its words."""
    return b.named_bad or b.linked > MAX_LINK_DENSITY * len(b.text) or not b.zone and "©" in b.text


def first_pass(b: Block) -> str:
    n = len(b.text)
    if off_limits(b):
        return BAD
    words = WORD.findall(b.text.lower())
    foreign = 0 if b.text.isascii() else len(OTHER_SCRIPT.findall(b.text))
    if foreign * 2 > sum(map(len, words)):
        # scripts that write a word or syllable a character say as much in a third of the length
        n += 2 * len(DENSE_SCRIPT.findall(b.text))
        return by_length(b, n)
    if n < LENGTH_LOW:
        return by_length(b, n)
    most = sum(w in STOPWORDS for w in words)
    if most < STOPWORDS_HIGH * len(words):
        most = max(most, *(sum(w in own for w in words) for own in MORE_STOPWORDS))
    density = most / max(len(words), 1)
    if density >= STOPWORDS_HIGH:
        return GOOD if n > LENGTH_HIGH else NEAR
    if density >= STOPWORDS_LOW:
        return NEAR
    return SHORT if b.zone else BAD


def by_length(b: Block, n: int) -> str:
    """The label of a block of ``n`` characters in a language whose stop words are not known."""
    if n < LENGTH_LOW:
        return BAD if b.linked and not b.zone else SHORT
    return GOOD if n > LENGTH_HIGH else NEAR


def first_labels(blocks: list[Block]) -> list[str]:
    """The first pass over a page. Where no block is rich in known stop words, length and link density alone decide."""
    labels = [first_pass(b) for b in blocks]
    if GOOD in labels or NEAR in labels:
        return labels
    return [label if off_limits(b) else by_length(b, len(b.text)) for b, label in zip(blocks, labels)]


def sides(labels: list[str], edge: str) -> list[tuple[str, str]]:
    """For every block the nearest label that is not short, before it and after it."""
    before, after, last = [], [], edge
    for x in labels:
        before.append(last)
        last = x if x != SHORT else last
    last = edge
    for x in reversed(labels):
        after.append(last)
        last = x if x != SHORT else last
    return list(zip(before, reversed(after)))


def second_pass(blocks: list[Block], labels: list[str], edge: str) -> list[str]:
    """Labels with nothing undecided. ``edge``: the label that stands before the first and after the last block
    (empty: none, the other side decides)."""
    labels = list(labels)
    for i, b in enumerate(blocks):      # a heading goes with the text that soon follows it
        if b.heading and labels[i] == SHORT and not b.named_bad:
            reach, j = 0, i + 1
            while j < len(blocks) and reach <= HEADING_REACH:
                if labels[j] in (GOOD, NEAR):
                    labels[i] = NEAR
                    break
                reach += len(blocks[j].text)
                j += 1
    out = []
    for label, (a, b) in zip(labels, sides(labels, edge)):
        if label == SHORT:
            a, b = a or b or GOOD, b or a or GOOD
            label = GOOD if BAD not in (a, b) else BAD if GOOD not in (a, b) or edge == BAD else GOOD
        out.append(label)
    final = []
    decided = [x if x != NEAR else SHORT for x in out]
    for label, (a, b) in zip(out, sides(decided, edge)):
        if label == NEAR:
            a, b = a or b or GOOD, b or a or GOOD
            label = BAD if a == b == BAD and edge == BAD else GOOD
        final.append(label)
    return final


def main_blocks(page: str) -> list[Block]:
    """The blocks of the main text, in page order."""
    blocks = blocks_of(page)
    labels = first_labels(blocks)
    zones = sorted({b.zone for b in blocks if b.zone})
    marked = []
    for z in zones:
        own = [i for i, b in enumerate(blocks) if b.zone == z and not b.named_bad]
        if any(labels[i] in (GOOD, NEAR) for i in own) or len(zones) == 1:
            marked.append(own)
    if any(marked):
        kept = []
        for own in marked:
            final = second_pass([blocks[i] for i in own], [labels[i] for i in own], "")
            kept += [i for i, label in zip(own, final) if label == GOOD]
        return [blocks[i] for i in sorted(kept)]
    final = second_pass(blocks, labels, BAD)
    if GOOD not in final:    # no long text: what is fairly rich in stop words is the best there is
        final = [GOOD if x == NEAR else BAD for x in labels]
    return [b for b, label in zip(blocks, final) if label == GOOD]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by a line feed; empty if none), n_chars, n_blocks for every page.

    A null html is empty; a null url stays null; repeated rows each have a row. Broken markup (unclosed
    comments, scripts or tags) never fails. An empty table gives no row; extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(p or "") for p in batch.column(2).to_pylist()]
            texts = ["\n".join(b.text for b in own) for own in found]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array(map(len, texts), pa.int64()),
                                   "n_blocks": pa.array(map(len, found), pa.int64())})

    columns = [F.col(c).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))
