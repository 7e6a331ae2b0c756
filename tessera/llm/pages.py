"""Main text of web pages by line-block distribution: markup becomes lines, and the lines between a surge and a dive of
the text length over sliding windows stay."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, quoted, table

#: Lines of a window, and the characters that a window needs for a surge; on pages with less, the richest window does.
WINDOW, SURGE = 3, 80
#: A line is a link list if so many percent of its characters stand in links.
LINKS = 60

#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style template noscript iframe object svg math canvas audio video head title textarea select datalist".split())
#: Elements that stand beside an article, or interrupt it.
BESIDE = frozenset("nav footer aside form dialog menu button header".split())
#: Elements that stand in a line; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without a closing tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, an id or a role that mark an element as something beside the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adbox adsense alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies "
    "disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion recommended related search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe toolbar".split()
)
#: What a class begins with that tells of an element's surroundings: has-sidebar, no-comments.
WITHOUT = frozenset("has no not with without".split())
COMMENTS = frozenset("comment comments commentlist comment-list disqus replies reply respond".split())

HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never read as tags.
_RAW = frozenset("script style textarea title".split())

#: A comment; a tag, its quoted attributes in one piece; or a tag that the end of the page cuts off.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_NAMED = re.compile(r"""(?<![-\w])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?<![-\w])hidden(?![-\w])|aria-hidden\s*=\s*["']?true""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _marked(attributes: str, words: frozenset) -> bool:
    """Whether a class, an id or a role holds one of the words."""
    for m in _NAMED.finditer(attributes):
        for said in (m.group(2) or m.group(3) or m.group(4) or "").split():
            parts = [x.lower() for x in _PART.findall(said)]
            if parts and parts[0] not in WITHOUT and (said.lower() in words or not words.isdisjoint(parts)):
                return True
    return False


def _tags(html: str) -> list[tuple]:
    """(start, end, name, closing, attributes) of every tag and comment (name "") in order; what stands in an element of
    UNSEEN that has a closing tag isn't searched for tags."""
    out, at, find = [], 0, _TAG.search
    low = None
    while m := find(html, at):
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        closing, attributes = bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        out.append((m.start(), at, name, closing, attributes))
        if name in _RAW and not closing:
            low = html.lower() if low is None else low
            # Lower-casing may change the length of a few letters; then the tag is looked for as it is written.
            stop = low.find(f"</{name}", at) if len(low) == len(html) else html.find(f"</{name}", at)
            if stop >= 0:
                at = stop
    return out


def _ends(tags: list[tuple]) -> dict[int, int]:
    """For each opening tag its closing one, by position; the last of a name that is open is closed first."""
    opened: dict[str, list[int]] = {}
    out = {}
    for k, (_, _, name, closing, _) in enumerate(tags):
        if name and name not in INLINE and name not in VOID:
            if not closing:
                opened.setdefault(name, []).append(k)
            elif opened.get(name):
                out[opened[name].pop()] = k
    return out


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, whether in an article) of the page's lines; empty ones where something was left out.

    Left out are comments, elements nobody sees, those that stand beside an article by name, class, id or role, and
    readers' comments. An element that holds an article stays whatever its class, and so does an article's own header. What lies beside a page's article leaves a whole window of
    empty lines, an interruption inside an article leaves none.
    """
    tags = _tags(html)
    ends = _ends(tags)
    articles = [k for k, t in enumerate(tags) if t[2] in ("article", "main") and not t[3] and not _marked(t[4], COMMENTS)]
    out: list[tuple[str, int, bool]] = []
    words: list[str] = []
    linked = inside = link = 0
    at, k, n = 0, 0, len(tags)

    def line(empty: int = 0) -> None:
        nonlocal linked
        said = " ".join("".join(words).split())
        if said:
            out.append((said, linked, inside > 0))
        words.clear()
        linked = 0
        out.extend([("", 0, inside > 0)] * empty)

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            words.append(piece)
            if link:
                linked += len("".join(piece.split()))

    while k < n:
        start, end, name, closing, attributes = tags[k]
        say(html[at:start])
        at = end
        k += 1
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if closing else 1
            continue
        if name in ("article", "main"):
            if closing:
                line(WINDOW)
                inside = max(0, inside - 1)
                continue
            if not _marked(attributes, COMMENTS):
                line(0 if inside else WINDOW)
                inside += 1
                continue
        if name in VOID or closing or name in ("html", "body"):
            line()
            continue
        last = ends.get(k - 1)
        gone = name in UNSEEN or (name in BESIDE and not (name == "header" and inside))
        if not gone and attributes and not (last is not None and bisect_right(articles, k) < bisect_right(articles, last)):
            own = MARKS - {"header"} if inside or name in HEADLINES else MARKS
            gone = _marked(attributes, own) or _marked(attributes, COMMENTS) or _HIDDEN.search(_QUOTED.sub("", attributes)) is not None
        if not gone:
            line()
            continue
        line(0 if inside else (WINDOW if name in BESIDE else 1))
        if last is not None:
            at, k = tags[last][1], last + 1
        elif name in _RAW:
            return out  # never closed: nothing of it is text
        link = 0
    say(html[at:])
    line()
    return out


def main_text(html: str | None) -> str:
    """The text between the surges and dives of a page's lines."""
    found = lines(html or "")
    within = any(inside and said for said, _, inside in found)
    sizes = []
    for said, linked, inside in found:
        size = len(said.replace(" ", ""))
        sizes.append(0 if (within and not inside) or linked * 100 > size * LINKS else size)
    if not any(sizes):  # all of it stands in links
        sizes = [0 if within and not inside else len(said) for said, _, inside in found]
    runs, k, n = [], 0, len(sizes)
    while k < n:
        if not sizes[k]:
            k += 1
            continue
        first, empty, j = k, 0, k
        while j < n and empty < WINDOW:  # the dive: a window without text
            empty = 0 if sizes[j] else empty + 1
            j += 1
        last = j - empty
        block = sum(sizes[first : first + WINDOW])
        most = block
        for i in range(first + 1, last):
            block += (sizes[i + WINDOW - 1] if i + WINDOW - 1 < last else 0) - sizes[i - 1]
            most = max(most, block)
        runs.append((first, last, most))
        k = j
    enough = min(SURGE, max((m for _, _, m in runs), default=0))
    keep = [found[i][0] for first, last, most in runs if most >= enough for i in range(first, last) if found[i][0] and not (within and not found[i][2])]
    return " ".join(keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with their main text and its code points, in place of columns of these names if there are any.

    Character references are decoded as HTML5 does, white space (Unicode's) inside a line is one space, lines are joined
    by one space. A page without text, an empty or a null one gives an empty text. Pages don't meet each other: there is
    no shuffle, repeated rows and null keys stay, other columns pass by. A page has to fit in a row. Unclosed elements
    beside the article take nothing with them, but a script or style that never closes hides the rest of the page.
    """
    rest = [c for c in pages.columns if c.lower() not in {text.lower(), n_chars.lower()}]
    row, page = free_names(pages, "row", "page")
    slim = pages.select(F.struct(*(F.col(quoted(c)) for c in rest)).alias(row) if rest else F.struct(F.lit(0).alias("none")).alias(row), F.col(quoted(html)).alias(page))
    schema = T.StructType([slim.schema[row], T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [main_text(h.as_py()) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array([len(s) for s in said], pa.int64())], names=[row, text, n_chars])

    return slim.mapInArrow(run, schema).select(*(F.col(f"{row}.{quoted(c)}").alias(c) for c in rest), quoted(text), quoted(n_chars))


def op13_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The same from the pages' one template: their article's lines, without the advert, the menu and the footer around it.
SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', ' ', 'gs') AS h FROM pages),
a AS (SELECT page_id, url, regexp_extract(h, '<article>(.*)</article>', 1, 's') AS h FROM p),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(a|b|i|em|strong|span|u)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(h, '&amp;?', '&#38;', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&#38;', '&') AS h FROM t)
SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(h, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM d"""
