"""HTML extraction by tree scoring."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_or_empty

#: A quote opens a value only after an equals sign; anywhere else it is a character like others.
PART = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S
)
ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
TEXTUAL = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
DROPPED = frozenset(
    "head nav footer aside form button select option input label fieldset dialog menu canvas object audio video map script style "
    "textarea title noscript template iframe xmp noembed noframes search "
    # What pictures and formulas hold beside what they show.
    "defs desc metadata symbol annotation annotation-xml".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners cookie cookies "
    "consent gdpr notice notices alert newsletter subscribe subscription signup login signin popup modal overlay sidebar sidebars sidenav rail nav navbar "
    "navigation menu menus breadcrumb breadcrumbs crumbs pagination pager paginator header masthead topbar footer foot footnav colophon comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations widget widgets toolbar search form skip".split()
)
#: Words that may well stand in the names of an article's own parts, such as related-work: they tell of a part of the layout only
#: where all words of the name do, and never, in an article, of a paragraph or another element of text.
WEAK = frozenset(
    "skip rail share sharing social related recommended recommendations notice notices alert banner banners popup modal overlay widget widgets toolbar "
    "reply replies respond header search form topbar masthead footer menu menus signup login signin subscription promotion".split()
)
LAYOUT = frozenset(
    "posts post links link list lists items item button buttons bar box icon icons articles article stories block wrap wrapper container section area content inner outer "
    "main site page top bottom left right row col column head title more also you may like us on the to by by via email facebook twitter print".split()
)
#: An article has a header of its own.
ARTICLE_NOISE = NOISE - {"header", "search", "form"}
#: A name with such a word tells what a page has, as in has-sidebar.
ABOUT = frozenset("with without has no".split())
#: For these only what names an advert or a comment counts: their class may name a page that has a sidebar, say.
KEPT = frozenset("html body main article".split())
KEPT_NOISE = frozenset("ad ads advert advertisement sponsored promo comment reply related".split())
#: An open element that a start tag ends.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "tfoot": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
SCOPE = frozenset("ul ol dl table div section article main body html td th aside nav footer header form blockquote select".split())
#: End tags that close elements beyond a cell or a table.
TABLE_ENDS = frozenset("td th tr tbody thead table body html".split())
P_SCOPE = SCOPE - {"ul", "ol", "dl"} | {"li"}


def names_noise(token: str, noise: frozenset[str], textual: bool) -> bool:
    """If one name of a class or an id tells that an element is no part of an article."""
    words = {w.lower() for w in NAME_PART.findall(token)}
    found = words & noise
    if not found or words & ABOUT:
        return False
    return bool(found - WEAK) or not textual and words <= NOISE | LAYOUT


def is_noise(tag: str, raw_attrs: str, in_article: bool) -> bool:
    """If an element is no part of an article by its name, role, class, id or being hidden."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not raw_attrs or "=" not in raw_attrs and "hidden" not in raw_attrs:
        return False
    for name, a, b, c in ATTR.findall(raw_attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            noise = KEPT_NOISE if tag in KEPT else ARTICLE_NOISE if in_article else NOISE
            if any(names_noise(token, noise, in_article and tag in TEXTUAL) for token in value.split()):
                return True
    return False


class Tree:
    """Elements in page order, and the runs of text between the borders of blocks."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.noise = ["#page"], [-1], [False]
        self.runs: list[tuple[int, str, int]] = []  # block element, text, characters of it within links
        self._run: list[str] = []
        self._links, self._owner = 0, 0
        self._open = [0]
        self._places: dict[str, list[int]] = {}  # of each tag, where its open elements stand in _open
        self._blocks = [0]
        self._article, self._link = 0, 0
        at = 0
        while m := PART.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(tag)
            else:
                attrs = m["attrs"]
                self._start(tag, attrs)
                if tag in RAW:
                    # On the page itself: a page in lower case can be longer.
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I | re.A).search(page, at)
                    at = end.start() if end else len(page)
                elif tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "em", "strong"):
                    self._pop()
        self._text(page[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self.noise[self._open[-1]]:
            self._run.append(raw)
            if self._link:
                self._links += len(raw)

    def _flush(self) -> None:
        if self._run:
            # What one piece leaves open, the next may not close: each piece is decoded alone.
            text = SPACE.sub(" ", "".join(map(html.unescape, self._run))).strip()
            if text:
                self.runs.append((self._owner, text, self._links))
            self._run, self._links = [], 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._end_up_to(("p",), P_SCOPE)
        if tag in ENDS:
            self._end_up_to(ENDS[tag], SCOPE - ENDS[tag])
        up = self._open[-1]
        new = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.noise.append(self.noise[up] or is_noise(tag, attrs, self._article > 0))
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in BLOCK:
            self._blocks.append(len(self._open))
        self._open.append(new)
        self._article += tag in ("article", "main")
        self._link += tag == "a"
        if tag in BLOCK:
            self._flush()
            self._owner = new
        elif tag == "br":
            self._text(" ")

    def _pop(self) -> None:
        tag = self.tag[self._open.pop()]
        self._places[tag].pop()
        self._article -= tag in ("article", "main")
        self._link -= tag == "a"
        if tag in BLOCK:
            self._flush()
            self._blocks.pop()
            self._owner = self._open[self._blocks[-1]]

    def _last(self, tags) -> int:
        """Where the innermost open element of ``tags`` stands; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _end_up_to(self, tags, stop) -> None:
        """Close the outermost open element of ``tags`` that no element of ``stop`` shields."""
        opened = [places for t in tags if (places := self._places.get(t))]
        if not opened:
            return
        shield = self._last(stop)
        found = min((places[i] for places in opened if (i := bisect_right(places, shield)) < len(places)), default=0)
        while found and len(self._open) > found:
            self._pop()

    def _close(self, tag: str) -> None:
        """Close the innermost open element of a tag, unless a block, or for what isn't a table's own a cell or table, shields it."""
        found = self._last((tag,))
        if not found or tag not in BLOCK and self._blocks[-1] > found or tag not in TABLE_ENDS and self._last(("td", "th", "table")) > found:
            return
        while len(self._open) > found:
            self._pop()


def best_container(tree: Tree) -> tuple[int, list[float], list[float], list[int]]:
    """The element with the highest score, all scores, the shares of link text, and the sizes of the texts."""
    n = len(tree.tag)
    block = list(range(n))  # the innermost block that holds an element, itself included; elements stand in page order
    for e in range(1, n):
        if tree.tag[e] not in BLOCK:
            block[e] = block[tree.parent[e]]
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for owner, text, linked in tree.runs:
        size = len(text)
        chars[owner] += size
        links[owner] += linked
        given = (1 + text.count(",") + min(size / 100, 3)) * (1 - min(1, linked / size)) if size >= 25 else min(size / 100, 0.25)
        to = tree.parent[owner] if tree.tag[owner] in TEXTUAL else owner
        for share in (1, 0.5, 0.25, 0.125):
            if to < 0:
                break
            to = block[to]
            points[to] += given * share
            to = tree.parent[to]
    for e in range(n - 1, 0, -1):
        chars[tree.parent[e]] += chars[e]
        links[tree.parent[e]] += links[e]
    density = [min(1.0, k / c) if c else 0.0 for k, c in zip(links, chars, strict=True)]
    scores = [p * (1 - d) for p, d in zip(points, density, strict=True)]
    best = max(range(n), key=lambda e: (scores[e], -e))
    up = best
    while up > 0:  # an element that says it is the article holds all of it
        if tree.tag[up] in ("article", "main"):
            best = up
            if tree.tag[up] == "article":
                break
        up = tree.parent[up]
    return best, scores, density, chars


HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A whole sentence, but for a copyright notice.
SAID = re.compile(r"^(?!\W*(?:©|\(c\)|copyright)).*[.!?…:][\"'»”’)]*$", re.I | re.S)


def keep_beside(tree: Tree, best: int, scores: list[float], density: list[float], kept: list[bool]) -> None:
    """Siblings of the best container that are like it, and sentences beside it; beside an article only other articles."""
    article = tree.tag[best] == "article"
    least = scores[best] * 0.2 if article else max(10.0, scores[best] * 0.2)
    n = len(tree.tag)
    size, texts = [0] * n, [""] * n
    for owner, text, _ in tree.runs:
        size[owner] += len(text)
        texts[owner] = text
    for e in range(1, n):
        if tree.parent[e] != tree.parent[best]:
            continue
        if article:
            kept[e] |= tree.tag[e] == "article" and scores[e] >= least and density[e] < 0.5
        else:
            kept[e] |= scores[e] >= least or tree.tag[e] in TEXTUAL and density[e] < 0.25 and (size[e] > 80 or SAID.search(texts[e]) is not None)


def keep_headline(tree: Tree, best: int, density: list[float], chars: list[int], kept: list[bool]) -> None:
    """A headline before the container, or before one that holds it; else the last of those that are all that a wrapper of theirs holds."""
    end = best + 1
    while end < len(tree.tag) and tree.parent[end] >= best:  # what an element holds follows it
        end += 1
    inner = [tree.tag[owner] for owner, _, _ in tree.runs if best <= owner < end]
    if "h1" in inner or tree.tag[best] == "article" and inner and inner[0] in HEADS:
        return
    above, up = set(), best
    while up > 0:
        up = tree.parent[up]
        above.add(up)
    wrapped = 0
    for e in range(1, best):
        if tree.tag[e] != "h1" or not chars[e] or density[e] >= 0.5:
            continue
        up = e
        while tree.parent[up] not in above and chars[tree.parent[up]] == chars[e]:
            up = tree.parent[up]
        if tree.parent[e] in above:
            kept[e], wrapped = True, -1
        elif tree.parent[up] in above and wrapped >= 0:
            wrapped = e
    if wrapped > 0:
        kept[wrapped] = True


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by line feeds; empty if there is none."""
    tree = Tree(page)
    if not tree.runs:
        return ""
    best, scores, density, chars = best_container(tree)
    n = len(tree.tag)
    kept = [False] * n
    kept[best] = True
    if best and tree.tag[best] not in ("main", "body", "html"):
        keep_beside(tree, best, scores, density, kept)
        keep_headline(tree, best, density, chars, kept)
    for e in range(1, n):
        kept[e] = kept[e] or kept[tree.parent[e]]
    return "\n".join(text for owner, text, _ in tree.runs if kept[owner])


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows of the ``keep`` columns, text and n_chars (code points), one for each page.

    Paragraphs pass points for length and commas to their ancestors, halved
    at each step; an element's points are discounted by the share of link
    text in it. The element with the most points, or the article element
    that holds it, is kept with its like siblings, sentences and a headline
    beside it, also one in a wrapper of its own; beside an article only other
    articles are kept. Menus, notices and other parts that aren't the article
    go. Each task parses its pages one at a time; the work grows with the
    elements of a page, not with those left open.

    A null or empty page, and one without article text, has an empty text.
    Repeated rows and null keys stay. Broken markup is read as far as it
    goes. An empty table gives no rows. Other columns are ignored.
    """
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"]
            )

    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), text_or_empty(html_col).alias("h"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    out = rows.mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "text", "n_chars")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages``; see ``extract_text`` for nulls, repeats and broken pages."""
    return extract_text(table(spark, sf_dir, "pages"))
