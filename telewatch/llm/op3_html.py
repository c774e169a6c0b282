"""Main text of web pages from a streaming parser and text-to-tag ratios.

The standard-library parser turns a page into lines (one per block element).
Each line has a text-to-tag ratio; the ratios are smoothed with a Gaussian and
split by a two-cluster threshold into content and the rest.  The content lines
select the region of the page (the article element, or the smallest container
that holds them); all lines of that region are returned except those inside
navigation, adverts, forms, comments and other parts that are not the article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, table

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
NOT_TEXT = frozenset("script style noscript template svg math iframe object canvas audio video "
                     "head title".split())
NOT_ARTICLE = frozenset("nav footer aside form menu dialog button select textarea".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt "
                   "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
                   "legend li main menu nav ol optgroup option p pre search section summary table tbody "
                   "td tfoot th thead title tr ul".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
             "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
             "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
# Words of class, id and role attributes that name a part which is not the article.  A name counts when all its
# words are listed; a part is left out by its name alone when one of them is in PLAIN, or when the name is a word of
# BOILERPLATE with one of LAYOUT ("share-bar", "related-posts"), else if its text agrees.
PLAIN = frozenset("ad ads adv advert advertisement adverts advertising sponsor sponsored promo "
                  "cookie cookies consent gdpr popup modal "
                  "newsletter subscribe paywall sidebar widget widgets nav "
                  "navbar navigation breadcrumb breadcrumbs toolbar topbar footer masthead "
                  "comment comments disqus pagination pager "
                  "complementary contentinfo".split())
BOILERPLATE = PLAIN | frozenset("promotion banner notice notification overlay alert subscription signup login side "
                                "menu copyright reply replies respond share sharing social related "
                                "recommended recommendations skip search".split())
LAYOUT = frozenset("area bar block bottom box column container content feed footer form group holder inner item items "
                   "left links list outer panel post posts reader readers right section site slot stories thread top "
                   "unit user users wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_WORDS = frozenset("article main".split())
SPLIT_NAME = re.compile(r"[^a-z]+")
CUT_TAG = re.compile(r"<[A-Za-z/!?][^>]*\Z")


def _names(attrs) -> tuple[bool | None, bool | None, set[str]]:
    """What class and role, and what the id, say of an element: None if no name
    in them is listed, else whether one is plain; and all words of the names."""
    said: dict[bool, bool | None] = {True: None, False: None}
    seen: set[str] = set()
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            for name in v.lower().split():
                words = {w for w in SPLIT_NAME.split(name) if w}
                seen |= words
                if words & BOILERPLATE and words <= BOILERPLATE | LAYOUT:
                    said[k == "id"] = bool(said[k == "id"] or words & PLAIN or words & LAYOUT)
                elif words == {"site", "header"}:
                    said[k == "id"] = True
    return said[False], said[True], seen


class _Lines(HTMLParser):
    """Parser events to lines ``(text, tags, link characters, containers)``.

    ``within`` has, for each line, the parts by a name that all its text is in
    (numbers into ``parts``: does the name count only beside an article
    element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []    # (tag, container id or -1, left out, part or -1)
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.kinds: list[str] = []                     # by container id
        self.parts: list[bool] = []
        self.within: list[frozenset[int]] = []
        self.shared: frozenset[int] | None = None      # parts that all text of the line so far is in
        self.text: list[str] = []
        self.tags = 0
        self.links = 0

    def _end_line(self):
        words = "".join(self.text).split()
        if words:
            path = tuple(c for _, c, _, _ in self.open if c >= 0)
            self.lines.append((" ".join(words), self.tags, self.links, path))
            self.within.append(self.shared or frozenset())
            self.tags = self.links = 0
        self.text.clear()
        self.shared = None

    def _out(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag == "br":
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        names = [t for t, *_ in self.open]
        if "head" in names and tag not in HEAD_ONLY:
            self._close(len(names) - 1 - names[::-1].index("head"))
        if self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._close(len(self.open) - 1)
        elif tag in BLOCKS:                            # an open p ends at a block, and its inline parts too
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name == "p" or name == tag and tag in ("li", "td", "th", "tr", "dt", "dd"):
                    self._close(k)
                    break
                if name in BLOCKS:
                    break
        out = self._out() or tag in NOT_TEXT or tag in NOT_ARTICLE
        inside = any(t in ("article", "main") for t, *_ in self.open)
        if tag == "header" and not inside:
            out = True
        part = -1
        if not out and tag not in ("html", "body", "article", "main"):
            named, by_id, words = _names(attrs)
            anchor = tag in HEADINGS or inside and tag == "p"
            if anchor or not by_id and any(t == "article" for t, *_ in self.open):
                by_id = None                           # an anchor of the article
            if not words & ARTICLE_WORDS and (named is not None or by_id is not None):
                if named or by_id:
                    out = True
                else:
                    part = len(self.parts)
                    self.parts.append(named is None and inside)
            role = next((v for k, v in attrs if k == "role"), None)
            if role == "main":
                tag_kind = "main"
            else:
                tag_kind = tag
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            out = out or hidden
        else:
            tag_kind = tag
        container = -1
        if tag in BLOCKS and not out:
            container = len(self.kinds)
            self.kinds.append(tag_kind)
        self.open.append((tag, container, out, part))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:                                          # the slash means nothing in HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS or tag == "br":
            self._end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return
            if self.open[k][0] in BLOCKS and tag not in BLOCKS:
                return                                 # a stray inline end tag

    def _close(self, k: int):
        if any(t in BLOCKS for t, *_ in self.open[k:]):
            self._end_line()
        del self.open[k:]

    def handle_data(self, data):
        if not self._out():
            self.text.append(data)
            if data.strip():
                here = frozenset(p for *_, p in self.open if p >= 0)
                self.shared = here if self.shared is None else self.shared & here
            if any(t == "a" for t, *_ in self.open):
                self.links += len(data.strip())


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a kernel of three sigma, renormalised at the ends."""
    reach = max(1, round(3 * sigma))
    kernel = [exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in enumerate(kernel, -reach):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Border between two clusters of values (one-dimensional 2-means)."""
    cut = (min(values) + max(values)) / 2
    for _ in range(50):
        low = [v for v in values if v < cut]
        high = [v for v in values if v >= cut]
        if not low or not high:
            return cut
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _ratios(lines) -> tuple[list[float], float]:
    ratio = smooth([len(t) / max(1, tags) for t, tags, _, _ in lines])
    return ratio, threshold(ratio)


def _left_out(parser: _Lines) -> set[int]:
    """Lines of the named parts whose text is sparse or mostly links."""
    lines, gone = parser.lines, set()
    article = "article" in parser.kinds
    members: dict[int, list[int]] = {}
    for i, parts in enumerate(parser.within):
        for p in parts:
            members.setdefault(p, []).append(i)
    if not members:
        return gone
    _, cut = _ratios(lines)
    for p, mine in members.items():
        if parser.parts[p] and not article:
            continue
        size = sum(len(lines[i][0]) for i in mine)
        # smoothed among its own lines, so that its surroundings do not count
        own = smooth([len(lines[i][0]) / max(1, lines[i][1]) for i in mine])
        if sum(own) / len(own) < cut or 2 * sum(lines[i][2] for i in mine) > size:
            gone.update(mine)
    return gone


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by one space; '' when there is none."""
    if not html:
        return ""
    if html.rfind("<") > html.rfind(">"):              # cut off inside a tag
        html = CUT_TAG.sub("", html)
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    gone, kinds = _left_out(parser), parser.kinds
    lines = [line for i, line in enumerate(parser.lines) if i not in gone]
    if not lines:
        return ""
    ratio, cut = _ratios(lines)
    content = [i for i, r in enumerate(ratio) if r >= cut]
    size = sum(len(lines[i][0]) for i in content)

    def share(c: int) -> float:
        return sum(len(lines[i][0]) for i in content if c in lines[i][3]) / max(1, size)

    named = [c for c, k in enumerate(kinds) if k in ("article", "main")]
    best = max(named, key=lambda c: (share(c), -c), default=None)
    if best is not None and share(best) >= 0.5:
        # an article inside main is the region when it holds the content as well
        inner = [c for c in named if c > best and share(c) >= 0.9 * share(best) and kinds[c] == "article"]
        region = inner[0] if inner else best
        kept = [t for t, _, _, path in lines if region in path]
    else:
        common = set(lines[content[0]][3])
        for i in content[1:]:
            common &= set(lines[i][3])
        region = max(common, default=None)
        kept = []
        for i, (t, _, links, path) in enumerate(lines):
            if region is not None and region not in path:
                continue
            near = lines[max(0, i - 1):i + 2]          # a run of link lines is a menu
            if ratio[i] < cut and len(near) > 1 and all(2 * b > len(a) for a, _, b, _ in near) \
                    and 2 * links > len(t):
                continue
            kept.append(t)
    return " ".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Shape: a map over the pages, no shuffle; a page is parsed as a stream of
    events and only its lines are held.

    Edge cases: null or empty html gives the empty text; a page that ends
    inside a tag loses that tag only; unclosed elements end where the standard
    says or at the end; repeated rows give equal rows; an empty table gives an
    empty result; extra columns do not take part.
    """
    arrow_batches(pages.sparkSession)

    def extract(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))
    return src.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
