"""Main text of web pages as the maximum-scoring run of words and tags.

A page becomes a row of words and tags. Words score positive, tags negative, and words inside a block beside the main
text (menu, advert, form, ...) negative; one linear scan finds the contiguous region of the highest sum. A region that
lies in a main block (``article``, ``main`` or a class of such a name) is rounded out to the whole block, so scores
choose the block and nothing of it gets lost. The region's words, without those of blocks beside, are the main text.

Weights are log-odds counted on labelled pages: pages that mark their main text themselves by one ``article`` element.
A tag costs the more, the oftener its kind (name, classes, id, role; hyphens and underscores don't count) stands outside the main text. A block is beside the
main text by its name (``CHROME``) or if words below its class, id or role stand outside the main text on labelled
pages; neither words nor tags below ``CHROME``, nor tags below ``BESIDE`` names, teach anything about the kinds within, so a menu's links and lists don't
speak against links and lists. ``BESIDE`` names count as a few words seen outside, which labelled pages outweigh. An element that
holds a main block, or a form that holds most words of its page, is a wrapper and not a block beside; a header in a main block is part of it, and so are elements within a line, whatever their classes.

The weights are fitted on about ``SAMPLE`` pages by a hash of their html, all kinds of at least ``LEAST_PAGES`` of them; others are neutral.
Extraction is one pass over all pages without a shuffle; time is linear in a page's length, however deep or broken its markup.

Behaviour: null and empty pages have empty texts; broken markup is read as far as it goes, unclosed
blocks end with their parent, and a tag with an unclosed quote ends at its first ``>``; repeated rows are treated alike; an empty table gives an empty result; other
columns pass through, one named like an added column is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import appended, bounded_sample

#: Fixed values of HTML: elements whose content isn't text of the page, elements without content, and elements that run within a line.
RAW = frozenset("script style template noscript textarea title iframe xmp noembed noframes svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that stand beside the main text by their name.
CHROME = frozenset("nav footer aside form header menu dialog button select head".split())
#: Elements, classes and ids that mark a main block.
MAIN = frozenset("article main .article .articlebody .articlecontent .content .entry .entrycontent .main .maincontent .post .postbody .postcontent .story .storybody".split())
#: Classes, ids and roles that pages commonly give to blocks beside the main text; they count as ``BESIDE_WORDS`` words seen outside.
BESIDE = frozenset(
    """
    .ad .ads .advert .advertisement .adverts .alert .banner .breadcrumb .breadcrumbs .comment .commentlist .comments .consent .contentinfo
    .cookie .cookies .copyright .disqus .footer .header .legal .login .menu .modal .nav .navbar .navigation .newsletter .notice .overlay .pager
    .pagination .popup .promo .promotion .recommended .related .replies .search .share .sidebar .signup .skip .social .sponsor .sponsored
    .subscribe .toolbar .topbar .widget
    """.split()
)
BESIDE_WORDS = 20
SAMPLE = 20_000
LEAST_PAGES = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]++|<", re.S)
#: A tag read without regard to quotes, and the tags of a page with an unclosed quote after which all are read so.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)")
UNCLOSED_QUOTES = 8
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSED_BY: dict[str, frozenset[str]] = {"p": frozenset("p div ul ol table section article h1 h2 h3 h4 h5 h6 pre blockquote form nav aside footer header main figure".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"])}


def kinds_of(name: str, attributes: str) -> tuple[str, ...]:
    """A tag's kinds: its name, and after a dot its classes, id and role, lower-cased without hyphens and underscores."""
    out = [name]
    if "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            out += ["." + v for v in next(filter(None, values), "").lower().replace("-", "").replace("_", "").split()]
    return tuple(out)


def tokens(page: str) -> Iterator[tuple[str, object, object]]:
    """("text", string, None), ("open", name, kinds) and ("close", name, None) in page order; blocks close properly."""
    stack: list[str] = []
    depth: Counter = Counter()  # of each name on the stack
    unclosed: set[str] = set()
    at, low, odd = 0, None, 0

    def pop() -> str:
        top = stack.pop()
        depth[top] -= 1
        return top

    while at < len(page):
        m = _PLAIN_TAG.match(page, at) if odd >= UNCLOSED_QUOTES else None
        m = m or _TOKEN.match(page, at)
        if m.end() == at + 1 and (plain := _PLAIN_TAG.match(page, at)):
            m, odd = plain, odd + 1
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[:2] not in ("<!", "<?"):
                yield "text", piece, None
            continue
        name = name.lower()
        if m.group(1):
            if depth[name]:
                while True:
                    top = pop()
                    yield "close", top, None
                    if top == name:
                        break
            continue
        while stack and name in _CLOSED_BY.get(stack[-1], ()):
            yield "close", pop(), None
        yield "open", name, kinds_of(name, m.group(3))
        if name in ("svg", "math") and m.group(3).endswith("/"):
            yield "close", name, None
        elif name in RAW:
            low = low or page.lower()  # ASCII letters keep their places; others may not, so look again if they don't
            if len(low) != len(page):
                low = re.sub("[A-Z]+", lambda x: x.group().lower(), page)
            end = -1 if name in unclosed else low.find(f"</{name}", at)
            yield "close", name, None
            if end < 0:
                unclosed.add(name)
                at = len(page) if name in ("script", "style") else at  # of others only the tag goes
            else:
                gt = page.find(">", end)
                at = gt + 1 if gt >= 0 else len(page)
        elif name in VOID or m.group(3).endswith("/") and name not in ("p", "div", "span", "a", "li", "article", "section"):
            yield "close", name, None
        else:
            stack.append(name)
            depth[name] += 1
    while stack:
        yield "close", stack.pop(), None


def is_main(kinds: tuple[str, ...]) -> bool:
    return not MAIN.isdisjoint(kinds)


def count_kinds(page: str) -> Counter:
    """Of each kind: tags outside and inside the one ``article``, and words below such tags but not below ``CHROME``.

    Tags below ``CHROME`` or below a block of a ``BESIDE`` name don't count. Empty if the page has no article or several.
    """
    out: Counter = Counter()
    above: list[tuple[str, ...]] = []
    open_kinds: dict[str, list[int]] = {}  # of each kind: open elements, and words outside and inside before the first of them
    words = [0, 0]
    inside, n_main, chrome, apart = 0, 0, 0, 0
    for what, value, kinds in tokens(page):
        if what == "open":
            main = value == "article"
            n_main += main and not inside
            inside += main or inside > 0
            for k in kinds:
                out[k, "tags", bool(inside) and not main] += not apart
            chrome += value in CHROME or chrome > 0
            apart += value in CHROME or value not in INLINE and not BESIDE.isdisjoint(kinds) or apart > 0
            for k in set(kinds):
                open_kinds.setdefault(k, [0, *words])[0] += 1
            above.append(kinds)
        elif what == "close":
            for k in set(above.pop()):
                n, outside, within = open_kinds[k]
                open_kinds[k][0] -= 1
                if n == 1:
                    out[k, "words", False] += words[0] - outside
                    out[k, "words", True] += words[1] - within
                    del open_kinds[k]
            inside, chrome, apart = max(0, inside - 1), max(0, chrome - 1), max(0, apart - 1)
        elif not chrome and (n := len(value.split())):
            words[inside > 0] += n
    out["", "words", False], out["", "words", True] = words
    return +out if n_main == 1 else Counter()


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([held[k] for k in keys], pa.int64())], names=["kind", "what", "inside", "n"])
        held.clear()
        return out

    for batch in batches:
        for page in batch.column(0):
            found = count_kinds(page.as_py() or "")
            held.update(found)
            held.update((k, "pages", True) for k in {k for k, _, _ in found})
            if len(held) > 100_000:
                yield flush()
    if held:
        yield flush()


class Weights:
    """What tags cost and which kinds stand beside the main text."""

    def __init__(self, counts: Counter) -> None:
        seen = Counter(counts)
        for k in BESIDE:
            seen[k, "words", False] += BESIDE_WORDS
        odds = lambda k, what: math.log((seen[k, what, False] + 0.5) / (seen[k, what, True] + 0.5))
        kinds = {k for k, _, _ in seen if k}
        self.word = 1.0
        self.unknown_tag = 0.05
        self.tag = {k: min(3.0, max(0.02, odds(k, "tags") / 2)) for k in kinds if seen[k, "tags", False] or seen[k, "tags", True]}
        self.beside = {k for k in kinds if k.startswith(".") and k not in MAIN and odds(k, "words") > 1} | CHROME

    def cost(self, kinds: tuple[str, ...]) -> float:
        return max(self.tag.get(k, self.unknown_tag) for k in kinds)

    def is_beside(self, kinds: tuple[str, ...]) -> bool:
        """Whether an element of these kinds is struck: never one within a line, nor the page itself."""
        return kinds[0] in RAW or kinds[0] not in INLINE and kinds[0] not in ("html", "body") and not self.beside.isdisjoint(kinds)


def wrappers(page: list[tuple[str, object, object]]) -> tuple[set[int], bool]:
    """Places of the opened elements that hold a main block and of forms that hold over half of the words; whether a single outermost main block has words."""
    out: set[int] = set()
    path: list[tuple[int, bool, int, int]] = []  # place, whether it's a main block, main blocks opened and words before
    forms: dict[int, int] = {}
    words, opened, within, mains = 0, 0, 0, 0
    for i, (what, value, kinds) in enumerate(page):
        if what == "open":
            main = is_main(kinds)
            opened += main
            within += main
            path.append((i, main, opened, words))
        elif what == "close":
            at, main, before, earlier = path.pop()
            within -= main
            mains += main and not within and words > earlier
            if opened > before:
                out.add(at)
            if value == "form":
                forms[at] = words - earlier
        else:
            words += len(value.split())
    return out | {at for at, n in forms.items() if 2 * n > words}, mains == 1


def main_text(page: str | None, weights: Weights) -> str:
    """The words of the best region, joined by blanks."""
    read = list(tokens(page or ""))
    wraps, single = wrappers(read)
    pieces: list[str] = []  # runs of text; white space ends a block
    scores: list[float] = []
    blocks: list[tuple[int, int]] = []  # main blocks, inner ones first
    path: list[tuple[int, bool, bool]] = []
    below, within = 0, 0
    for i, (what, value, kinds) in enumerate(read):
        if what == "text":
            n = len(value.split())
            pieces.append("" if below else value)
            scores.append(-weights.word * n if below or single and not within else weights.word * n)
        elif what == "open":
            beside = i not in wraps and weights.is_beside(kinds) and not (value == "header" and within)
            main = is_main(kinds) and not beside and not below
            path.append((i, beside, main))
            below += beside
            within += main
            pieces.append("" if value in INLINE else "\n")
            scores.append(-weights.cost(kinds))
        else:
            at, beside, main = path.pop()
            below -= beside
            within -= main
            if main:
                blocks.append((at, i + 1))
            pieces.append("" if value in INLINE else "\n")
            scores.append(-weights.tag.get(value, 0.0) if main else 0.0)
    best, start, end, run, at = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, at = 0.0, i
        run += s
        if run > best:
            best, start, end = run, at, i + 1
    if end:
        start, end = next(((a, b) for a, b in blocks if a <= start and end <= b), (start, end))
    return " ".join(html.unescape("".join(pieces[start:end])).split())


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from the self-labelled pages among about ``sample`` of ``pages``."""
    some = bounded_sample(pages.select("html"), "html", sample, 5)
    counts = some.mapInArrow(_count_pages, "kind string, what string, inside boolean, n long").groupBy("kind", "what", "inside").agg(F.sum("n").alias("n"))
    rows = counts.withColumn("_n", F.max(F.when(F.col("what") == "pages", F.col("n"))).over(Window.partitionBy("kind"))).filter(F.col("_n") >= LEAST_PAGES)
    return Weights(Counter({(r.kind, r.what, r.inside): r.n for r in rows.filter("what <> 'pages'").collect()}))  # bounded by the sample


def extract_main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``pages`` and ``text``, ``n_chars`` (code points) of its ``html``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit_weights(pages))  # kinds of a bounded sample

    def start():
        own = shared.value

        def make(column: pa.Array) -> list[pa.Array]:
            texts = [main_text(p.as_py(), own) for p in column]
            return [pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))]

        return make

    return appended(pages, ["html"], "text string, n_chars long", start)
