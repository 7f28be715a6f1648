"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is the log-odds that it is the article's, by a linear model of where it
stands: in a link, in a block of many links, in a long block or a short one, with sentences or without, in what kind of element,
under a name that says boilerplate. Tags score negative, the more the rarer they are inside articles. All weights come from labelled
pages. One linear scan finds the contiguous region of greatest total, and the text of that region, without the elements marked as
boilerplate inside it, is the article.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evseq.llm import common
from evseq.llm.html_labelled import labelled

#: Elements whose content isn't markup: all up to their own end tag, or the page's end, as in a browser.
RAW = {"script", "style", "iframe", "textarea", "title", "noembed", "noframes", "xmp"}
#: Elements whose content is no text of the page. One without an end tag holds nothing beyond the next block.
UNSEEN = {"head", "noscript", "template", "svg", "select", "datalist", "button", "object", "canvas", "audio", "video"}
#: What may stand in a head; any other start tag ends it, as its end tag is optional.
METADATA = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "head"}
#: Elements that hold no article text.
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Words in class, id, role or aria-label that say so, and words that say nothing beside them. A name is split at hyphens and the like,
#: and all of it must be of these: "related-posts" is boilerplate, "related-work" and "side-effects" are not.
NAMED = re.compile(
    r"ad|ads(?:by\w*|ense\w*|lots?|paces?)?|adverts?|advertis\w*|banners?|sponsor(?:s|ed|ship)?|promo(?:s|ted|tion|tions|tional)?|cookies?|consent|gdpr|notices?|notifications?|alerts?|disclaimer|popup|modal|newsletter|subscribe|signup|login|"
    r"nav(?:s|bar|igation|menu|links?)?|menu|breadcrumbs?|sidebar|side|widgets?|related|recommended|share|sharing|social|comments?|comment(?:list|form|box|area)|disqus|replies|respond|footer|masthead|topbar|toolbar|pagination|pager|complementary|contentinfo|search|skip"
)
BESIDE = re.compile(
    r"|\d+|\w|site|page|main|top|bottom|left|right|center|upper|lower|inline|sticky|fixed|mobile|desktop|global|primary|secondary|sub|js|box(?:es)?|block|section|container|wrap|wrapper|inner|outer|area|region|panel|bar|row|column|col|group|list|items?|"
    r"links?|posts?|articles?|stories|story|news|reading|content|header|head|title|label|text|body|form|field|input|bar|buttons?|icons?|media|unit|slot|space|zone|card|overlay|policy|to|for|this|us|the|your|up"
)
APART = re.compile(r"[\W_]+")
ARTICLE = {"article", "main"}
#: Elements whose class and id say nothing: themes put all kinds of names there.
UNNAMED = {"html", "body", "main"}
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "nobr", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of running text: an id or label there is the name of a passage.
PASSAGES = HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "tr", "td", "th"}
#: Elements that are no containers of their own: what stands in them stands in the container around them.
FLOW = INLINE | PASSAGES | {"ul", "ol", "dl", "tbody", "thead", "section", "body", "html", "center"}
#: What an end tag that isn't there is implied by: a start tag of these ends an open element of those.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A comment; a declaration or the like; a tag, whose quotes count only after an equals sign and only if they are closed; text; a lone <.
TOKEN = re.compile(
    r"""<!--(?:>|->|(?:.*?(?:--!?>|\Z)))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|[^<]++|<""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*\s*$|[.!?。！？…]\s")
#: How notes of rights and the like begin or end; in a short block only.
RIGHTS = re.compile(r"^\s*(?:©|&copy;|&#169;|&#xa9;|\(c\)|copyright\b)|\ball rights reserved|\bpowered by\b", re.IGNORECASE)
#: What a word's score depends on.
FEATURES = ("always", "link", "links of the block", "length of the block", "sentences", "rights", "h1 or h2", "lower heading", "item or cell", "paragraph", "marked", "in an article", "beside an article")
#: Open elements at most, as in browsers: a deeper one takes the place of the last. Containers around a text that are looked at.
DEEPEST, AROUND = 512, 64
#: Greatest score of a word, either way; least score of a word that stands in an article and isn't marked.
MOST, IN_ARTICLE = 4.0, 0.5


@functools.lru_cache(4096)
def named(attributes: str, passage: bool) -> bool:
    """Whether a tag's attributes say boilerplate; of a passage, whether its class does."""
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "class" or key in ("id", "role", "aria-label") and not passage:
            # Classes and roles are lists of names.
            for x in value.split() if key in ("class", "role") else [value]:
                words = APART.split(x)
                said = [bool(NAMED.fullmatch(w)) for w in words]
                if any(said) and all(n or BESIDE.fullmatch(w) for n, w in zip(said, words, strict=True)):
                    return True
                if x in ("site-header", "page-header"):
                    return True
    return False


class Piece:
    """A tag, or text with where it stands. block: the number of the block it is in; around: the containers it is in, or that the
    boilerplate is in which it is in."""

    __slots__ = ("name", "closing", "text", "n", "block", "link", "boiler", "article", "element", "around")

    def __init__(self, name: str, closing: bool = False, text: str = ""):
        self.name, self.closing, self.text = name, closing, text
        self.n, self.block, self.link, self.boiler, self.article, self.element, self.around = 0, 0, False, False, False, "", ()


def pieces(page: str) -> list[Piece]:
    """Tags (name) and texts (name ""), in order of the page. White space between blocks has no words and no place."""
    out: list[Piece] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, boilerplate, article, where it opened, ends with the next block
    low = page.lower()
    last_end: dict[str, int] = {}
    boiler = article = links = block = unseen = 0
    i, n = 0, len(page)

    def pop(at: int) -> None:
        nonlocal boiler, article, links, unseen
        for s in stack[at:]:
            boiler -= s[1]
            article -= s[2]
            links -= s[0] == "a"
            unseen -= s[0] in UNSEEN
        del stack[at:]

    def ended(name: str) -> bool:
        """Whether an end tag of this name still comes."""
        if name not in last_end:
            last_end[name] = low.rfind("</" + name)
        return last_end[name] >= i

    while i < n:
        m = TOKEN.match(page, i)
        i = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if unseen and stack and stack[-1][0] == "head" and m[0].strip():
                    pop(len(stack) - 1)  # text ends the head, too
                if not unseen:
                    p = Piece("", False, m[0])
                    if m[0].strip():
                        p.n, p.block, p.link, p.boiler, p.article = len(m[0].split()), block, bool(links), bool(boiler), bool(article)
                        upto = next((k for k, s in enumerate(stack) if s[1]), len(stack)) if boiler else len(stack)
                        p.around = tuple(s[3] for s in stack[:upto] if s[0] not in FLOW)[-AROUND:]
                        p.element = next((s[0] for s in reversed(stack) if s[0] not in INLINE), "")
                    out.append(p)
            continue
        name, closing = name.lower(), bool(m[1])
        if not closing:
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, i)
                i = end.end() if end else n
                continue
            if unseen and stack[-1][0] == "head" and name not in METADATA:
                pop(len(stack) - 1)
        if name not in INLINE:
            while stack and stack[-1][4]:
                pop(len(stack) - 1)
        if not unseen:
            out.append(Piece(name, closing))
            block += name not in INLINE
        if name in VOID:
            continue
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            # An inline or paragraph end tag doesn't close the containers around it.
            if at >= 0 and not (name in INLINE | {"p", "li"} and any(s[1] or s[2] for s in stack[at + 1 :])):
                pop(at)
            continue
        if m[3].endswith("/") and (name in ("svg", "math") or any(s[0] in ("svg", "math") for s in stack)):
            continue  # of foreign elements, the slash counts
        if (implied := IMPLIED.get(name)) and stack and stack[-1][0] in implied:
            pop(len(stack) - 1)
        if len(stack) >= DEEPEST:
            pop(len(stack) - 1)
        # The header of an article is part of it.
        bad = name in BOILER and not (name == "header" and article) or name not in UNNAMED and bool(m[3]) and named(m[3], name in HEADINGS or bool(article) and name in PASSAGES)
        inside = name in ARTICLE and not bad
        stack.append((name, bool(bad), inside, i, name in UNSEEN and name != "head" and not ended(name)))
        boiler += bool(bad)
        article += inside
        links += name == "a"
        unseen += name in UNSEEN
    return out


def features(seq: list[Piece]) -> np.ndarray:
    """A row of FEATURES for each text that has words, in order."""
    words: dict[int, list[float]] = {}
    has_article = any(p.article and p.n for p in seq)
    for p in seq:
        if p.n:
            w = words.setdefault(p.block, [0, 0, 0, 0])
            w[0] += p.n
            w[1] += p.n * p.link
            w[2] = max(w[2], SENTENCE.search(p.text) is not None)
            w[3] = max(w[3], RIGHTS.search(p.text) is not None)
    out = []
    for p in seq:
        if p.n:
            n, linked, sentences, rights = words[p.block]
            e = p.element
            out.append((1.0, p.link, linked / n, min(np.log2(1 + n), 8) / 8, sentences and n > 4, rights and n < 40, e in ("h1", "h2"), e in HEADINGS and e > "h2", e in ("li", "td", "th", "dt", "dd"), e in ("p", "blockquote", "pre"), p.boiler, p.article, has_article and not p.article))
    return np.array(out, np.float64).reshape(-1, len(FEATURES))


def train(pages: list[str], rounds: int = 30) -> tuple[np.ndarray, dict[str, float]]:
    """Weights of FEATURES, by logistic regression on every word of the labelled pages; and a score for each tag: minus the log-odds
    that one of its kind is outside, scaled to be small beside words'. [+ and +] surround articles."""
    rows, y, n, tag = [], [], [], {}
    for page in pages:
        seq = pieces(page.replace("[+", "<x-in>").replace("+]", "</x-in>"))
        inside = False
        f = iter(features([p for p in seq if p.name != "x-in"]))
        for p in seq:
            if p.name == "x-in":
                inside = not p.closing
            elif p.name:
                tag.setdefault(p.name, [1.0, 1.0])[inside] += 1
            elif p.n:
                rows.append(next(f))
                y.append(inside and not p.boiler)
                n.append(p.n)
    x, y, n = np.array(rows), np.array(y, np.float64), np.array(n, np.float64)
    w, pull = np.zeros(x.shape[1]), 20.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (n * (y - p)) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, {t: -np.log1p(c[0] / c[1]) / 20 for t, c in tag.items()}


@functools.lru_cache(1)
def weights() -> tuple[np.ndarray, dict[str, float]]:
    return train(labelled())


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of greatest total, the shortest of the first such; 0, 0 if no score is positive. One scan."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, at = run, (start, k + 1)
    return at


def scores(seq: list[Piece], model: tuple[np.ndarray, dict[str, float]]) -> list[float]:
    """Of each piece: its words' scores together, or its tag's.

    Words marked as boilerplate, which never enter the text, score nothing between content of the container they stand in, so that an
    inset doesn't cut an article in two; nor do words between two articles score less than nothing for not being in one.
    """
    word, tag = model
    f = features(seq)
    z = np.clip(f @ word, -MOST, MOST)
    free = f.copy()
    free[:, FEATURES.index("beside an article")] = 0
    free = np.clip(free @ word, -MOST, MOST)
    inside = [k for k, p in enumerate(seq) if p.article and p.n and not p.boiler]
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    j = 0
    for k, p in enumerate(seq):
        if p.n:
            if not p.boiler and (p.article or not inside) and z[j] > 0:
                around = p.around[-1] if p.around else -1
                first.setdefault(around, k)
                last[around] = k
            j += 1
    out, j = [], 0
    for k, p in enumerate(seq):
        if p.name:
            out.append(tag.get(p.name, -0.05))
        elif not p.n:
            out.append(0.0)
        else:
            s, between = z[j], bool(inside) and inside[0] < k < inside[-1]
            if p.article and not p.boiler:
                s = max(s, IN_ARTICLE)
            elif between:
                s = max(free[j], 0.0)
            if p.boiler and (between or any(first.get(c, k) < k < last.get(c, k) for c in p.around or (-1,))):
                s = 0.0
            out.append(float(s) * p.n)
            j += 1
    return out


def lines(region: list[Piece]) -> Iterator[str]:
    """The blocks of a region without its boilerplate."""
    blocks: list[list[str]] = [[]]
    for p in region:
        if p.name:
            if p.name not in INLINE:
                blocks.append([])
            elif p.name == "br":
                blocks[-1].append(" ")
        elif not p.boiler:
            blocks[-1].append(p.text)
    for b in blocks:
        if line := " ".join(html.unescape("".join(b)).split()):
            yield line


def extract(page: str, model: tuple[np.ndarray, dict[str, float]] | None = None) -> str:
    """The article's blocks, one to a line."""
    seq = pieces(page)
    start, end = best_region(scores(seq, model or weights()))
    return "\n".join(lines(seq[start:end]))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row. Null, empty or wordless html: an empty text. Pages cut off in the
    middle give what they have. Rows are independent; repeated rows give equal results. The model, a few dozen numbers, is trained by
    the driver on the labelled pages of html_labelled and sent along."""
    model = weights()

    def one(batch: pa.RecordBatch) -> dict:
        out = [extract(x or "", model) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": out, "n_chars": [len(x) for x in out]}

    return common.map_rows(pages.select("page_id", "url", "html"), one, "page_id long, url string, text string, n_chars long")
