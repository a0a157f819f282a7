"""Main text of web pages: flat text blocks, classified by a decision tree over what they and their neighbours hold.

A page becomes a flat sequence of blocks. Each has its word count and link density, those of the blocks before and
after it, and marks of where it stands: inside main content, inside an element made for something else, inside an
element whose name says so. A decision tree trained by Spark on a small labelled table decides which blocks are main
text; the fitted tree is a few dozen numbers that every task applies to its pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
#: An attribute's name and value, or a quoted value without a name; what stands in a value is never a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^a-z0-9]+")

#: Element names by what they mean for the text.
SKIPPED = frozenset("script style noscript template iframe textarea title svg math object noembed noframes canvas audio video select datalist xmp".split())
#: Of these, those whose content is raw text, which an end of page ends where no end tag does; another one left open hides nothing.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label input button picture source output meter progress".split())
#: Inline elements that are judged by their attributes, as block elements are: all but those for code, where names are the code's.
JUDGED = INLINE - frozenset("code kbd samp var data".split())
MAIN = frozenset(("article", "main"))
HARD = frozenset("nav footer aside menu dialog".split())
SOFT = frozenset("form fieldset button label".split())
#: Words in class, id and role that name other parts of a page.
HARD_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar rail menu
    nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert
    alerts popup overlay newsletter subscribe subscription signup login share sharing social related recommended
    comments comment commentlist respond disqus reply replies widget widgets pagination pager complementary contentinfo
    search dialog alertdialog disclaimer copyright toolbar skip""".split()
)
#: In a role, these too.
ROLE_WORDS = HARD_WORDS | frozenset(("status", "warning"))
#: Those that layouts and states of whole pages and articles are named for, too.
WEAK_WORDS = frozenset("sidebar rail widget widgets search notice notices alert alerts share sharing social login overlay toolbar skip".split())
#: Words that beside one of the weak ones in a token name a part of a page; with others (social-history) it is a subject.
PARTS_OF_PAGES = frozenset("left right top bottom first second primary secondary bar box area block list item items links link icons icon button buttons panel section form field input results message messages text title wrap inner outer main side widget".split())
WRAPPERS = frozenset("layout wrapper wrap container page site columns row grid".split())
#: First words of an article's classes for its state and subjects.
SUBJECTS = frozenset("status type format category tag comments".split())
SOFT_WORDS = frozenset("form side modal tags meta".split())
#: Words that name a page's head, which inside main content is the article's own.
HEAD_WORDS = frozenset("header head banner".split())
CONTENT_WORDS = frozenset("article post entry story content body main text".split())
MAIN_WORDS = frozenset("article articlebody maincontent storybody postbody entry main content story post".split())
NOT_OWN = frozenset("has with without no".split())

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "in_main", "hard", "soft", "heading", "page_has_main", "paragraph")


@lru_cache(maxsize=20_000)
def standing(name: str, attrs: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether an element opens main content, a part that is none for sure, a likely one, a page's head, and a part that is none unless an article or main element stands in it.

    Names are judged token by token. Beside a token of content, or on an article or main element, weak words don't
    count, nor do tokens for a post's state and subjects; beside a wrapper's token, weak words inside longer tokens don't.
    """
    hard, soft, main, head = name in HARD, name in SOFT, name in MAIN, name == "header"
    if not attrs or name in ("html", "body"):
        return main, hard, soft, head, False
    tokens = []
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("hidden", "aria-hidden"):
            hard |= value.lower() != "false"
        elif key == "style":
            hard |= "display:none" in value.replace(" ", "").lower()
        elif key in ("class", "id", "role"):
            split = [PARTS.split(CAMEL.sub("-", token).lower().strip("-_")) for token in value.split()]
            tokens += [(key, token) for token in split if not NOT_OWN & set(token)]
    content = name in MAIN or any(CONTENT_WORDS & set(token) and not (HARD_WORDS | SOFT_WORDS | HEAD_WORDS) & set(token) for _, token in tokens)
    if content:
        tokens = [(key, token) for key, token in tokens if len(token) == 1 or token[0] not in SUBJECTS]
    wrapper = any(WRAPPERS & set(token) and not HARD_WORDS & set(token) for _, token in tokens)
    weak = named = False
    words = {key: {word for k, token in tokens if k == key for word in token} for key in ("class", "id", "role")}
    for key, token in tokens:
        own = set(token)
        hard |= bool(own & (ROLE_WORDS if key == "role" else HARD_WORDS - WEAK_WORDS))
        part = own <= WEAK_WORDS | HARD_WORDS | HEAD_WORDS | WRAPPERS | PARTS_OF_PAGES or any(word.isdigit() for word in own)
        weak |= bool(own & WEAK_WORDS) and part and not content and not (wrapper and len(token) > 1)
    for own in words.values():
        soft |= bool(own & SOFT_WORDS) and not own & CONTENT_WORDS
        head |= bool(own & HEAD_WORDS) and not own & CONTENT_WORDS
        named |= bool(own & MAIN_WORDS) and name not in INLINE and not own & (HARD_WORDS | SOFT_WORDS | HEAD_WORDS)
    return (main or named) and not hard and not weak, hard, soft, head, weak


NOWHERE = ("", False, False, False, False, False)


class Blocks:
    """Flat blocks of one page: texts and rows of FEATURES."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.rows: list[list[float]] = []
        self.stack: list[tuple[str, bool, bool, bool, bool, bool]] = []
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.in_link = False
        self.muted: list[tuple[str, int]] = []
        self.open: set[str] = set()
        self.own = NOWHERE
        self.flags = (False, False, False)
        self.read(page)
        self.flush()
        self.look_around()

    def place(self) -> None:
        """Where text stands now; main content undoes softer parts around it, an article or main element weak ones, nothing the hard ones."""
        main = hard = soft = weak = False
        for name, m, h, s, head, w in [*self.stack, self.own]:
            hard |= h
            weak = w or weak and not (m and name in MAIN)
            s |= head and not main
            soft = (soft or s) if not m or hard or weak else s
            main |= m and not hard and not weak
        self.flags = (main, hard or weak, soft)

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split()) if self.pieces else ""
        if text:
            words = text.count(" ") + 1
            linked = len(html.unescape(" ".join(self.linked)).split())
            main, hard, soft = self.flags
            self.texts.append(text)
            self.rows.append([words, min(1.0, linked / words), 0, 0, 0, 0, main, hard, soft, self.own[0] in ("h1", "h2", "h3", "h4", "h5", "h6"), 0, self.own[0] == "p"])
        self.pieces, self.linked = [], []

    def add(self, text: str) -> None:
        if text and not self.muted:
            self.pieces.append(text)
            if self.in_link:
                self.linked.append(text)

    def read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            tag = TAG.search(page, at)
            if tag is None:
                self.add(page[at:])
                break
            self.add(page[at : tag.start()])
            at = tag.end()
            name = tag["name"] or tag["name2"]
            if not name:
                if tag[0].startswith("<![CDATA["):
                    self.add(html.escape(tag[0][9:].removesuffix("]]>")))
                continue
            name, end = name.lower(), tag["end"] or tag["end2"]
            if name in SKIPPED:
                if not end and name not in self.open and (name in RAW or not tag[0].endswith("/>")):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else size if name in RAW else at
                    if not close:
                        self.open.add(name)  # nor is there one further on
                continue
            if name == "a":
                self.in_link = not end
            if name in INLINE:
                attrs = tag["attrs"] or tag["attrs2"] or ""
                if name in ("button", "label"):
                    self.turn(name, end, attrs)
                elif name not in VOID:
                    self.mute(name, end, attrs)
                continue
            if name == "br":
                self.add(" ")
                continue
            self.turn(name, end, tag["attrs"] or tag["attrs2"] or "")

    def mute(self, name: str, end: str, attrs: str) -> None:
        """An inline element begins or ends: one that is hidden or named for something else holds no text of the page."""
        if not end:
            if self.muted and self.muted[-1][0] == name or name in JUDGED and attrs and standing(name, attrs)[1]:
                self.muted.append((name, len(self.stack)))
        elif self.muted and self.muted[-1][0] == name:
            self.muted.pop()

    def turn(self, name: str, end: str, attrs: str) -> None:
        """A block element begins or ends."""
        self.flush()
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):  # these end what was left open in them
            self.muted = [m for m in self.muted if m[1] < len(self.stack)]
        self.in_link = self.in_link and name == "a"
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "hr"):
            self.own = NOWHERE if end else (name, *standing(name, attrs))
        else:
            self.own = NOWHERE
            if not end:
                if name not in VOID and not attrs.endswith("/"):
                    self.stack.append((name, *standing(name, attrs)))
            else:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == name:
                        del self.stack[i:]
                        self.muted = [m for m in self.muted if m[1] <= i]
                        break
        self.place()

    def look_around(self) -> None:
        has_main = any(r[6] and not r[7] for r in self.rows)
        for i, r in enumerate(self.rows):
            if i:
                r[2:4] = self.rows[i - 1][:2]
            if i + 1 < len(self.rows):
                r[4:6] = self.rows[i + 1][:2]
            r[10] = has_main


#: What marks a main block in the labelled pages.
KEEP = "✓ "


def labelled_pages() -> list[str]:
    """The labelled table's pages: main blocks begin with KEEP. Built by rule from layouts and block lengths."""

    def p(n: int, keep: bool = True, tag: str = "p") -> str:
        return f"<{tag}>{KEEP if keep else ''}{'word ' * n}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{'link ' * (1 + i % 3)}</a></li>" for i in range(n)) + "</ul>"

    out = []
    for n in (1, 2, 4, 9, 18, 40, 90):
        for m in (1, 3, 12, 30, 80):
            main = f"<h1>{KEEP}{'head ' * (1 + n % 9)}</h1>" + p(n) + p(m) + p(n, tag="h2") + p(2 * m) + p(n, tag="li")
            other = p(m, False)
            out += [
                f"<nav>{links(6)}</nav><div class='ad'>{other}</div><article>{main}</article><footer>{other}</footer>",
                f"<header>{other}{links(3)}</header><main>{main}</main><aside>{other}{p(n, False)}</aside><footer>{links(2)}{other}</footer>",
                f"<div id='menu'>{links(5)}</div><div id='content'>{main}</div><div class='sidebar'>{other}</div><div id='comments'>{p(n, False)}{p(m, False)}</div>",
                f"<div class='cookie-notice'>{other}</div><article><header>{main}</header>{p(m)}<form>{p(n, False)}</form><div class='share'>{links(3)}</div>{p(n)}</article><section class='comments'>{other}{p(n, False)}</section>",
                f"<article><form>{p(n, False)}</form>{main}<div class='share'>{links(2)}</div>{p(n)}<form><label>{'word ' * n}</label>{p(m, False)}</form>{p(m)}<button>{'word ' * m}</button></article>{links(3)}",
                f"{links(4)}<article>{p(n)}{links(0)}</article>{links(3)}<main>{p(m)}<nav>{links(2)}</nav>{p(n)}<form>{p(m, False)}{p(n, False)}</form></main>",
                f"<nav>{links(4)}</nav>{main}<div class='ad'>{other}</div>{p(n)}<aside>{p(n, False)}{p(m, False)}</aside>{p(m)}<form>{other}</form><footer>{links(2)}{p(n, False)}</footer>",
                f"<header>{other}<nav>{links(4)}</nav></header>{main}<div class='comments'>{p(n, False)}{other}</div><footer>{p(n, False)}</footer>",
                f"<nav>{links(4)}</nav><article><h1><a href='/'>{KEEP}{'head ' * n}</a></h1>{p(m)}<p><a href='/'>{KEEP}{'word ' * m}</a></p>{p(n)}</article>",
                f"<main>{p(n)}<ul><li><a href='/'>{KEEP}{'word ' * n}</a></li></ul>{p(m)}<p><a href='/'>{KEEP}{'word ' * n}</a></p></main>",
                f"<form class='search'>{p(n, False)}</form><main><article>{main}<aside>{other}</aside>{p(n)}</article></main><div class='newsletter'>{p(m, False)}</div>",
                f"<div class='layout right-sidebar'>{links(4)}<article class='post type-post status-publish hentry'>{main}</article><div class='sidebar'>{other}</div></div><footer>{other}</footer>",
                f"<div class='left-sidebar'><main title='The hidden valley'>{main}<div class='widget'>{p(m, False)}</div>{p(n)}</main><div class='widget'>{other}</div></div>",
            ]
            out += [
                f"<div>{links(6)}</div><div>{p(min(m, 6), False, 'span')}</div><div><h1>{KEEP}{'head ' * (1 + n % 9)}</h1>{p(n)}{p(m)}{p(2 * n)}</div><div>{links(4)}</div>",
                f"<div><a href='/'>{'link ' * 3}</a></div><div><h2>{KEEP}{'head ' * (1 + m % 9)}</h2>{p(m)}{p(n)}</div><div>{links(3)}{'word ' * min(n, 5)}</div>",
            ]
            if min(n, m) >= 12:
                out.append(f"<div>{links(7)}</div><div>{p(3, False)}</div><div><h1>{KEEP}{'head ' * 6}</h1>{p(n)}{p(m)}{p(n)}</div><div>{links(4)}</div><div>{p(2, False)}</div>")
    out += [f"{p(n)}{p(2 * n)}{p(n)}" for n in (12, 25, 60)] + [p(40), p(15)]
    return out


def labelled_blocks() -> list[tuple[list[float], float]]:
    """Features and labels of the labelled table's blocks; every fifth page is held out."""
    rows = []
    for page in (page for i, page in enumerate(labelled_pages()) if i % 5):
        blocks = Blocks(page)
        marked = [t.startswith(KEEP.strip()) for t in blocks.texts]
        words = [r[0] - k for r, k in zip(blocks.rows, marked, strict=True)]
        for i, r in enumerate(blocks.rows):
            r = [float(x) for x in r]
            r[0], r[2], r[4] = float(words[i]), float(words[i - 1]) if i else 0.0, float(words[i + 1]) if i + 1 < len(words) else 0.0
            rows.append((r, float(marked[i])))
    return rows


def trained_tree(spark: SparkSession, labelled: list | None = None, depth: int = 7) -> list[tuple]:
    """Nodes (feature, threshold, left, right, keep) of a decision tree trained on the labelled table; feature -1 is a leaf."""
    rows = labelled_blocks() if labelled is None else labelled
    df = spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(df)
    nodes: list[tuple] = []

    def visit(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, -1, -1, node.prediction() > 0.5)
        else:
            split = node.split()
            left, right = visit(node.leftChild()), visit(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right, False)
        return at

    visit(model._java_obj.rootNode())
    return nodes


def main_text(page: str | None, tree: list[tuple]) -> str:
    blocks = Blocks(page or "")
    kept = []
    for text, row in zip(blocks.texts, blocks.rows, strict=True):
        at = 0
        while tree[at][0] >= 0:
            feature, threshold, left, right, _ = tree[at]
            at = left if row[feature] <= threshold else right
        if tree[at][4]:
            kept.append(text)
    return "\n\n".join(kept)


def extracted(pages: DataFrame, html_col: str = "html", tree: list[tuple] | None = None) -> DataFrame:
    """pages with text (main blocks joined by blank lines, empty if none) and n_chars; html itself is left out.

    Null and empty pages have an empty text. White space inside a block, no-break spaces included, is one space;
    character references are decoded; a br element is white space. Repeated rows give equal texts; columns of pages
    named text or n_chars are replaced; an empty table stays empty. One map over the pages, no shuffle.
    """
    tree = trained_tree(pages.sparkSession) if tree is None else tree
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    picked = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`").cast("string").alias("_html"))
    schema = pages.select(*[F.col(f"`{c}`") for c in others]).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return picked.mapInArrow(run, schema)
