"""Operator 8: main text of web pages by boosted trees over DOM nodes.

A page is read into a tree of block nodes (elements, and runs of inline content beside blocks); an inline element
whose attributes name boilerplate is a node within its block's text. Each node has features of its subtree's density, links, attribute tokens, depth, siblings and ancestors; boosted trees give
the odds that it holds main text. Decoding goes from the leaves up: a node is either dropped with all below it,
or kept with the best choice below each child, whichever is likelier; so no kept node lies under a dropped one.
Texts of kept nodes come in page order.

The trees are fitted on the driver from generated pages (a fixed number, ``TRAINING_PAGES``) whose main text is
known; no page of the corpus is used to fit.

Defined results: a null page is an empty one and has an empty text; markup that doesn't end is closed at the
page's end; rows are handled one by one, so repeated rows and clashing columns don't matter.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees

TRAINING_PAGES = 600

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre caption figcaption address summary option button legend".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl select html body article aside nav section div form main header footer td th".split())
NEVER = frozenset("script style textarea title noscript iframe xmp noembed noframes template head select button input form".split())
BOILERPLATE = frozenset("ad ads advert advertisement banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar side widget notice cookie cookies consent popup modal newsletter subscribe signup login search share sharing social related recommended comment comments reply replies disqus pagination pager toolbar copyright legal tags meta".split())
ADVERTS = frozenset("ad ads advert advertisement banner sponsor sponsored promo promotion newsletter subscribe share sharing social related recommended".split())
CONTENT = frozenset("article content entry post main story body text page".split())
TAG_GROUPS = ["article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button select input textarea", "table tbody thead tfoot tr td th", "blockquote pre figure figcaption", "body html", "head title", "#run", "#inline"]
GROUP_OF = {tag: k for k, names in enumerate(TAG_GROUPS) for tag in names.split()}
HASHED = 16

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "text", "chars", "link", "own", "tags", "stops", "paragraphs", "place")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None, place: int):
        self.tag, self.tokens, self.parent, self.place = tag, tokens, parent, place
        self.children: list[Node] = []
        self.text: list[str | Node] = []
        self.chars = self.link = self.own = self.tags = self.stops = self.paragraphs = 0


def _open_leaf(at: Node) -> bool:
    """Whether text goes on in a leaf element: a block inside ends its own text, what isn't shown doesn't."""
    return at.tag in LEAVES and all(n.tag in RAW or n.tag == "#inline" for n in at.children)


def _open_run(at: Node) -> Node | None:
    """The run of inline content at the end of an element, if it ends with one."""
    last = next((n for n in reversed(at.children) if n.tag not in RAW), None)
    return last if last is not None and last.tag == "#run" else None


def _run_node(at: Node, place: int) -> Node:
    """Where inline content goes: into a leaf element without blocks in it, else into a run of its own beside the blocks."""
    if _open_leaf(at):
        return at
    if (run := _open_run(at)) is not None:
        return run
    run = Node("#run", [], at, place)
    at.children.append(run)
    return run


def _tokens(rest: str) -> list[str]:
    return [t for m in ATTRIBUTE.finditer(rest) for t in PIECES.findall((m[2] or m[3] or m[4] or "").lower())] if rest else []


def own_text(node: Node, kept: Callable[[Node], bool]) -> str:
    """A node's own text, with that of the inline nodes in it that are kept."""
    return "".join(t if isinstance(t, str) else own_text(t, kept) if kept(t) else "" for t in node.text)


def parse(page: str) -> Node:
    """The page's tree of block nodes, with own texts and link characters."""
    root = at = Node("html", [], None, 0)
    links, after, end = 0, 0, len(page)
    inside: list[list] = []  # open inline nodes, each with its tag and how many of that tag are open in it

    def put(raw: str, place: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip() or _open_leaf(at) or _open_run(at) is not None:
            node = inside[-1][0] if inside else _run_node(at, place)
            node.text.append(text)
            size = len(text.strip())
            node.own += size
            node.link += size if links else 0

    pos = 0
    while pos < end:
        found = TOKEN.search(page, pos)
        if found is None:
            break
        if found.start() > after:
            put(page[after : found.start()], after)
        pos = after = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if found["end"] else 1
            elif tag == "br":
                put(" ", pos)
            if found["end"]:
                if inside and inside[-1][1] == tag:
                    inside[-1][2] -= 1
                    if not inside[-1][2]:
                        inside.pop()
            elif tag not in VOID and not BOILERPLATE.isdisjoint(tokens := _tokens(found["rest"])):
                up = inside[-1][0] if inside else _run_node(at, pos)
                node = Node("#inline", tokens, up, pos)
                up.children.append(node)
                up.text.append(node)
                inside.append([node, tag, 1])
            elif inside and inside[-1][1] == tag:
                inside[-1][2] += 1
            continue
        if tag not in RAW:
            inside.clear()  # a block ends what inline elements are open
        if found["end"]:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
                links = 0
            continue
        if tag in ("html", "body") and (tag == "html" or at.tag == "body"):
            continue
        closing = ("p",) if tag in CLOSES_P else SAME_CLOSE.get(tag, ())
        node = at
        while closing and node.parent is not None:
            if node.tag in closing:
                at = node.parent
                break
            if node.tag in SCOPE and node.tag not in ("div",):
                break
            node = node.parent
        if tag == "body":
            at = root
        node = Node(tag, _tokens(found["rest"]), at, pos)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = after = close.end() if close else end
        elif tag not in VOID and not found["rest"].endswith("/"):
            at, links = node, 0
    if after < end:
        put(page[after:], after)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def features(root: Node, size: int) -> tuple[list[Node], np.ndarray]:
    nodes = _walk(root)
    for node in reversed(nodes):
        text = own_text(node, lambda _: False)
        node.chars += node.own
        node.stops += len(PUNCTUATION.findall(text)) if text else 0
        node.tags += 1
        node.paragraphs += node.tag == "p"
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link += node.link
            up.tags += node.tags
            up.stops += node.stops
            up.paragraphs += node.paragraphs
    width = len(TAG_GROUPS) + 1
    x = np.zeros((len(nodes), width + 23 + HASHED), np.float32)
    known: dict[int, tuple] = {}
    tags_below: dict[int, Counter] = {}
    for row, node in zip(x, nodes, strict=True):
        up = known.get(id(node.parent)) if node.parent is not None else None
        depth, in_bad, in_good, bad_tags = (up[0] + 1, up[1], up[2], up[3]) if up else (0, 0, 0, 0)
        bad = sum(t in BOILERPLATE for t in node.tokens)
        good = sum(t in CONTENT for t in node.tokens)
        group = GROUP_OF.get(node.tag, width - 1)
        row[group] = 1
        siblings = node.parent.children if node.parent is not None else [node]
        if (tags := tags_below.get(id(node.parent))) is None:
            tags = tags_below[id(node.parent)] = Counter(s.tag for s in siblings)
        same = tags[node.tag]
        row[width : width + 23] = (
            depth,
            len(siblings),
            same / len(siblings),
            len(node.children),
            math.log1p(node.chars),
            math.log1p(node.own),
            node.link / (node.chars + 1),
            math.log1p(node.tags),
            node.chars / node.tags,
            node.stops / (node.chars + 1),
            node.paragraphs,
            node.place / (size + 1),
            bad,
            good,
            in_bad,
            in_good,
            bad_tags,
            GROUP_OF.get(node.parent.tag, width - 1) if node.parent is not None else -1,
            node.chars / (root.chars + 1),
            node.tag in NEVER,
            len(node.tokens),
            sum(t in ADVERTS for t in node.tokens),
            node.chars / (node.parent.chars + 1) if node.parent is not None else 1,
        )
        for t in node.tokens:
            row[width + 23 + sum(t.encode()) * 31 % HASHED] += 1
        bad_here = node.tag in ("nav", "header", "footer", "aside") or node.tag in NEVER
        known[id(node)] = depth, in_bad + bad, in_good + good + (node.tag in ("article", "main")), bad_tags + bad_here
    return nodes, x


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """Texts of the likeliest choice in which nothing is kept below a dropped node."""
    keep_log, drop_log = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    place = {id(n): k for k, n in enumerate(nodes)}
    best, dropped = keep_log.copy(), drop_log.copy()
    kept = np.ones(len(nodes), bool)
    for k in range(len(nodes) - 1, -1, -1):
        kept[k] = best[k] >= dropped[k] and nodes[k].tag not in RAW
        if nodes[k].parent is not None:
            up = place[id(nodes[k].parent)]
            best[up] += max(best[k], dropped[k])
            dropped[up] += dropped[k]
    kept[0] = True
    for k, node in enumerate(nodes[1:], 1):
        kept[k] &= kept[place[id(node.parent)]]
    texts = []
    for node, stays in zip(nodes, kept, strict=True):
        if stays and node.text and node.tag != "#inline" and (text := " ".join(own_text(node, lambda n: bool(kept[place[id(n)]])).split())):
            texts.append(text)
    return texts


def _generated(rnd: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main part."""
    letters = rnd.choice([["ta", "re", "on", "is", "le", "mo", "ku", "é", "na", "ver", "sch"]] * 4 + [["да", "не", "ко", "ри", "щу"], ["天", "地", "玄", "黄"], ["با", "لا", "من"]])
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4)))
    ends = rnd.choice([".", ".", ".", "?", "! ", " …", " *", ""])

    def words(a: int, z: int) -> str:
        return " ".join(word() + rnd.choice(["", "", "", ",", ends]) for _ in range(rnd.randint(a, z))) + rnd.choice([".", "", ends])

    main: set[str] = set()

    def kept(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    def links(a: int, z: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rnd.randint(a, z))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rnd.random() < 0.7 else " | ".join(items)

    def named(kinds: str, inside: str, tags: str = "div div section aside") -> str:
        tag, name = rnd.choice(tags.split()), rnd.choice(kinds.split())
        return f'<{tag} {rnd.choice(["class", "id"])}="{rnd.choice(["", "", "", "box ", "l-", "main-", "post-", "text ", "article-", "page-"])}{name}{rnd.choice(["", "", "", "-inner", " wide", "-layout"])}">{inside}</{tag}>'

    paragraph = lambda: f"<p>{words(1, 40)}</p>"
    noise = [
        lambda: named("ad ads advert banner sponsored promo", rnd.choice([words(2, 40), paragraph()])),
        lambda: named("share social related recommended newsletter", links(1, 5) + rnd.choice(["", words(1, 6)])),
        lambda: named("cookie-notice consent notice popup", paragraph() + "<button>ok</button>"),
        lambda: f"<form>{words(1, 5)}<input name=q><button>go</button></form>",
        lambda: f"<aside>{paragraph()}{links(1, 4)}</aside>",
        lambda: f"<script>{word()}('<div>')</script><style>.{word()}{{color:red}}</style><!-- <p>{word()}</p> -->",
    ]
    some = lambda chance: "".join(n() for n in noise if rnd.random() < chance)
    body = [f"<{rnd.choice(['h1', 'h1', 'h2'])}>{kept(words(1, 12))}</h1>" if rnd.random() < 0.85 else ""]
    for _ in range(rnd.choice([0, 1, 2, 4, 8, 16])):
        kind = rnd.random()
        if kind < 0.7:
            text = kept(words(1, rnd.choice([3, 20, 90])))
            put_in = rnd.random()
            if put_in < 0.2:  # an inline element with a name of boilerplate: an advert, or a part of the text
                tag, at = rnd.choice(["span", "span", "a href=/x", "em", "b"]), rnd.randint(0, len(text.split()))
                before, after = " ".join(text.split()[:at]), " ".join(text.split()[at:])
                if put_in < 0.12:
                    name = rnd.choice("ad ads advert advertisement sponsored promo banner share newsletter subscribe related".split())
                    name, part = rnd.choice([name, f"inline-{name}", f"{name} small"]), words(1, 8)
                else:
                    name, part = rnd.choice("side-note legal-term search-hit notice tags menu-item header-text meta page-header".split()), words(1, 5)
                    main.discard(" ".join(text.split()))
                    kept(f"{before} {part} {after}")
                text = f'{before} <{tag} class="{name}">{part}</{tag.split()[0]}> {after}'
            body.append(rnd.choice([f"<p>{text}</p>", f"<p>{text}", f"<p>{text}<br>", f"<p><em>{text}</em></p>", f"<p><strong>{text}</strong>"]))
        elif kind < 0.8:
            body.append("<ul>" + "".join(f"<li>{kept(words(2, 15))}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>")
        elif kind < 0.9:
            body.append(f"<{rnd.choice(['h2', 'h3'])}>{kept(words(1, 6))}</h2>")
        elif kind < 0.94:
            body.append(f"<blockquote>{kept(words(3, 25))}</blockquote>")
        else:
            a, b, c = (kept(words(1, 15)) for _ in range(3))
            body.append(
                rnd.choice(
                    [
                        f"<ol><li>{a}<ul><li>{b}</li></ul>{c}</li></ol>",
                        f"<table><tr><th>{a}</th><td>{b}</td></tr><tr><td colspan=2>{c}</td></tr></table>",
                        f"<dl><dt>{a}<dd>{b}<dd>{c}</dl>",
                        f"<figure><img src=i.png alt=x><figcaption>{a}</figcaption></figure><pre>{b}</pre><div>{c}</div>",
                        f"<div>{a}<div><div>{b}</div></div>{c}</div>",
                    ]
                )
            )
        if rnd.random() < 0.06:
            body.append(some(0.3))
    open_, close = rnd.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<main><article>", "</article></main>"), ('<section class="entry">', "</section>")])
    if rnd.random() < 0.5:  # names that contradict what the element holds
        name = rnd.choice("sidebar-layout has-sidebar with-header no-comments ad-free menu-open page-footer-fixed search-result social-post notice-page header-text header-fixed page-header tags-page".split())
        open_ = re.sub(r'^<(\w+)( (?:class|id)="([^"]*)")?', lambda m: f'<{m[1]} class="{name}{" " + m[3] if m[3] else ""}"', open_)
    comments = "".join(f'<div class="comment"><p>{words(2, 30)}</p></div>' for _ in range(rnd.randint(1, 4)))
    comments = named("comments replies", f"<h3>{words(1, 2)}</h3>{comments}") if rnd.random() < 0.3 else ""
    inside = rnd.random() < 0.3
    article = open_ + "".join(body) + (comments if inside else "") + close + ("" if inside else comments)
    top = rnd.choice([f"<nav>{links(2, 8)}</nav>", f"<header><h1>{words(1, 3)}</h1><nav>{links(2, 6)}</nav></header>", named("menu navbar header", links(3, 8)), ""])
    foot = rnd.choice([f"<footer>{rnd.choice(['©', '&#169;', 'Copyright', ''])} {rnd.randint(1990, 2030)} {words(1, 20)}</footer>"] * 3 + [named("footer copyright legal", words(3, 30)), ""])
    side = named("sidebar widget", links(2, 8) + paragraph(), "div aside aside") if rnd.random() < 0.3 else ""
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(1, 8)}</title><style>.{word()}{{}}</style></head>{rnd.choice(["<body>"] * 4 + ["<body class=has-sidebar>", "<body class=page>", "<body class='no-comments header-fixed'>"])}'
    return page + top + some(0.3) + rnd.choice([article + side, side + article]) + some(0.1) + foot + rnd.choice(["</body></html>", "</body></html>", ""]), main


def train(pages: int = TRAINING_PAGES, seed: int = 20) -> BoostedTrees:
    """Trees fitted on generated pages; a node is positive if it or one below it holds main text."""
    rnd, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, main = _generated(rnd)
        nodes, x = features(parse(page), len(page))
        good: set[int] = {id(nodes[0])}
        for node in nodes:
            whole, bare = (" ".join(own_text(node, lambda _, x=x: x).split()) in main if node.text else False for x in (True, False))
            at: Node | None = node if whole or bare else None
            if whole:
                good.update(id(t) for t in node.text if isinstance(t, Node))
            while at is not None and id(at) not in good:
                good.add(id(at))
                at = at.parent
        xs.append(x)
        ys.append([id(n) in good or n.tag == "body" for n in nodes])
    return BoostedTrees.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_all(model: BoostedTrees, pages: list[str]) -> list[list[str]]:
    """Main blocks of each page."""
    parsed = [features(parse(p), len(p)) for p in pages]
    if not parsed:
        return []
    odds = model.score(np.concatenate([x for _, x in parsed]))
    cut = np.cumsum([len(x) for _, x in parsed])[:-1]
    return [decode(nodes, o) for (nodes, _), o in zip(parsed, np.split(odds, cut), strict=True)]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text (blocks joined by two line feeds), n_chars, blocks."""
    sent = pages.sparkSession.sparkContext.broadcast(model or train())
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                blocks = extract_all(sent.value, [x or "" for x in part.column(2).to_pylist()])
                text = ["\n\n".join(b) for b in blocks]
                columns = [*part.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(blocks, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "blocks"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long, blocks array<string>")
