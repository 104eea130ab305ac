"""Operator 6: main text of web pages by inferred wrappers (union-free regular expressions).

Pages of a host follow templates. Every page of a host is read as a token stream and aligned
with the wrapper so far: neighbours of one kind fold into repeated groups, parts that some
pages lack become optional groups, texts that differ become slots. Tasks fold the pages they
have, and the wrappers of a host are folded again in two steps, so a host of any size never
meets in one place; a wrapper keeps numbers and digests, no texts.

A page is then read by matching it against its host's wrapper. From the root on, the part that
holds most of the slot text that is no link is entered, until its text is spread over several
parts: this is the article. Inside it, parts whose text is the same on all pages that have them are
template and go, if those pages differ elsewhere: copies of a page tell nothing. An article or
main element tells the same and comes first. Parts that words of class, id or role mark as
comments, adverts, notices or the like are none of it, however long they are, unless nothing else is
there.
"""

from __future__ import annotations

import html
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import materialise, slices, table, text_or_empty, tidy

#: Bytes of wrappers that are broadcast at most; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Wrappers of a host are first folded in so many groups of tasks.
SALTS = 64
#: A part of equal text on all pages that have it is template from so many pages of different text on.
TEMPLATE_PAGES = 3
#: A part is entered if it has this share of the text.
MOST = 0.6
#: A part is not entered if running text beside it has more than this share.
BESIDE_IT = 0.1
#: Elements nested deeper stand beside each other, as browsers have it; no text is lost.
LEVELS = 256
#: Parts that an element of a wrapper holds apart; beyond it the rarer ones are one group a tag, whatever
#: their marks, so that pages with marks of their own don't make a wrapper grow without end.
WIDEST, ANY = 1000, "*"

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = "script|style|textarea|title|noscript|template|iframe|xmp"
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe svg button select option textarea dialog menu canvas audio video".split())
#: Blocks of running text, and those never entered as containers.
RUNNING = frozenset("p pre blockquote h3 h4 h5 h6".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote li tr td figure".split())
#: Elements that a word of class, id or role can mark as no part of the article, and such words.
MARKED = frozenset("div section ul ol dl table header details figure span center".split())
NOT_ARTICLE = frozenset(
    "ad ads adbox advert adverts advertisement advertisements banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "replies reply respond share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget widgets topbar alert disclaimer".split()
)
#: Words that may stand beside these in a mark; any other word makes it mean something else.
BESIDE = frozenset("area bar block bottom box container content inner item items left link links list main outer page post posts right row section site slot top unit wrapper".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = frozenset("table ul ol dl body html article section div td th blockquote main".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "marks", "children", "parent", "block", "level", "home")

    def __init__(self, tag: str, marks: str, parent: Node | None):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.block = tag in BLOCK
        self.level = parent.level + 1 if parent else 0
        #: where its children go
        self.home = self if self.level < LEVELS else parent.home


def parse(page: str) -> Node:
    """A tree of elements and texts; tags that HTML lets out are closed as they must be."""
    root = at = Node("#root", "", None)
    root.block = True
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            at.home.children.append(m["text"])
        elif m["raw"]:
            at.home.children.append(Node(m["raw"].lower(), "", at))
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                found = at
                while found is not None and found.tag != tag:
                    found = found.parent
                if found is not None and found.parent is not None:
                    at = found.parent
                continue
            closing = CLOSES.get(tag, {"p"} if tag in BLOCK else ())
            found = at
            while closing and found is not None and found.tag not in closing:
                found = None if found.tag in KEEPS_OPEN else found.parent
            if closing and found is not None:
                at = found.parent
            marks = ""
            if "=" in m["attrs"]:  # whole words, without the numbers that tell pages apart
                marks = " ".join(sorted({w for x in _MARK.finditer(m["attrs"]) for w in re.sub(r"[0-9]+", "", (x[2] or x[3] or x[4] or "").lower()).split() if w.strip("-_")}))
            node = Node(tag, marks, at)
            at.home.children.append(node)
            if node.block:  # what holds a block is one
                up = at
                while not up.block:
                    up.block = True
                    up = up.parent
            if tag not in VOID and not m["attrs"].endswith("/"):
                at = node
    return root


def is_marked(tag: str, marks: str) -> bool:
    """Whether a mark is made of words for what is no article, and of words that go beside them."""
    if not marks or tag not in MARKED:
        return False
    for mark in marks.split():
        words = {w for w in re.split(r"[^a-z]+", mark) if w}
        if words & NOT_ARTICLE and words <= NOT_ARTICLE | BESIDE:
            return True
    return False


class Part:
    """An element of a wrapper: on how many pages it is; over all pages the length of its text
    that is no link (mass), of that right in it (own) and of that in slots; and the digests of
    its whole and its own text, None where pages differ. seen: the smallest digests of the pages that
    have it, TEMPLATE_PAGES at most, so that pages of one text count as one."""

    __slots__ = ("tag", "marks", "many", "pages", "mass", "digest", "own", "own_digest", "slots", "children", "article", "seen")

    def __init__(self, tag: str, marks: str, many: bool, pages: int, mass: int, digest: int | None, own: int, own_digest: int | None, children: list[Part], seen: tuple[int, ...] = ()):
        self.tag, self.marks, self.many, self.pages, self.children, self.seen = tag, marks, many, pages, children, seen
        self.mass, self.digest, self.own, self.own_digest = mass, digest, own, own_digest
        # on a single page all text may be slots
        self.slots = (own if own_digest is None or len(seen) <= 1 else 0) + sum(c.slots for c in children) if mass else 0
        self.article = tag in ("article", "main") or any(c.article for c in children)

    def key(self) -> tuple[str, str]:
        return self.tag, self.marks

    @property
    def template(self) -> bool:
        return self.digest is not None and len(self.seen) >= TEMPLATE_PAGES


def skipped(tag: str) -> bool:
    return tag in NOT_TEXT


def page_part(root: Node) -> Part:
    """The wrapper of one page."""
    part = part_of(root)
    seen, todo = (part.digest,), [part]
    while todo:
        p = todo.pop()
        p.seen = seen
        todo += p.children
    return part


def part_of(node: Node) -> Part:
    """The wrapper of a part of a page."""
    children: list[Part] = []
    digest, own_digest, mass, own = xxhash.xxh3_64(), xxhash.xxh3_64(), 0, 0
    todo = list(reversed(node.children))
    linked = 0  # depth of links around what comes next, by their ends on the stack
    while todo:
        child = todo.pop()
        if child is None:
            linked -= 1
        elif isinstance(child, str):
            text = " ".join(html.unescape(child).split()) if "&" in child else " ".join(child.split())
            if text:
                digest.update(text)
                if not linked:
                    own_digest.update(text)
                    own += len(text)
        elif skipped(child.tag):
            continue
        elif child.block:
            part = part_of(child)
            if linked or child.tag == "a":
                part.mass = part.slots = 0
            children.append(part)
            mass += part.mass
            digest.update(struct.pack("<Q", part.digest))
        else:
            if child.tag == "a":
                linked += 1
                todo.append(None)
            todo += reversed(child.children)
    return Part(node.tag, node.marks, False, 1, mass + own, digest.intdigest(), own, own_digest.intdigest(), fold(children))


def fold(children: list[Part]) -> list[Part]:
    """Neighbours of one key on a page become a repeated group."""
    out: list[Part] = []
    for child in children:
        if out and out[-1].key() == child.key():
            out[-1] = merge(out[-1], child, True)
        else:
            out.append(child)
    return out


def merge(a: Part, b: Part, page: bool = False) -> Part:
    """What matches all that a or b match. page: both are of one page and follow each other."""
    if page:
        digest, own_digest = (xxhash.xxh3_64_intdigest(struct.pack("<2Q", x, y)) for x, y in ((a.digest, b.digest), (a.own_digest, b.own_digest)))
    else:
        digest, own_digest = (x if x == y else None for x, y in ((a.digest, b.digest), (a.own_digest, b.own_digest)))
    pages = 1 if page else a.pages + b.pages
    seen = a.seen if a.seen == b.seen else tuple(sorted({*a.seen, *b.seen})[:TEMPLATE_PAGES])
    return Part(a.tag, a.marks, a.many or b.many or page, pages, a.mass + b.mass, digest, a.own + b.own, own_digest, narrow(align(a.children, b.children, page)), seen)


def narrow(parts: list[Part]) -> list[Part]:
    """The same parts, but for the rarer ones if there are too many."""
    if len(parts) <= WIDEST:
        return parts
    often = set(sorted(range(len(parts)), key=lambda i: (parts[i].marks == ANY, -parts[i].pages, i))[: WIDEST // 2])
    rest: dict[str, Part] = {}
    for i, p in enumerate(parts):
        if i not in often:
            p = Part(p.tag, ANY, True, p.pages, p.mass, p.digest, p.own, p.own_digest, p.children, p.seen)
            rest[p.tag] = merge(rest[p.tag], p) if p.tag in rest else p
    return [p for i, p in enumerate(parts) if i in often] + list(rest.values())


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common sequence. Bits of a number stand for the places of b: after each
    item of a, a bit is 0 where one more of b makes the sequence longer; then it is read back."""
    where: dict = {}
    for y, key in enumerate(b):
        where[key] = where.get(key, 0) | 1 << y
    every = (1 << len(b)) - 1
    rows, bits = [], every
    for key in a:
        met = bits & where.get(key, 0)
        bits = ((bits + met) | (bits - met)) & every
        rows.append(bits)
    out, x, y = [], len(a), len(b)
    while x and y:
        if rows[x - 1] >> (y - 1) & 1:
            y -= 1
        else:
            x -= 1
            if not x or rows[x - 1] >> (y - 1) & 1:
                y -= 1
                out.append((x, y))
    return out[::-1]


def align(a: list[Part], b: list[Part], page: bool = False) -> list[Part]:
    """Parts of one key in both are merged along a longest common sequence of keys; what only
    one side has stays, and is optional as it is on fewer pages than what holds it."""
    keys_a, keys_b = [x.key() for x in a], [x.key() for x in b]
    out: list[Part] = []
    i, j, n, m = 0, 0, len(a), len(b)
    tail: list[Part] = []
    while i < n and j < m and keys_a[i] == keys_b[j]:
        out.append(merge(a[i], b[j], page))
        i, j = i + 1, j + 1
    while n > i and m > j and keys_a[n - 1] == keys_b[m - 1]:
        n, m = n - 1, m - 1
        tail.append(merge(a[n], b[m], page))
    at_a, at_b = i, j
    for x, y in common(keys_a[i:n], keys_b[j:m]):
        out += [*a[i : x + at_a], *b[j : y + at_b], merge(a[x + at_a], b[y + at_b], page)]
        i, j = x + at_a + 1, y + at_b + 1
    return [*out, *a[i:n], *b[j:m], *tail[::-1]]


def infer(pages: Iterable[str]) -> Part | None:
    wrapper = None
    for page in pages:
        one = page_part(parse(page))
        wrapper = one if wrapper is None else merge(wrapper, one)
    return wrapper


def dump(wrapper: Part) -> bytes:
    """The parts from the root on, with their levels."""
    out, todo = [], [(0, wrapper)]
    while todo:
        level, p = todo.pop()
        out.append(f"{level}\t{p.tag}\t{p.marks}\t{int(p.many)}\t{p.pages}\t{p.mass}\t{'' if p.digest is None else p.digest}\t{p.own}\t{'' if p.own_digest is None else p.own_digest}\t{' '.join(map(str, p.seen))}")
        todo += [(level + 1, c) for c in reversed(p.children)]
    return "\n".join(out).encode(errors="surrogatepass")


def load(raw: bytes) -> Part:
    rows = [x.split("\t") for x in raw.decode(errors="surrogatepass").split("\n")]
    open_: list[list[Part]] = [[]]
    for level, tag, marks, many, pages, mass, digest, own, own_digest, seen in reversed(rows):  # children before their parents
        level = int(level)
        while len(open_) < level + 2:
            open_.append([])
        children, open_[level + 1] = open_[level + 1][::-1], []
        open_[level].append(Part(tag, marks, many == "1", int(pages), int(mass), int(digest) if digest else None, int(own), int(own_digest) if own_digest else None, children, tuple(map(int, seen.split()))))
    return open_[0][0]


def as_expression(part: Part, pages: int | None = None) -> str:
    """The wrapper as a union-free regular expression over tags, for people to read."""
    inner = "".join(as_expression(c, part.pages) for c in part.children)
    text = "" if not part.own else "#text" if part.own_digest is None or len(part.seen) <= 1 else "#same"
    body = f"<{part.tag}>{text}{inner}</{part.tag}>"
    group = f"({body})+" if part.many else body
    return f"({group})?" if pages is not None and part.pages < pages else group


def matched(node: Node, part: Part | None) -> list[tuple[Node, Part | None]]:
    """The blocks right below a node, each with the part of the wrapper that it matches: the
    next of its key, as the expression goes, or the first."""
    blocks, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if not isinstance(child, str) and not skipped(child.tag):
            if child.block:
                blocks.append(child)
            else:
                todo += reversed(child.children)
    if part is None:
        return [(b, None) for b in blocks]
    places: dict[tuple[str, str], list[int]] = {}
    for i, c in enumerate(part.children):
        places.setdefault(c.key(), []).append(i)
    out, at, last = [], 0, None
    for b in blocks:
        key = b.tag, b.marks
        if key not in places:
            key = b.tag, ANY
        if key not in places:
            out.append((b, None))
            continue
        if key != last:  # neighbours of one key share their group
            at = next((i for i in places[key] if i >= at), places[key][0])
            here, at, last = at, at + 1, key
        out.append((b, part.children[here]))
    return out


def article(root: Node, wrapper: Part) -> tuple[list[Node], Part, list[tuple[Node, Part]]]:
    """The nodes that hold the page's article, their part of the wrapper, and headings that
    stand beside them or what holds them."""
    nodes, part, headings = [root], wrapper, []
    while not (part.tag == "article" or part.tag == "main" and not any(c.article for c in part.children)):
        groups: dict[int, tuple[Part, list[Node]]] = {}
        for node in nodes:
            for child, own in matched(node, part):
                if own is not None and (own.mass > 0 or own.article) and own.tag != "header":
                    groups.setdefault(id(own), (own, []))[1].append(child)
        found = list(groups.values())
        told = [g for g in found if g[0].article]
        # where other parts have text of their own, what is marked is no way to the article
        alone = len(wrapper.seen) <= 1
        found = told or [g for g in found if not is_marked(*g[0].key()) and (alone or g[0].slots)] or found
        slots = any(g[0].slots for g in found)
        measure = (lambda g: (g[0].slots if slots else g[0].mass) / g[0].pages)
        top = max(found, key=lambda g: (not is_marked(*g[0].key()), measure(g)) if told else (True, measure(g)), default=None)
        if top is None:
            break
        if not told:
            total = sum(map(measure, found)) + part.own / part.pages
            running = sum(measure(g) for g in found if g is not top and g[0].tag in RUNNING)
            if measure(top) < MOST * total or running + part.own / part.pages > BESIDE_IT * total or top[0].many or top[0].tag in TEXT:
                break
            headings += [(n, g[0]) for g in found if g[0].tag in ("h1", "h2") and measure(g) for n in g[1]]
        part, nodes = top
    return nodes, part, headings


def left_out(part: Part, inside: Part, marks_count: bool = True) -> bool:
    """Whether a part inside the article is none of it."""
    if part.tag == "header" and inside.tag in ("#root", "html", "body"):
        return True
    marked = is_marked(*part.key()) or part.tag == "p" and is_marked("div", part.marks)
    if part.template and inside.digest is None and (marked and marks_count or part.tag in MARKED and not part.article):
        return True
    return marks_count and is_marked(*part.key())


def main_text(page: str, wrapper: Part | None) -> str:
    """The article's blocks, one a line. Without a wrapper the page is its own."""
    if not page:
        return ""
    root = parse(page)
    found = article(root, wrapper or page_part(root))
    # where all that is there is marked, the marks mean something else
    return _text_of(*found, True) or _text_of(*found, False)


def _text_of(starts: list[Node], inside: Part, headings: list[tuple[Node, Part]], marks_count: bool) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    todo: list = [x for s in reversed(starts) for x in (None, (s, inside))]
    todo += [x for h, own in reversed(headings) for x in (None, (h, own))]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            held.append(item)
        else:
            node, part = item
            if node.tag == "br":
                held.append(" ")
            elif not skipped(node.tag) and (part is inside or not (marks_count and is_marked(node.tag, node.marks) if part is None else left_out(part, inside, marks_count))):
                if node.block:
                    close()
                    todo.append(None)
                parts = {id(b): own for b, own in matched(node, part)} if part is not None else {}
                todo += [c if isinstance(c, str) else (c, parts.get(id(c))) for c in reversed(node.children)]
    close()
    return "\n".join(blocks)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _inferred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, wrapper: a task's pages folded by host."""
    held: dict[str, Part] = {}
    met: set[int] = set()
    for batch in slices(batches, 64):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            copy = xxhash.xxh3_64_intdigest(f"{host}\n{page}".encode(errors="surrogatepass"))
            if page and copy not in met:  # copies in one task are one page
                met.add(copy)
                one = page_part(parse(page))
                held[host] = merge(held[host], one) if host in held else one
        if len(met) > 200_000:
            met.clear()
        if len(held) > 2000:
            yield _wrappers(held)
            held = {}
    yield _wrappers(held)


def _wrappers(held: dict[str, Part]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(dump, held.values()), pa.binary())], names=["host", "wrapper"])


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers folded by host; those of a host come one after another."""
    last, held = None, None
    for batch in slices(batches, 256):
        for host, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if host != last and held is not None:
                yield _wrappers({last: held})
                held = None
            held = load(raw) if held is None else merge(held, load(raw))
            last = host
    if held is not None:
        yield _wrappers({last: held})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper. pages: host, html. Every page counts; wrappers are folded within tasks,
    then by host and salt, then by host."""
    kind = "host string, wrapper binary"
    first = pages.select("host", "html").mapInArrow(lambda b: tidy(_inferred(b)), kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = first.repartition("host", "salt").sortWithinPartitions("host", "salt", F.xxhash64("wrapper")).select("host", "wrapper").mapInArrow(_folded, kind)
    return some.repartition("host").sortWithinPartitions("host", F.xxhash64("wrapper")).mapInArrow(_folded, kind)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null and empty pages and pages without text give the empty text; pages with a null or odd
    url form one host; repeated rows are each extracted. Of two parts with equally much text
    the first on the page is entered. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(page).alias("html")).withColumn("host", host_of("url"))
    wrappers = materialise(infer_wrappers(given), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper") + 64), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_BYTES:
        sent = given.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in wrappers.collect()})
        hosted = given.withColumn("wrapper", F.lit(None).cast("binary"))
    else:
        sent = given.sparkSession.sparkContext.broadcast({})
        hosted = given.join(wrappers, "host", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Part] = {}
        for batch in slices(batches, 128):
            texts = []
            for host, raw, one in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if one and host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = load(raw or sent.value[host])
                texts.append(main_text(one, known[host]) if one else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = given.schema["page_id"].dataType.simpleString()
    return hosted.select("page_id", "url", "host", "wrapper", "html").mapInArrow(lambda b: tidy(run(b)), f"page_id {kind}, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
