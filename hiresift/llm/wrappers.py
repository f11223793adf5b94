"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tokens, one for each block of text: the path of the elements that hold it.  Streams of one host
are aligned one after another: what repeats inside a stream becomes a repeated group, what only one of two streams has
becomes optional, and every token is a slot for text.  The result, without alternatives, is the host's wrapper.  Every
page is then matched against it, and the slots are labelled by the texts they take over the pages of a kind: those inside
furniture (menus, adverts, forms, comments and the like) and those of one text on every page are the template's, and of
the others the slots of the article are kept; where no element says what the article is, the container with most varying
text on a page is taken.  A page's text is what the article's slots take.

Pages of equal shape give equal streams, so a host's wrapper is inferred from its distinct streams, first within parts
of them, then over the parts.
"""
from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import by_arrow, columns, small_batches, text_of, written

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# fixed values: element names of HTML
RAW = frozenset("script style noscript template textarea svg math iframe object select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
FURNITURE = frozenset("head nav header footer aside form button dialog menu".split())
#: parts of class, id and role values that mark furniture
FURNITURE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget navigation contentinfo complementary search".split())
ARTICLE_WORDS = frozenset("article main content post story entry body text".split())
GROUP = 6


def words_of(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))


#: how sure it is that an element is furniture: not, by a word or as a form (which may hold the whole page), by its name or hidden
CLEAN, SOFT, HARD = 0, 1, 2


def element(name: str, attributes: str) -> tuple[str, int]:
    """How an element is written in a path (name and class or id), and whether it is hidden or furniture."""
    label, bad = name, SOFT if name == "form" else HARD if name in FURNITURE else CLEAN
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            bad = HARD
        elif value:
            if words_of(value) & FURNITURE_WORDS and name not in ("html", "body", "article", "main"):
                bad = max(bad, SOFT)
            label += "." + re.sub(r"[\s/]+", ".", re.sub(r"\d+", "0", value.strip()))
    return label, bad


@dataclass(eq=False, slots=True)
class Node:
    """An open element: its name, how it is written, its mark, and whether something stands below it."""

    name: str
    label: str
    bad: int
    deep: bool = False


#: of the text in a marked element, the least share that must stand clean on the page for the mark to hold
CLEAN_SHARE = 0.1


def unmarked(found: list[tuple[tuple[Node, ...], str]]) -> None:
    """Lift the marks of containers of the page itself, such as `content-sidebar-wrap`, `no-ads`, or a form around all.

    Where every article or main element stands in furniture, the marks above the fullest are lifted if it holds more text
    than stands outside of furniture.  Where there is none,
    a container that holds over half of the page's text is lifted if next to nothing stands outside of furniture, the
    outermost first.  Elements that are furniture by name, and hidden ones, keep their mark.
    """
    if not any(n.bad == SOFT for nodes, _ in found for n in nodes):
        return
    articles: Counter = Counter()
    for nodes, t in found:
        for k, n in enumerate(nodes):
            if n.name in ("article", "main") and n.bad != HARD:
                above = nodes[:k + 1]
                if all(x.bad == CLEAN for x in above):
                    return
                if all(x.bad != HARD for x in above):
                    articles[above] += len(t)
                break

    def clean() -> int:
        return sum(len(t) for nodes, t in found if all(x.bad == CLEAN for x in nodes))

    if articles:
        best = max(articles, key=articles.__getitem__)
        if articles[best] > clean():  # else teasers beside a text that no element marks
            for n in best:
                n.bad = CLEAN
        return
    if any(n.name in ("article", "main") for nodes, _ in found for n in nodes):
        return
    total = sum(len(t) for _, t in found)
    held: Counter = Counter()
    for nodes, t in found:
        for n in nodes:
            if n.bad == HARD:
                break
            if n.bad == SOFT and n.deep:
                held[n] += len(t)
    for n, chars in held.items():  # in page order, the outer before the inner
        if 2 * chars > total and clean() < CLEAN_SHARE * chars:
            n.bad = CLEAN


def blocks(page: str) -> list[tuple[str, str]]:
    """(path, text) of every block of text in page order; a path's elements end in "!" where furniture begins.

    Tags that never close, or close what isn't open, are read as a browser would roughly: a block ends an open
    paragraph, an item ends the one before, an end tag closes up to its element or is ignored.
    """
    out: list[tuple[tuple[Node, ...], str]] = []
    stack: list[Node] = []
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((tuple(stack), text))

    skip = ""
    for piece in PIECE.findall(page):
        tag = TAG.match(piece) if piece[0] == "<" else None
        if skip:
            if tag and tag[1] and tag[2].lower() == skip:
                skip = ""
            continue
        if not tag:
            if piece[0] != "<" or len(piece) == 1:
                buffer.append(piece)
            elif piece.startswith("<![CDATA["):
                buffer.append(entities.escape(piece[9:].removesuffix("]]>")))
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        if name in RAW:
            if not closing and not piece.endswith("/>"):
                if name == "title":
                    flush()
                skip = name
            continue
        if name in ("br", "hr", "wbr", "img"):
            buffer.append("" if name == "wbr" else " ")
            if name != "hr":
                continue
        if name in INLINE:
            if not closing and element(name, piece[tag.end():])[1]:
                pass
            continue
        flush()
        if closing:
            names = [n.name for n in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name):]
            continue
        if name in CLOSES_P and stack and stack[-1].name == "p":
            stack.pop()
        if stack and stack[-1].name in IMPLIED.get(name, ()):
            stack.pop()
        if name not in VOID and not piece.endswith("/>"):
            if stack:
                stack[-1].deep = True
            stack.append(Node(name, *element(name, piece[tag.end():])))
    if not skip or skip == "title":
        flush()
    unmarked(out)
    return [("/".join(n.label + "!" if n.bad else n.label for n in nodes), text) for nodes, text in out]


Item = tuple  # (key, body, least, most): a slot has its path as key and no body; a group's body is a tuple of items


def slot(path: str) -> Item:
    return (path, (), 1, 1)


def key_of(items: tuple) -> str:
    return items[0][0] if len(items) == 1 and not items[0][1] else "(" + " ".join(i[0] for i in items) + ")"


def folded(items: list[Item]) -> list[Item]:
    """Adjacent repeats of up to GROUP items made one repeated group."""
    changed = True
    while changed:
        changed = False
        for size in range(1, GROUP + 1):
            out, i = [], 0
            while i < len(items):
                part = items[i:i + size]
                n = 1
                while len(part) == size and [p[0] for p in items[i + n * size:i + (n + 1) * size]] == [p[0] for p in part]:
                    n += 1
                if n > 1:
                    same = [items[i + k * size:i + (k + 1) * size] for k in range(n)]
                    merged = [(p[0], _bodies([s[j][1] for s in same]), min(s[j][2] for s in same), max(s[j][3] for s in same)) for j, p in enumerate(part)]
                    if size == 1:
                        out.append((merged[0][0], merged[0][1], merged[0][2], 2))
                    else:
                        out.append((key_of(tuple(merged)), tuple(merged), 1, 2))
                    i += n * size
                    changed = True
                else:
                    out.append(items[i])
                    i += 1
            items = out
    return items


def _bodies(same: list[tuple]) -> tuple:
    """One body for all, so that a fold matches what each of its parts matched."""
    out = same[0]
    for body in same[1:]:
        if body != out:
            out = tuple(aligned(list(out), list(body)))
    return out


def aligned(a: list[Item], b: list[Item]) -> list[Item]:
    """The union-free expression for both: what matches is merged, what doesn't is optional."""
    out: list[Item] = []
    for op, i, j, k, m in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [(x[0], tuple(aligned(list(x[1]), list(y[1]))) if x[1] else (), min(x[2], y[2]), max(x[3], y[3])) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [(x[0], x[1], 0, x[3]) for x in [*a[i:j], *b[k:m]]]
    return folded(out)


#: pages from which a slot of one and the same text is read as part of the template
REPEATED = 3


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


@dataclass
class Wrapper:
    """A host's expression, and what its slots were labelled from the host's pages.

    Slots are the places for text of the expression, numbered from left to right.  A page's stream is matched by
    the sets of slots that each of its blocks can take, so time is linear in the page, and every block gets one slot.
    `labels` has for each kind of page (see kind_of) the slots of its template and the containers, fullest first.
    """

    items: list
    labels: dict

    def __post_init__(self) -> None:
        self.paths: list[str] = []
        self.follow: list[int] = []
        self.nullable, self.first, self.last = self._sequence(self.items)
        self.before = [0] * len(self.paths)
        self.at: dict[str, int] = {}
        for p, path in enumerate(self.paths):
            self.at[path] = self.at.get(path, 0) | 1 << p
            for q in bits(self.follow[p]):
                self.before[q] |= 1 << p
        self.labels = dict(self.labels)
        self.steps: dict[int, int] = {}

    def _link(self, ends: int, starts: int) -> None:
        for p in bits(ends):
            self.follow[p] |= starts

    def _sequence(self, items: list[Item]) -> tuple[bool, int, int]:
        """Whether the items can be empty, and the slots they can begin and end with."""
        nullable, first, last = True, 0, 0
        for key, body, least, most in items:
            if body:
                empty, starts, ends = self._sequence(list(body))
            else:
                empty, starts, ends = False, 1 << len(self.paths), 1 << len(self.paths)
                self.paths.append(key)
                self.follow.append(0)
            if most > 1:
                self._link(ends, starts)
            empty = empty or least == 0
            self._link(last, starts)
            first |= starts if nullable else 0
            last = ends | (last if empty else 0)
            nullable = nullable and empty
        return nullable, first, last

    def _step(self, now: int) -> int:
        if now not in self.steps:
            if len(self.steps) > 20_000:
                self.steps.clear()
            reach = 0
            for p in bits(now):
                reach |= self.follow[p]
            self.steps[now] = reach
        return self.steps[now]

    def slots(self, paths: list[str]) -> list[int] | None:
        """The slot of every block, or None where the expression doesn't match."""
        sets, reach = [], self.first
        for path in paths:
            now = reach & self.at.get(path, 0)
            if not now:
                return None
            sets.append(now)
            reach = self._step(now)
        if not sets:
            return [] if self.nullable else None
        out, can = [], self.last
        for now in reversed(sets):
            if not now & can:
                return None
            p = next(bits(now & can))
            out.append(p)
            can = self.before[p]
        return out[::-1]

    def matches(self, paths: list[str]) -> bool:
        return self.slots(paths) is not None

    def extract(self, found: list[tuple[str, str]]) -> tuple[str, bool]:
        """The texts captured by the article's slots, and whether the expression matches."""
        paths = [p for p, _ in found]
        taken = self.slots(paths)
        if taken is None:
            return by_own_paths(found), False
        kind = kind_of(paths)
        label = self.labels.get(kind, {})
        template = frozenset(label.get("template", ()))
        kept = [(self.paths[k], t) for k, (_, t) in zip(taken, found, strict=True) if k not in template and "!" not in self.paths[k]]
        if kind == "body":
            best = next((c for c in label.get("containers", ()) if any(p.rpartition("/")[0] == c for p, _ in kept)), None)
            chosen = [t for p, t in kept if best is not None and within(p, best)]
        else:
            chosen = [t for p, t in kept if inside(p, kind)]
        return ("\n".join(chosen) if chosen else by_own_paths(found)), True


def by_own_paths(found: list[tuple[str, str]]) -> str:
    """The fallback, for a page that the wrapper doesn't match or of which its article's slots hold nothing: the path rule on this page alone."""
    chars: Counter = Counter()
    for p, t in found:
        chars[p] += len(t)
    own = article_of(chars)
    return "\n".join(t for p, t in found if p in own)


def inside(path: str, kind: str) -> bool:
    if kind == "words":
        return any(words_of(e.partition(".")[2]) & ARTICLE_WORDS for e in path.split("/"))
    return any(e.split(".")[0] == kind for e in path.split("/"))


def within(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/") or not container


def kind_of(paths: list[str]) -> str:
    """How a page says what its article is; pages of a host are labelled with those of their kind only."""
    clean = {p for p in paths if "!" not in p}
    return next((k for k in ("article", "main", "words") if any(inside(p, k) for p in clean)), "body")


def labels_of(paths: list[str], seen: list[tuple[str, int, int, int, bool]]) -> dict:
    """From (kind, slot, pages, chars, varies) of a host: slots whose text never varies are the template's where others' does.

    Of pages without an element for the article, the containers are ordered by the varying text they hold on a page.
    """
    out: dict = {}
    for kind in sorted({r[0] for r in seen}):
        mine = [r[1:] for r in seen if r[0] == kind and "!" not in paths[r[1]]]
        telling = any(varies and pages >= REPEATED for _, pages, _, varies in mine)
        template = sorted(slot for slot, pages, _, varies in mine if telling and not varies and pages >= REPEATED)
        chars, most = Counter(), Counter()
        for slot, pages, n, _ in mine:
            if kind == "body" and slot not in template:
                parent = paths[slot].rpartition("/")[0]
                chars[parent] += n
                most[parent] = max(most[parent], pages)
        # two pages more: one long page alone doesn't outweigh what many pages show
        out[kind] = {"template": template, "containers": sorted(chars, key=lambda c: (-chars[c] / (most[c] + 2), len(c), c))}
    return out


def article_of(chars: Counter) -> frozenset:
    """Of the paths (with their characters of text) those of the article."""
    clean = {p: n for p, n in chars.items() if "!" not in p}
    for names in (("article",), ("main",)):
        inside = [p for p in clean if any(e.split(".")[0] in names for e in p.split("/"))]
        if inside:
            return frozenset(inside)
    inside = [p for p in clean if any(words_of(e.partition(".")[2]) & ARTICLE_WORDS for e in p.split("/"))]
    if inside:
        return frozenset(inside)
    weight: Counter = Counter()
    for p, n in clean.items():
        parent = p.rpartition("/")[0]
        weight[parent] += n
    if not weight:
        return frozenset(clean)
    best = max(sorted(weight), key=lambda p: (weight[p], -len(p)))
    return frozenset(p for p in clean if p == best or p.startswith(best + "/") or not best)


def infer(streams: list[list[str]]) -> list[Item]:
    """The wrapper of token streams, the most frequent first."""
    out: list[Item] | None = None
    for paths in streams:
        mine = folded([slot(p) for p in paths])
        out = mine if out is None else aligned(out, mine)
    return out or []


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1), F.lit("")))


def shapes(pages: DataFrame) -> DataFrame:
    """(host, stream): the distinct folded token streams of each host."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            seen = {(host, "\n".join(_unfold(folded([slot(p) for p, _ in blocks(page)])))) for host, page in zip(batch.column("host").to_pylist(), text_of(batch.column("html")), strict=True)}
            h, s = zip(*sorted(seen), strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_pydict({"host": pa.array(h, pa.string()), "stream": pa.array(s, pa.string())})

    return by_arrow(pages.select("host", "html"), apply, "host string, stream string").distinct()


def _unfold(items: list[Item]) -> list[str]:
    """A stream of the same shape, repeats written twice."""
    return [p for x in items for _ in range(min(x[3], 2)) for p in (_unfold(list(x[1])) if x[1] else [x[0]])]


def _dumped(items: list[Item]) -> str:
    """Every path stands once."""
    number: dict[str, int] = {}

    def plain(x: Item) -> list:
        return [number.setdefault(x[0], len(number)), [plain(y) for y in x[1]], x[2], x[3]]

    return json.dumps([[plain(x) for x in items], list(number)], ensure_ascii=False, separators=(",", ":"))


def _loaded(text: str) -> list[Item]:
    items, names = json.loads(text)

    def whole(x: list) -> Item:
        return (names[x[0]], tuple(whole(y) for y in x[1]), x[2], x[3])

    return [whole(x) for x in items]


#: parts of a host's streams that are inferred apart before they are merged
PARTS = 16


def _merged(rows: DataFrame, keys: list[str], read: Callable[[str], list[Item]]) -> DataFrame:
    """One expression for each key, folded from its rows' one by one: a task holds the expression and not the rows."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        out: list[Item] | None = None
        known: Wrapper | None = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": [key[0]], "expression": [_dumped(out or [])]})

        for batch in batches:
            for *k, text in zip(*(batch.column(c).to_pylist() for c in [*keys, "expression"]), strict=True):
                if tuple(k) != key:
                    if key is not None:
                        yield done()
                    key, out, known = tuple(k), None, None
                mine = read(text)
                if not mine:  # an empty page makes nothing optional
                    continue
                if known is None and out is not None:
                    known = Wrapper(out, {})
                if out is None:
                    out = folded(mine)
                elif not (all(not x[1] and x[2] == x[3] == 1 for x in mine) and known.matches([x[0] for x in mine])):
                    out, known = aligned(out, folded(mine)), None
        if key is not None:
            yield done()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc(F.length("expression")), "expression")
    return by_arrow(dealt.select(*keys, "expression"), apply, "host string, expression string")


def expressions(pages: DataFrame) -> DataFrame:
    """(host, expression): inferred within parts of a host's distinct streams, then over the parts; one row for each host."""
    dealt = shapes(pages).select("host", F.pmod(F.xxhash64("stream"), F.lit(PARTS)).alias("part"), F.col("stream").alias("expression"))
    return _merged(_merged(dealt, ["host", "part"], lambda s: [slot(p) for p in s.split("\n")] if s else []), ["host"], _loaded)


def slot_texts(pages: DataFrame) -> DataFrame:
    """(host, kind, slot, pages, chars, varies) of the slots of the hosts' expressions, on the pages that match."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            rows: dict[tuple, list] = {}
            for host, page, text in zip(batch.column("host").to_pylist(), text_of(batch.column("html")), batch.column("expression").to_pylist(), strict=True):
                found, w = blocks(page), wrapper_of(text, None)
                paths = [p for p, _ in found]
                taken, kind = w.slots(paths), kind_of(paths)
                on_page: dict[int, list[str]] = {}
                for k, (_, t) in zip(taken or (), found if taken else (), strict=True):
                    on_page.setdefault(k, []).append(t)
                for k, texts in on_page.items():
                    digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for t in texts]
                    low, high = min(digests), max(digests)
                    r = rows.setdefault((host, kind, k), [0, 0, low, low, high, high])
                    r[:] = r[0] + 1, r[1] + sum(map(len, texts)), min(r[2], low), max(r[3], low), min(r[4], high), max(r[5], high)
            out = [(*k, *r) for k, r in rows.items()]
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "kind", "slot", "pages", "chars", "low", "low2", "high", "high2"])

    each = by_arrow(pages.select("host", "html", "expression"), apply, "host string, kind string, slot int, pages long, chars long, low string, low2 string, high string, high2 string")
    return each.groupBy("host", "kind", "slot").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), ((F.min("low") != F.max("low2")) | (F.min("high") != F.max("high2"))).alias("varies"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression, seen) of each host: its expression and what its slots hold; one row for each host."""
    inferred = written(expressions(pages), "page-expressions")
    seen = slot_texts(pages.join(inferred, "host")).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("kind", "slot", "pages", "chars", "varies"))).alias("seen"))
    return inferred.join(seen, "host", "left")


_WRAPPERS: dict[tuple, Wrapper] = {}


def wrapper_of(expression: str | None, seen: list[dict] | None) -> Wrapper:
    """Compiled once per worker and host."""
    key = (expression, seen is not None and tuple(tuple(r.values()) for r in seen))
    if key not in _WRAPPERS:
        if len(_WRAPPERS) > 1000:
            _WRAPPERS.clear()
        w = _WRAPPERS[key] = Wrapper(_loaded(expression) if expression else [], {})
        w.labels = labels_of(w.paths, [tuple(r.values()) for r in seen or ()])
    return _WRAPPERS[key]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and whether the host's wrapper matches, of every page.

    A null or empty page, and one without an article, has the empty text.  Pages without a host in their url share one
    wrapper.  Repeated rows are extracted as often as they stand.
    """
    own = columns(pages, "page_id", "url", "html").withColumn("host", host_of("url"))
    learnt = written(wrappers(own), "wrappers")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            texts, fits = [], []
            for page, expression, seen in zip(text_of(batch.column("html")), batch.column("expression").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                text, fit = wrapper_of(expression, seen).extract(blocks(page))
                texts.append(text)
                fits.append(fit)
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": pa.array(list(map(len, texts)), pa.int64()), "fits": fits})

    joined = own.join(learnt, "host", "left").select("page_id", "url", "html", "expression", "seen")
    return by_arrow(joined, apply, "page_id long, url string, text string, n_chars long, fits boolean")
