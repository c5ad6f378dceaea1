"""Main-text extraction with union-free wrappers, inferred for each host.

A page is a stream of tags and text slots. Neighbouring repetitions in a stream
fold into a repeated group ``( ... )+``; the folded streams of a host are then
aligned one after another with its wrapper so far, and what only one side has
becomes an optional group ``( ... )?``, until the wrapper, a regular expression
without unions, covers all of them. A host's pages with text in an article or main
element and its pages without have a wrapper each. Every text of a page stands at
one place of its wrapper, its slot; a slot in a repeated group takes the texts of
all repetitions, and slots of different tag paths never align.

Every slot has a verdict in its wrapper, and a page's main text is the text of the
slots that its wrapper keeps. Slots inside navigation, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are never
main text, nor, on a page with text in an article or main element, slots outside
it. On a page without, and under a class, id or role of a word that can name a
section of an article as well as something beside it, the wrapper's evidence decides
the remaining slots: a slot goes if it is template (its block has the same text
on all pages of the wrapper while they differ elsewhere) or a link list (its blocks hold no
words but links, and more than one link a page). A link in a sentence belongs to
the sentence. A form that holds the page's article, main heading or most of its text
frames the page and counts as a plain block.

Pages are folded and their slots counted where they are read; only distinct
streams and slots (with counts) are shuffled, never pages. The streams of a host are
aligned in groups of about ``group``, the groups' wrappers again, and so on, so that
a host with a third of all pages is shared out, and no task aligns more than a
group. What the wrappers keep is broadcast while it stays under ``broadcast_bytes``,
else pages join it by host and stream.

Null and empty pages have no text; a null url is a host of its own (empty name).
Repeated rows are read alike (they count as pages of the host, but equal pages alone
show no template); other columns are ignored; unclosed tags, comments and scripts
end where HTML ends them or with the page. An empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, hash64, prepare, quoted, shuffled, slices, trimmed

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    # a self-closed svg, iframe or object is an empty element; a slash that ends an unquoted value closes nothing
    r"|<(?:(script|style|noscript|template|textarea|title)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*|(iframe|svg|object)(?=[\s/>])(?:[^>\"'=/]|/(?!>)|=\s*+[^\s\"'>]*+|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?:\1|\2)\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\Z")  # a slash that ends a value, not a tag
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

# Fixed values of HTML: elements without content, elements that start a block, and
# those whose start closes an open paragraph or item.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements, and words of classes, ids and roles, that never hold main text.
ASIDE = set("head nav header footer aside form button select label input dialog menu".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search comment comments discussion disqus respond reply replies related recommended share sharing social "
    "widget pager pagination toolbar complementary contentinfo skip".split()
)
MAIN = {"article", "main"}
# Inside an article: words of its own head, which is main text, and words that also
# name sections of it, so that the wrapper decides (template and link lists go).
HEAD_WORDS = {"header", "masthead"}
DOUBTFUL_WORDS = set("alert discussion menu navigation notice notices promotion related search social".split())


# Whole class names that make even an article or main element something beside the text.
ASIDE_ARTICLES = set("ad ads advert advertisement comment comments promo related reply sidebar sponsored teaser widget".split())
_FORM = re.compile(r"<form(?=[\s/>])(.*?)(?:</form\s*>|\Z)", re.S | re.I)
_FRAME = re.compile(r"<(?:article|main|h1)(?=[\s/>])|\brole\s*=\s*[\"']?main\b", re.I)
_HIDDEN = re.compile(r"<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<[^>]*>|\s+", re.S | re.I)


def _page_forms(page: str) -> set[int]:
    """Where the forms start that frame the page instead of being a part of it."""
    if "<form" not in page and "<FORM" not in page and not _FORM.search(page):
        return set()
    whole = len(_HIDDEN.sub("", page))
    return {m.start() for m in _FORM.finditer(page) if _FRAME.search(m.group(1)) or 2 * len(_HIDDEN.sub("", m.group(1))) > whole}


class Slot:
    __slots__ = ("aside", "doubt", "main", "name", "path")

    def __init__(self, name: str, path: str, aside: bool, main: bool, doubt: bool = False):
        self.name, self.path, self.aside, self.main, self.doubt = name, path, aside, main, doubt


def read(page: str):
    """Tags and texts of a page in order: ("tag", token, breaks block) and
    ("text", raw text, innermost element, number of the link around it or 0)."""
    frames = _page_forms(page)
    root = Slot("", "", False, False)
    stack = [root]
    links = n_links = 0
    for m in _TOKEN.finditer(page):
        raw, name = m.group(), m.group(4)
        if name is None:
            if raw[0] != "<" or raw == "<":
                yield "text", raw, stack[-1], n_links if links > 0 else 0
            continue
        name = name.lower().replace("(", ".").replace(")", ".")
        if m.group(3):
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                ended = stack[depth:]
                del stack[depth:]
                for gone in reversed(ended):  # what was left open inside ends too
                    links -= gone.name == "a"
                    yield "tag", "/" + gone.name, gone.name in BLOCK
            elif name in ("p", "br"):
                yield "tag", "", name == "p"
            continue
        marks = [(k.lower(), v.strip("\"'").lower()) for k, v in _ATTRIBUTE.findall(m.group(5))] if "=" in m.group(5) else []
        if name in VOID or m.group(5).endswith("/") and not _UNQUOTED.search(m.group(5)):
            if name == "br":
                yield "text", " ", stack[-1], 0
            elif name in BLOCK:
                yield "tag", name, True
            continue
        closed = CLOSES.get(name, set()) | ({"p"} if name in BLOCK else set())
        if closed:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closed:
                    ended = stack[i:]
                    del stack[i:]
                    for gone in reversed(ended):
                        links -= gone.name == "a"
                        yield "tag", "/" + gone.name, gone.name in BLOCK
                    break
                if stack[i].name in BLOCK and stack[i].name not in ("p",):
                    break
        above = stack[-1]
        words = {w for k, v in marks for w in re.split(r"[^a-z]+", v)}
        own_main = name in MAIN or any(k == "role" and v == "main" for k, v in marks)
        if own_main:  # an article about search or notices is still one; only a whole name tells
            words = {w for k, v in marks if k == "class" for w in v.split()} & ASIDE_ARTICLES
        else:
            words = words & ASIDE_WORDS if name not in ("html", "body") else set()
        doubt = above.main and not own_main and bool(words & DOUBTFUL_WORDS)
        element = name in ASIDE and not (name == "header" and above.main) and not (name == "form" and m.start() in frames)
        out = element or bool(words - (HEAD_WORDS | DOUBTFUL_WORDS) if above.main and not own_main else words)
        sign = name + "".join(("#" if k == "id" else ".") + re.sub(r"[\s()]+", ".", re.sub(r"\d+", "0", v)) for k, v in marks)
        stack.append(Slot(name, f"{above.path}/{sign}", above.aside or out, above.main or own_main, above.doubt or doubt))
        if name == "a":
            links, n_links = links + 1, n_links + 1
        yield "tag", sign, name in BLOCK


def fold_slots(tokens: list[str], longest: int = 8) -> tuple[list[str], list[list[list[int]]]]:
    """A stream with each neighbouring repetition as one repeated group, and for
    each of its elements the places in ``tokens`` of each text slot inside."""
    out: list[str] = []
    slots: list[list[list[int]]] = []
    for i, token in enumerate(tokens):
        out.append(token)
        slots.append([[i]] if token[0] == "#" else [])
        for k in range(1, min(longest, len(out) - 1) + 1):
            group = f"({' '.join(out[-k:])})+"
            if out[-k - 1] == group:
                again = [x for own in slots[-k:] for x in own]
                slots[-k - 1] = [x + y for x, y in zip(slots[-k - 1], again, strict=True)]
                del out[-k:], slots[-k:]
                break
            if len(out) >= 2 * k and out[-k:] == out[-2 * k : -k]:
                once, again = ([x for own in part for x in own] for part in (slots[-2 * k : -k], slots[-k:]))
                out[-2 * k :] = [group]
                slots[-2 * k :] = [[x + y for x, y in zip(once, again, strict=True)]]
                break
    return out, slots


def fold(tokens: list[str], longest: int = 8) -> list[str]:
    """A stream with each neighbouring repetition as one repeated group."""
    return fold_slots(tokens, longest)[0]


def _bare(token: str) -> str:
    return token[1:-2] if token[:1] == "(" and token[-2:] == ")?" else token


def align_places(wrapper: list[str], stream: list[str]) -> tuple[list[str], list[int], list[int]]:
    """The union-free wrapper that covers both, and the places in it of the
    elements of the wrapper so far and of the stream."""
    out: list[str] = []
    old, new = [0] * len(wrapper), [0] * len(stream)
    plain, other = [_bare(t) for t in wrapper], [_bare(t) for t in stream]
    for kind, a, b, c, d in difflib.SequenceMatcher(None, plain, other, autojunk=False).get_opcodes():
        old[a:b] = range(len(out), len(out) + b - a)
        if kind == "equal":  # optional if either is
            new[c:d] = old[a:b]
            out += [x if x != t else y for x, y, t in zip(wrapper[a:b], stream[c:d], plain[a:b], strict=True)]
            continue
        new[c:d] = range(len(out) + b - a, len(out) + b - a + d - c)
        out += [f"({t})?" for t in plain[a:b]]
        out += [f"({t})?" for t in other[c:d]]
    return out, old, new


def align(wrapper: list[str], stream: list[str]) -> list[str]:
    """The union-free wrapper that covers both: what one side lacks is optional."""
    return align_places(wrapper, stream)[0]


def _parse(page: str):
    """A page as tokens and events, and whether an article or main element has text.
    A text slot's token names its tag path. Events are None where a block ends, else
    (place of the slot's token or -1 for blank text, text, element, number of its link)."""
    tokens: list[str] = []
    events: list[tuple[int, str, Slot, int] | None] = []
    framed = False
    for kind, value, where, *link in read(page):
        if kind == "tag":
            if value:
                tokens.append(value)
            if where:
                events.append(None)
            continue
        place = -1
        if value.strip():
            if not tokens or tokens[-1][0] != "#":
                tokens.append(_path_token(where.path))
            place = len(tokens) - 1
            framed = framed or where.main and not where.aside
        events.append((place, value, where, link[0]))
    return tokens, events, framed


@lru_cache(100_000)
def _path_token(path: str) -> str:
    return f"#{hash64(path.encode()):016x}"


def _stream(tokens: list[str]) -> tuple[str, str, dict[int, int]]:
    """A page's folded stream, its name, and each text slot's number in it by place."""
    out, slots = fold_slots(tokens)
    key = " ".join(out)
    numbered = enumerate(places for own in slots for places in own)
    return key, _name(key), {at: k for k, places in numbered for at in places}


def _name(stream: str) -> str:
    return xxhash.xxh3_128_hexdigest(stream.encode())


_SLOT = ["n", "plain", "links", "low", "high"]
_OBSERVED = "host string, framed boolean, stream string, slot int, key string, kept boolean, asked boolean, n long, plain long, links long, low long, high long"


def _slots(events: list, number: dict[int, int], framed: bool) -> dict[int, list]:
    """What a page tells of each slot: kept, asked; and if it is asked, blocks with words
    outside links, links of blocks without, texts of its blocks (a sentence with a link
    in it is one)."""
    seen: dict[int, list] = {}
    block: list[tuple[int, str, Slot, int]] = []
    for event in [*events, None]:
        if event is not None:
            block.append(event)
            continue
        told = None
        for at, _, where, link in block:
            if at >= 0:
                own = seen.get(number[at])
                if own is None:
                    own = seen[number[at]] = [kept(where, framed), asked(where, framed), 0, set(), []]
                if own[1]:
                    told = told or (any(not x and any(map(str.isalnum, text)) for _, text, _, x in block), "".join(text for _, text, _, _ in block).strip())
                    own[2] += told[0]
                    if not told[0] and link:
                        own[3].add(link)
                    own[4].append(told[1])
        block = []
    return seen


@trimmed
def _observe(batches):
    """Distinct folded streams (slot -1; low and high are of hashes of what pages could keep)
    and slots of the pages of a task, by host."""
    streams: dict[tuple, list] = {}
    slots: dict[tuple, list] = {}

    def rows():
        keys = [(h, f, name, -1, key, None, None, n, 0, 0, low, high) for (h, f, name), (key, n, low, high) in streams.items()] + [(h, f, name, k, "", *v) for (h, f, name, k), v in slots.items()]
        types = [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys, strict=True), types, strict=True)], names=["host", "framed", "stream", "slot", "key", "kept", "asked", *_SLOT])

    for batch in batches:
        for some in slices(batch, "html"):
            for host, page in zip(some.column("host").to_pylist(), some.column("html").to_pylist(), strict=True):
                tokens, events, framed = _parse(page or "")
                key, name, number = _stream(tokens)
                h = hash64("\n".join(e[1] for e in events if e and e[0] >= 0 and kept(e[2], framed)).encode()) >> 1
                own = streams.setdefault((host, framed, name), [key, 0, h, h])
                own[1] += 1
                own[2], own[3] = min(own[2], h), max(own[3], h)
                for k, (is_kept, is_asked, plain, links, found) in _slots(events, number, framed).items():
                    h = hash64("\n".join(found).encode()) >> 1 if is_asked else 0
                    own = slots.setdefault((host, framed, name, k), [is_kept, is_asked, 0, 0, 0, h, h])
                    own[2] += 1
                    own[3] += plain
                    own[4] += len(links)
                    own[5], own[6] = min(own[5], h), max(own[6], h)
                if len(streams) + len(slots) > 50_000:
                    yield rows()
                    streams.clear()
                    slots.clear()
    if streams or slots:
        yield rows()


def asked(where: Slot, framed: bool) -> bool:
    """Whether a text is main text only if its wrapper doesn't drop its slot."""
    return kept(where, framed) and (where.doubt or not framed)


def kept(where: Slot, framed: bool) -> bool:
    """Whether a text is main text if its wrapper doesn't drop its slot."""
    return not where.aside and (where.main or not framed)


def _align(table: pa.Table) -> pa.Table:
    """applyInArrow: one wrapper over a group of streams or wrappers (``node``) of a
    host, and for each of them the places of its elements in it."""
    rows = sorted(table.select(["host", "framed", "node", "key", "n", "into"]).to_pylist(), key=lambda r: (-r["n"], r["node"]))
    wrapper: list[str] = []
    marks: list[int] = []  # of each element of the wrapper, a number that outlasts later alignments
    own: list[list[int]] = []
    for i, r in enumerate(rows):
        stream = _units(r["key"]) if r["key"] else []
        wrapper, old, new = align_places(wrapper, stream) if i else (stream, [], list(range(len(stream))))
        now = [-1] * len(wrapper)
        for at, mark in zip(old, marks, strict=True):
            now[at] = mark
        fresh = len(marks)
        for at in new:
            if now[at] < 0:
                now[at], fresh = fresh, fresh + 1
        marks = now
        own.append([marks[at] for at in new])
    place = {mark: at for at, mark in enumerate(marks)}
    first = rows[0]
    key, n = " ".join(wrapper), sum(r["n"] for r in rows)
    return pa.table({
        "host": [first["host"]] * len(rows), "framed": [first["framed"]] * len(rows), "child": [r["node"] for r in rows], "places": pa.array([[place[m] for m in x] for x in own], pa.list_(pa.int32())),
        "node": [first["into"]] * len(rows), "key": [key, *[None] * (len(rows) - 1)], "n": pa.array([n] * len(rows), pa.int64()),
    })


def _slot_units(key: str) -> list[tuple[int, int]]:
    """(element, number inside it) of each text slot of a folded stream."""
    units = _units(key) if key else []
    return [(u, j) for u, unit in enumerate(units) for j in range(sum(t.lstrip("(")[:1] == "#" for t in unit.split(" ")))]


def _units(stream: str) -> list[str]:
    """The tokens and groups of a folded stream."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(stream + " "):
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == " " and depth == 0:
            out.append(stream[start:i])
            start = i + 1
    return out


def main_text(page: str, keeps) -> str:
    """Main text of a page, one line for each block; ``keeps`` gives the slots that
    the wrapper of a stream keeps, by the stream's name."""
    tokens, events, framed = _parse(page)
    _, name, number = _stream(tokens)
    kept_slots = set(keeps(name) or ())
    held = {at for at, k in number.items() if k in kept_slots}
    blocks, now = [], []
    for event in events:
        if event is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif event[0] in held or event[0] < 0 and kept(event[2], framed):
            now.append(event[1])
    blocks.append("".join(now))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


@trimmed
def _named(batches):
    """Pages with the name of their stream."""
    for batch in batches:
        for some in slices(batch, "html"):
            names = [_stream(_parse(page or "")[0])[1] for page in some.column("html").to_pylist()]
            yield some.append_column("stream", pa.array(names, pa.string()))


def _extract(shared):
    """shared: (host, stream) -> slots that stay; or None, and each row brings its own."""

    @trimmed
    def run(batches):
        known: dict[tuple[str, str], list[int]] = shared.value if shared else {}
        for batch in batches:
            for part in slices(batch, "html"):
                if shared:
                    own = ((lambda name, h=h: known.get((h, name))) for h in part.column("host").to_pylist())
                else:
                    own = ((lambda name, m=m: m) for m in part.column("slots").to_pylist())
                text = [main_text(p or "", m) for p, m in zip(part.column("html").to_pylist(), own, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(quoted(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _wrap(observed: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """The wrapper of each host's pages with or without an article, by aligning groups of
    streams, then groups of their wrappers, until one is left: ``host, framed, node,
    key, n``; and the steps that lead there: ``host, framed, child, places, node``."""
    at = ["host", "framed"]
    nodes = Staged(observed.where("slot < 0").groupBy(*at, F.col("stream").alias("node"), "key").agg(F.sum("n").alias("n")), "wrapper-streams").df
    steps = []
    while True:
        groups = Staged(nodes.groupBy(*at).agg(F.count("*").alias("nodes")).withColumn("groups", F.ceil(F.col("nodes") / group)), "wrapper-groups").df
        into = F.concat(F.lit(f"{len(steps)}."), F.pmod(F.xxhash64("node", F.lit(len(steps))), "groups").cast("string"))
        dealt = nodes.join(shuffled(groups), at).withColumn("into", into)
        aligned = dealt.select(*at, "node", "key", "n", "into").groupBy(*at, "into").applyInArrow(_align, "host string, framed boolean, child string, places array<int>, node string, key string, n long")
        step = Staged(aligned, "wrapper-step").df
        steps.append(step.select(*at, "child", "places", "node"))
        nodes = step.where("key is not null").select(*at, "node", "key", "n")
        if (groups.agg(F.max("groups")).first()[0] or 1) <= 1:
            return nodes, steps


def _observed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    src = pages.select(_host(url_col).alias("host"), quoted(html_col).cast("string").alias("html"))
    found = src.mapInArrow(_observe, _OBSERVED)
    sums = [F.sum(c).alias(c) for c in ("n", "plain", "links")]
    one = [F.first(c).alias(c) for c in ("kept", "asked")]  # a slot's path fixes both
    return Staged(found.groupBy("host", "framed", "stream", "slot", "key").agg(*one, *sums, F.min("low").alias("low"), F.max("high").alias("high")), "wrapper-slots").df


def _slot_places(batches):
    """Element and number inside it of each slot of each stream."""
    for batch in batches:
        own = [_slot_units(key) for key in batch.column("key").to_pylist()]
        at = pa.array([i for i, x in enumerate(own) for _ in x], pa.int64())
        columns = [[k for x in own for k in range(len(x))], [u for x in own for u, _ in x], [j for x in own for _, j in x]]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("host", "framed", "stream")), *(pa.array(c, pa.int32()) for c in columns)], names=["host", "framed", "stream", "slot", "unit", "inner"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", group: int = 64) -> DataFrame:
    """``host, framed, n_pages, wrapper``: the wrapper of a host's pages with or without
    text in an article, as a regular expression over tags and text slots (#)."""
    prepare(pages.sparkSession)
    nodes, _ = _wrap(_observed(pages, url_col, html_col), group)
    return nodes.select("host", "framed", F.col("n").alias("n_pages"), F.regexp_replace("key", "#[0-9a-f]{16}", "#").alias("wrapper"))


def kept_slots(pages: DataFrame, url_col: str = "url", html_col: str = "html", group: int = 64) -> DataFrame:
    """``host, stream, slots``: the text slots of each stream that its wrapper keeps."""
    prepare(pages.sparkSession)
    at = ["host", "framed"]
    observed = _observed(pages, url_col, html_col)
    nodes, steps = _wrap(observed, group)
    streams = observed.where("slot < 0").select(*at, "stream", "key")
    placed = streams.mapInArrow(_slot_places, "host string, framed boolean, stream string, slot int, unit int, inner int").withColumn("node", F.col("stream"))
    for step in steps:  # each slot's element in the wrapper that took its stream, then in the next
        up = step.select(*at, F.col("child").alias("node"), "places", F.col("node").alias("next"))
        placed = placed.join(shuffled(up), [*at, "node"]).select(*at, "stream", "slot", F.element_at("places", F.col("unit") + 1).alias("unit"), "inner", F.col("next").alias("node"))
    slots = observed.where("slot >= 0").drop("key").join(shuffled(placed.drop("node")), [*at, "stream", "slot"])
    slots = Staged(slots, "wrapper-placed").df
    by_place = slots.groupBy(*at, "unit", "inner").agg(*(F.sum(c).alias(c) for c in ("n", "plain", "links")), F.min("low").alias("low"), F.max("high").alias("high"))
    by_place = Staged(by_place, "wrapper-places").df  # a table of its own, so that a hot host's slots can be split in the join
    told = observed.where("slot < 0").groupBy(*at).agg((F.min("low") != F.max("high")).alias("differ"))  # adverts that change tell nothing
    judged = by_place.join(shuffled(nodes.select(*at, F.col("n").alias("pages"))), at).join(shuffled(told), at)
    template = (F.col("low") == F.col("high")) & (F.col("n") == F.col("pages")) & F.col("differ") & (F.col("pages") > 1)
    links = (F.col("plain") == 0) & (F.col("links") > F.col("n"))
    gone = Staged(judged.where(template | links).select(*at, "unit", "inner", F.lit(True).alias("gone")), "wrapper-gone").df
    verdict = slots.where("kept").join(shuffled(gone), [*at, "unit", "inner"], "left").where("not asked or gone is null")
    return verdict.groupBy("host", "stream").agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 64, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``id, url, text, n_chars`` of every page."""
    found = Staged(kept_slots(pages, url_col, html_col, group), "wrappers").df
    src = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), _host(url_col).alias("host"), quoted(html_col).cast("string").alias("html"))
    kind = src.schema["id"].dataType.simpleString()
    out = f"id {kind}, url string, text string, n_chars long"
    size = found.agg(F.sum(F.length("host") + 32 + 4 * F.size("slots"))).first()[0] or 0
    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({(r["host"], r["stream"]): r["slots"] for r in found.collect()})  # size checked
        return src.mapInArrow(_extract(shared), out)
    named = src.mapInArrow(_named, f"id {kind}, url string, host string, html string, stream string")
    return named.join(shuffled(found), ["host", "stream"], "left").select("id", "url", "html", "slots").mapInArrow(_extract(None), out)
