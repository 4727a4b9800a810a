"""Main text of web pages by deducing the templates of their hosts from equivalence classes of tokens.

Tags, qualified by the elements they lie in, and whole text nodes are tokens. Tokens that occur equally often on
every page of a host share an occurrence vector and form an equivalence class:

1. Vectors are summed up as hashes of (page, count), which tasks and shuffles add up in any order, so a host may
   hold any share of the pages. Tokens found once on every page are the root class; other classes of two or more
   tokens on at least half of the pages are nested in it. A token's rank is its mean place.
2. On each page a class counts if its tokens come in the order of their ranks and each repetition lies between two
   tokens of the root; root tokens out of order are passed over. What lies between tokens of these classes
   is a slot. Slots are summed up over the host: words, words in links, words in text nodes of the template.
3. The slots opened by the most telling element (article, then main, then a name such as content) hold the main
   text; without any, those of the container with most words that vary between pages, lists of links left out.
4. The blocks of text in these slots are put out. Menus, headers, footers, sidebars, notices, adverts, forms,
   comments and what is not text are known by their elements and by words in class, id and role, and go wherever
   they lie. A page with nothing in its host's slots, or alone on its host, is judged by rule 3 by itself.

Templates are as large as a page's own structure. They are sent to all tasks only if there are at most
``BROADCAST_TOKENS`` tokens in all; else only those of hosts with a thousandth of the pages or more are, and the other
pages meet theirs in a join.

Edge cases: missing html is empty and gives an empty text; missing or odd urls share the empty host; unclosed and
cut-off elements end where their parents end; scripts and styles may hold tags; repeated rows give equal rows;
equal texts may stand on many pages, in the main text they stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.session import checkpoint, discard

BROADCAST_TOKENS = 1_000_000
#: Sums are handed on when a task holds this many.
HELD = 200_000

# Elements by what the HTML standard says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: The elements that make up a path; text, headings and lists belong to the container they lie in.
CONTAINERS = frozenset("html head body main article section div nav aside header footer form table center details fieldset".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

# What is not main text, and what holds it, by element, role and words in class and id.
LEFT_OUT = frozenset("nav aside footer form script style noscript template head title button select textarea svg canvas dialog iframe object menu noembed noframes map".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer toolbar comment comments commentlist "
    "disqus respond reply replies share sharing social related recommended pagination pager login search widget widgets copyright".split()
)
HEADER_WORDS = frozenset("header masthead".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
ARTICLE, MAIN, NAMED = 3, 2, 1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


@dataclass
class Element:
    """An open element: what it says of the text inside it, and the path of containers down to it."""

    name: str
    path: int
    left_out: bool
    level: int
    link: bool


@dataclass
class Block:
    """A block of text: place among the page's tokens, path, level of the telling element, words, of them in links."""

    at: int
    path: int
    level: int
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    nodes: list[int] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@functools.lru_cache(maxsize=1 << 16)
def _hash(parent: int, label: str) -> int:
    """Signed hash of a label under a path; never 0, which marks the page itself."""
    return _signed(xxhash.xxh3_64_intdigest(f"{parent}/{label}")) or 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


@functools.lru_cache(maxsize=1 << 14)
def _tag(markup: str) -> tuple[str, bool, str, bool]:
    """(name, whether it ends an element, attributes, whether it is inline) of a tag; no name for comments and the like."""
    m = _TOKEN.fullmatch(markup)
    name = (m[2] or m[5] or "").lower()
    return name, bool(m[1] or m[4]), m[3] or m[6] or "", name in INLINE


@functools.lru_cache(maxsize=1 << 14)
def judge(name: str, attributes: str) -> tuple[str, bool, bool, int]:
    """(label, left out, header, level) of an element by its name and attributes."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    classes = [c for c in found.get("class", "").split() if not c.startswith(("with-", "has-", "no-", "without-"))]
    words = set(_WORDS.findall(" ".join([*classes, found.get("id", "")])))
    roles = set(found.get("role", "").split())
    label = re.sub(r"\d+", "", f"{name}.{found.get('class', '')}#{found.get('id', '')}") if found else name
    if name == "article" or "article" in roles or found.get("itemprop") == "articlebody":
        level = ARTICLE
    elif name == "main" or "main" in roles:
        level = MAIN
    else:
        level = NAMED if words & CONTENT_WORDS and name not in INLINE else 0
    whole = name in ("html", "body", "article", "main")
    left_out = not whole and (name in LEFT_OUT or bool(roles & LEFT_OUT_ROLES) or bool(words & LEFT_OUT_WORDS))
    return label, left_out, not whole and (name == "header" or bool(words & HEADER_WORDS)), level


def read_page(page: str) -> tuple[list[int], list[Block]]:
    """The tokens of a page in order, and its blocks of text that may belong to the main text."""
    tokens: list[int] = []
    blocks: list[Block] = []
    stack = [Element("", 0, False, 0, False)]
    block: Block | None = None
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal block
        top = stack[-1]
        if raw.isspace():
            if block is not None:
                block.parts.append(" ")
            return
        own = html.unescape(raw) if "&" in raw else raw
        squeezed = " ".join(own.split())
        if not squeezed:
            return
        node = _signed(xxhash.xxh3_64_intdigest(squeezed.encode("utf-8", "replace"), top.path & 0xFFFFFFFFFFFFFFFF)) or 1
        tokens.append(node)
        if top.left_out:
            return
        if block is None:
            block = Block(len(tokens) - 1, top.path, top.level)
            blocks.append(block)
        block.parts.append(own)
        block.nodes.append(node)
        if top.link:
            block.link_chars += len(squeezed)

    def close(names: set[str], bounds: set[str]) -> None:
        """End the innermost open element of these names, unless one of the bounds lies inside."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in bounds:
                return

    while at < end:
        for m in _TOKEN.finditer(page, at):
            start = m.start()
            if start > at:
                text(page[at:start])
            at = m.end()
            name, ending, attributes, inline = _tag(m[0])
            if not name:
                continue
            if not inline:
                block = None
            elif name == "br" and block is not None:
                block.parts.append(" ")
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                tokens.append(_hash(stack[-1].path, f"/{name}"))
                continue
            if name in CLOSED_BY:
                close(*CLOSED_BY[name])
            elif not inline:
                close({"p"}, {"table", "button", "object"})
            label, left_out, header, level = judge(name, attributes)
            top = stack[-1]
            tokens.append(_hash(top.path, label))
            if not (name in VOID or attributes.endswith("/")):
                level = max(level, top.level)
                left_out = top.left_out or left_out or header and level < ARTICLE
                path = _hash(top.path, f">{label}") if name in CONTAINERS else top.path
                stack.append(Element(name, path, left_out, level, top.link or name == "a"))
            if name in RAW:  # what it holds is not markup: go on at its end
                stop = _RAW_END[name].search(page, at)
                at = stop.start() if stop else end
                break
        else:
            if at < end:
                text(page[at:])
            break
    return tokens, blocks


def host_of(url: Column) -> Column:
    """The host that a url names, without a leading www; empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www[.]", ""), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, low, high, pages, times, places): the occurrence vector of every token of a host as sums.

    Token 0 stands for the page, so its vector is that of all tokens found once on every page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}

        def handed_on() -> pa.RecordBatch:
            columns = list(zip(*((*k, *v) for k, v in sums.items()))) or [[]] * 7
            kinds = [pa.string(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "token", "low", "high", "pages", "times", "places"])

        for batch in batches:
            for url, host, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = value.as_py() or ""
                tokens = read_page(page)[0]
                own = xxhash.xxh3_64_intdigest(f"{url}\n{page}".encode("utf-8", "replace"))
                first: dict[int, int] = {}
                for k, t in enumerate(tokens):
                    first.setdefault(t, k)
                marks: dict[int, int] = {}
                for t, n in [(0, 1), *Counter(tokens).items()]:
                    mark = marks.get(n)
                    if mark is None:
                        mark = marks[n] = xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), own)
                    for k, v in enumerate((mark & 0xFFFFFFFF, mark >> 32, 1, n, first.get(t, 0))):
                        sums.setdefault((host, t), [0] * 5)[k] += v
                if len(sums) > HELD:
                    yield handed_on()
                    sums.clear()
        yield handed_on()

    made = pages.select("url", host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, token long, low long, high long, pages long, times long, places long")
    return made.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("low", "high", "pages", "times", "places")])


def templates(pages: DataFrame) -> DataFrame:
    """(host, host_pages, tokens): per host with two pages or more, its classes as (rank, token, class) by rank; class 0 is the root."""
    found = checkpoint(occurrences(pages).where("pages > 1"))
    root = found.where("token = 0").select("host", F.col("low").alias("root_low"), F.col("high").alias("root_high"), F.col("pages").alias("host_pages"))
    own = found.where("token <> 0").join(root, "host").where("2 * pages >= host_pages")
    named = own.withColumn("class", F.when((F.col("low") == F.col("root_low")) & (F.col("high") == F.col("root_high")), F.lit(0)).otherwise(F.xxhash64("low", "high", "times")))
    sizes = named.groupBy("host", "class").agg(F.count("*").alias("size"))
    valid = named.join(sizes, ["host", "class"]).where("class = 0 or size > 1")
    tokens = F.sort_array(F.collect_list(F.struct((F.col("places") / F.col("pages")).alias("rank"), "token", "class")))
    made = checkpoint(root.join(valid.groupBy("host").agg(tokens.alias("tokens")), "host", "left").select("host", "host_pages", "tokens"))
    discard(found)
    return made


class Template:
    """A host's classes: the order of their tokens."""

    def __init__(self, tokens: list[dict] | None):
        self.rank: dict[int, int] = {}
        self.kind: dict[int, int] = {}
        self.members: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(tokens or []):
            self.rank[t["token"]], self.kind[t["token"]] = k, t["class"]
            self.members[t["class"]].append(t["token"])

    def slots(self, tokens: list[int], blocks: list[Block]) -> list[int]:
        """The slot of each block: the last token before it of a class that is valid on this page, and the path."""
        kinds = self.kind
        known = [(k, t) for k, t in enumerate(tokens) if t in kinds]
        roots = _rising([(k, self.rank[t]) for k, t in known if kinds[t] == 0])
        marked = {k: tokens[k] for k in roots}
        nested: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in known:
            if kinds[t]:
                nested[kinds[t]].append((k, t))
        for kind, found in nested.items():
            order = self.members[kind]
            steps = range(0, len(found), len(order))
            whole = len(found) % len(order) == 0 and all([t for _, t in found[a : a + len(order)]] == order for a in steps)
            if whole and all(bisect_left(roots, found[a][0]) == bisect_left(roots, found[a + len(order) - 1][0]) for a in steps):
                marked.update(found)
        places = sorted(marked)
        slots = []
        for b in blocks:
            left = bisect_left(places, b.at)
            slots.append(_slot(marked[places[left - 1]] if left else 0, b.path))
        return slots

    def fixed(self, block: Block) -> bool:
        """Whether all of a block's text nodes belong to the template."""
        return all(node in self.rank for node in block.nodes)


def _slot(token: int, path: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(token.to_bytes(8, "little", signed=True), path & 0xFFFFFFFFFFFFFFFF))


def _rising(pairs: list[tuple[int, int]]) -> list[int]:
    """Places of a longest run of (place, rank) whose ranks rise."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, rank) in enumerate(pairs):
        j = bisect_left(tops, rank)
        tops[j : j + 1], at[j : j + 1] = [rank], [k]
        before.append(at[j - 1] if j else -1)
    found, k = [], at[-1] if at else -1
    while k >= 0:
        found.append(pairs[k][0])
        k = before[k]
    return found[::-1]


def _with_templates(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages with the columns of their host, which is null for hosts of one page."""
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    tokens, total = hosts.agg(F.sum(F.size("tokens")), F.sum("host_pages")).first()
    if (tokens or 0) <= BROADCAST_TOKENS:
        return keyed.join(F.broadcast(hosts), "host", "left")
    often = hosts.where(F.col("host_pages") * 1000 >= total)  # at most a thousand hosts
    first = keyed.join(F.broadcast(often), "host", "left")
    rest = first.where("host_pages is null").select(*keyed.columns).join(hosts.where(F.col("host_pages") * 1000 < total), "host", "left")
    return first.where("host_pages is not null").unionByName(rest)


def slot_sums(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, slot, path, level, words, link_words, varying): what all pages of a host have in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, value, tokens in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                template = _template(known, host, tokens)
                sequence, blocks = read_page(value.as_py() or "")
                for slot, b in zip(template.slots(sequence, blocks), blocks):
                    words = len(b.text.split())
                    total = sums.setdefault((host, slot, b.path, b.level), [0, 0, 0])
                    links = 2 * b.link_chars > len(b.text)
                    total[0] += words
                    total[1] += words * links
                    total[2] += words * (not links and not template.fixed(b))
            columns = list(zip(*((*k, *v) for k, v in sums.items()))) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "slot", "path", "level", "words", "link_words", "varying"])

    shared = _with_templates(pages, hosts).where("host_pages is not null")
    made = shared.select("host", "html", "tokens").mapInArrow(run, "host string, slot long, path long, level int, words long, link_words long, varying long")
    return made.groupBy("host", "slot", "path", "level").agg(*[F.sum(c).alias(c) for c in ("words", "link_words", "varying")])


def _template(known: dict[str, Template], host: str, tokens: pa.Scalar) -> Template:
    if host not in known:
        if len(known) >= 1024:
            known.clear()
        known[host] = Template(tokens.as_py())
    return known[host]


def main_slots(sums: DataFrame) -> DataFrame:
    """(host, main): the slots of each host that hold the main text."""
    by_path = sums.groupBy("host", "path").agg(F.max("level").alias("level"), F.sum("varying").alias("varying"))
    best = by_path.groupBy("host").agg(F.max("level").alias("best_level"), F.max(F.struct("varying", F.col("path").alias("most"))).alias("best"))
    named = (F.col("best_level") > 0) & (F.col("level") == F.col("best_level"))
    largest = (F.col("best_level") == 0) & (F.col("path") == F.col("best.most")) & (2 * F.col("link_words") <= F.col("words"))
    return sums.join(best, "host").where(named | largest).groupBy("host").agg(F.collect_set("slot").alias("main"))


def by_itself(blocks: list[Block]) -> list[Block]:
    """The main text of a page that has no template to go by."""
    level = max((b.level for b in blocks), default=0)
    if level:
        return [b for b in blocks if b.level == level]
    plain = [b for b in blocks if 2 * b.link_chars <= len(b.text)]
    sizes: Counter[int] = Counter()
    for b in plain:
        sizes[b.path] += len(b.text)
    most = max(sizes, key=lambda p: (sizes[p], p), default=None)
    return [b for b in plain if b.path == most]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page; blocks of text are joined by an empty line."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosts = templates(own)
    sums = checkpoint(slot_sums(own, hosts))
    told = checkpoint(hosts.join(main_slots(sums), "host", "left"))
    discard(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        slots: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for host, value, tokens, main in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5)):
                template = _template(known, host, tokens)
                if host not in slots:
                    if len(slots) >= 1024:
                        slots.clear()
                    slots[host] = frozenset(main.as_py() or ())
                sequence, blocks = read_page(value.as_py() or "")
                chosen = [b for s, b in zip(template.slots(sequence, blocks), blocks) if s in slots[host]] if slots[host] else []
                texts.append("\n\n".join(b.text for b in chosen or by_itself(blocks)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return _with_templates(own, told).select("page_id", "url", "host", "html", "tokens", "main").mapInArrow(run, "page_id long, url string, text string")
