"""HTML extraction by union-free regular-expression wrappers, inferred for each host from its pages' token streams."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare
from .urlfilter import split_url

#: Expressions that one task aligns; hosts with more merge theirs in rounds.
GROUP = 256
#: Most wrappers (one a host) that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 50_000
#: Longest group of tokens that is looked for as a repetition.
PERIOD = 12

# fixed sets of element names, as HTML defines them
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img picture source map area br".split())
IMPLIED = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption rp rt html body".split())  # end tags may be left out
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form head title noscript template svg iframe button select textarea dialog menu object canvas audio video math".split())
#: Words in class, id or role that mark an element as something other than the article.
MARKS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|comments?|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|login|signup|search|widget|complementary|contentinfo|alert)(?:$|[\s_-])"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S | re.I,
)
_MARKED = re.compile(r"""(?is)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")

#: Strings stay template where so large a share of a host's different pages has them, and so many of these.
SHARE, LEAST = 0.75, 4
#: Distinct strings that a task gathers before it passes them on.
FLUSH_STRINGS = 100_000

SLOT, STRING = "#", "="


def step(token: str, held: list[str]) -> None:
    """What is open after a tag."""
    if token[0] == "/":
        name = token[1:]
        at = next((i for i in range(len(held) - 1, -1, -1) if held[i].rstrip("!") == name), None)
        if at is not None:
            del held[at:]
    elif token.rstrip("!") not in IMPLIED and token != "hr":
        held.append(token)


def is_text(node: str | list) -> bool:
    return isinstance(node, str) and node[0] in (SLOT, STRING)


def string_hash(text: str) -> int:
    """Of a text as a signed number."""
    n = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def stream(page: str | None, known: frozenset[int] = frozenset()) -> tuple[list[str], list[str]]:
    """A page's tokens, and the text of each text token among them.

    Tokens are block tags (`name`, `/name`, with `!` after the name if its attributes mark it as no part of an article) and texts:
    strings (`=`, the element they are in, and their hash) if the host's pages are known to share them, else slots
    (`#` and the element). Inline tags, comments, scripts and styles vanish; a text has its references decoded and its white space
    as one space.
    """
    tokens: list[str] = []
    texts: list[str] = []
    parts: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            inside = held[-1] if held else ""
            hashed = string_hash(text) if known else 0
            tokens.append(f"{STRING}{inside}:{hashed}" if hashed in known else SLOT + inside)
            texts.append(text)

    def add(token: str) -> None:
        tokens.append(token)
        step(token, held)

    for m in _TOKEN.finditer(page or ""):
        raw = m.group()
        name = m.group(3) or m.group(6)
        if name is None:
            if raw[0] != "<" or raw == "<":
                parts.append(html.unescape(raw) if "&" in raw else raw)
            elif m.group(1):
                parts.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        end = m.group(2) or m.group(5)
        close()
        if end:
            if name not in IMPLIED and name not in VOID:
                add("/" + name)
            continue
        attributes = m.group(4) or m.group(7) or ""
        marked = "=" in attributes and name not in ("html", "body", "article", "main") and any(MARKS.search(" ".join(filter(None, x))) for x in _MARKED.findall(attributes))
        if name in ("article", "main") and "=" in attributes:  # readers' comments are often articles of their own
            marked = any(re.search(r"(?i)comment", " ".join(x)) for x in _MARKED.findall(attributes))
        if name not in VOID or name == "hr":
            add(name + "!" if marked else name)
    close()
    return tokens, texts


# --- union-free expressions: a token is a string, ["+", [...]] a repeated group, ["?", [...]] an optional one


def fold(nodes: list) -> list:
    """Squares become repeated groups: of two or more equal groups in a row one stays, marked as repeated."""
    changed = True
    while changed:
        changed = False
        for period in range(1, PERIOD + 1):
            out, i = [], 0
            while i < len(nodes):
                group = nodes[i : i + period]
                j = i + period
                while len(group) == period and nodes[j : j + period] == group:
                    j += period
                if j > i + period and not all(map(is_text, group)):
                    out.append(["+", group[0][1] if period == 1 and group[0][0] == "+" else group])
                    i, changed = j, True
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    return absorb(nodes, [n for n in nodes if not isinstance(n, str)])


def absorb(nodes: list, groups: list) -> list:
    """Plain occurrences of what a group holds become the group; equal groups in a row become one."""
    for group in groups:
        inner, out, i = group[1], [], 0
        if all(map(is_text, inner)):
            continue
        while i < len(nodes):
            if nodes[i] == group or nodes[i : i + len(inner)] == inner:
                step = 1 if nodes[i] == group else len(inner)
                if not (out and out[-1] == group and group[0] == "+"):
                    out.append(group)
                i += step
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(left: list, right: list) -> list:
    """The expression of both: what only one has becomes optional, and repetitions found in one hold for the other.

    Strings that both have stay; where strings or slots of one element stand against each other, the mismatch is a slot.
    """
    left, right = absorb(left, [n for n in right if not isinstance(n, str)]), absorb(right, [n for n in left if not isinstance(n, str)])
    if left == right:
        return left
    keys = [[json.dumps(n) for n in x] for x in (left, right)]
    out: list = []
    for kind, a, b, c, d in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if kind == "equal":
            out += left[a:b]
            continue
        parts = [left[a:b], right[c:d]]
        inside = [{n[1:].partition(":")[0] for n in part} for part in parts if part and all(map(is_text, part))]
        if len(inside) == 2 and inside[0] == inside[1]:
            out += [SLOT + x for x in sorted(inside[0])]
            continue
        for part in parts:
            if not part:
                continue
            if all(isinstance(n, str) and n[0] == SLOT or not isinstance(n, str) and n[0] == "?" for n in part):
                out += part  # slots may be empty and options absent as they are
            else:
                out.append(["?", [x for n in part for x in (n[1] if not isinstance(n, str) and n[0] == "?" else [n])]])
    return out


def infer(expressions: list[str]) -> str:
    """The wrapper of several pages' expressions (JSON), aligned one after the other, the simplest first."""
    whole: list = []
    for text in sorted(set(expressions), key=lambda x: (len(x), x)):
        nodes = json.loads(text)
        whole = align(whole, nodes) if whole else nodes
    return json.dumps(whole, separators=(",", ":"))


class Wrapper:
    """A host's wrapper. Its strings are template: no part of any page's article. A slot's role follows from the elements
    that the page has open there.

    The expression's alternatives open elements that a page closes but once, so it can't tell itself what is open after them.
    """

    ARTICLE, OTHER, OUTSIDE = 2, 1, 0

    def __init__(self, expression: str):
        self.nodes = json.loads(expression)
        self.strings: set[str] = set()
        waiting = [self.nodes]
        while waiting:
            for n in waiting.pop():
                if not isinstance(n, str):
                    waiting.append(n[1])
                elif n[0] == STRING:
                    self.strings.add(n)
        self.known = frozenset(int(x.rpartition(":")[2]) for x in self.strings)

    @classmethod
    def role(cls, held: list[str]) -> int:
        inside = False
        for token in held:
            name = token.rstrip("!")
            if token.endswith("!") or name in SKIPPED or (name == "header" and not inside):
                return cls.OUTSIDE
            inside = inside or name in ("article", "main")
        return cls.ARTICLE if inside else cls.OTHER

    def roles(self, tokens: list[str]) -> list[int]:
        """The role of each text of a page."""
        out: list[int] = []
        held: list[str] = []
        for token in tokens:
            if token in self.strings:
                out.append(self.OUTSIDE)
            elif is_text(token):
                out.append(self.role(held))
            else:
                step(token, held)
        return out


@lru_cache(maxsize=4096)
def _wrapper(expression: str) -> Wrapper:
    return Wrapper(expression)


#: The wrapper that knows nothing of a host.
NONE = Wrapper("[]")


def extract(page: str | None, expression: str | None) -> str:
    """The article's blocks by the wrapper, one line each; without an article, what is in no part that isn't one."""
    wrapper = _wrapper(expression or "[]")
    tokens, texts = stream(page, wrapper.known)
    roles = wrapper.roles(tokens)
    best = Wrapper.ARTICLE if Wrapper.ARTICLE in roles else Wrapper.OTHER
    return "\n".join(t for t, r in zip(texts, roles, strict=True) if r == best)


def host_of(url: Column) -> Column:
    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return pd.Series([split_url(u)[0] for u in urls], dtype=object)

    return run(url)


def shared_strings(pages: DataFrame) -> DataFrame:
    """host, strings: hashes of the strings that a host's pages share, for hosts that have any.

    Pages whose two longest texts are the same count as one, so that copies of an article don't make it a template. Only texts that would
    otherwise be taken for content are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, int, int]] = set()

        def told() -> pa.RecordBatch:
            rows = list(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["host", "string", "body"])

        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tokens, texts = stream(page)
                held = {t for t, r in zip(texts, NONE.roles(tokens), strict=True) if r}
                if held:
                    host, body = split_url(url)[0], string_hash("\n".join(sorted(held, key=lambda t: (-len(t), t))[:2]))
                    found.update((host, string_hash(t), body) for t in held)
                if len(found) > FLUSH_STRINGS:
                    yield told()
        yield told()

    rows = materialize(pages.select("url", "html").mapInArrow(run, "host string, string long, body long").distinct(), "html-strings")
    bodies = rows.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("bodies"))
    often = rows.groupBy("host", "string").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    held = often.join(bodies, "host").where(F.col("n") >= F.col("bodies") * SHARE)
    # a page holds no more of these than it has strings, and a host at most 1 / SHARE times as many as a page
    return materialize(held.groupBy("host").agg(F.collect_list("string").alias("strings")), "html-shared")


def expressions(pages: DataFrame) -> DataFrame:
    """host, expression: the distinct folded expressions of each host's pages. Tasks pass on each but once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("strings").to_pylist(), strict=True)
            found = Counter((host, _folded(tuple(stream(page, frozenset(known or ()))[0]))) for host, page, known in rows)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["host", "expression"])

    return pages.select("host", "html", "strings").mapInArrow(run, "host string, expression string").distinct()


@lru_cache(maxsize=16_384)
def _folded(tokens: tuple[str, ...]) -> str:
    return json.dumps(fold(list(tokens)), separators=(",", ":"))


def _with(pages: DataFrame, told: DataFrame) -> DataFrame:
    """Pages (host and others) with what is told of their hosts, a row each."""
    return pages.join(F.broadcast(told) if told.count() <= BROADCAST_ROWS else told, "host", "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, expression: one wrapper per host. A host's expressions are aligned in groups of about GROUP, then the groups' wrappers."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "expression": [infer(group["expression"].tolist())]})

    hosted = pages.select("html", host_of(F.col("url")).alias("host"))
    rows = materialize(expressions(_with(hosted, shared_strings(pages))), "html-expressions")
    while True:
        counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 1) == 1:
            return rows
        dealt = rows.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("expression"), F.ceil(F.col("n") / GROUP)))
        rows = materialize(dealt.groupBy("host", "part").applyInPandas(merge, "host string, expression string"), "html-wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    The pages of a host give its wrapper. Laid over a page, its strings are template and its slots are what may be content; the
    elements that are open at a slot tell the article from menus, headers, footers, sidebars, notices, adverts, forms and
    comments. Null and empty pages: empty text. Null urls, and urls without `://`, share the host ''. Repeated rows get
    repeated results; pages count whole, whatever their length. Hosts of fewer than LEAST different pages share no strings. Empty table:
    no rows. Other columns are ignored, whatever their names.
    """
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, expression in batches:
            yield pd.Series([extract(p, e) for p, e in zip(page, expression, strict=True)], dtype=object)

    rows = _with(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), wrappers(pages))
    return rows.select("page_id", "url", run.asNondeterministic()("html", "expression").alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
