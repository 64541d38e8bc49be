"""Main text of web pages, with site templates removed.

Every element has a hash of its subtree (tag, class, id, role, text and children). Spark counts, per host,
the different pages that hold a subtree (pages of the same text are one); subtrees that recur on many of them are the site's template and are
deleted, wherever on the page they are, together with all they hold. Bare blocks of text are no template on
their own: a licence line or a passage that a site publishes on many pages stays. Elements that are boilerplate by
their tag, class, id or role are deleted on every host, since reader comments and adverts differ from page to page.

What is left is the main text. ``article`` (else ``main``) only breaks the tie where recurrence says nothing: on a host
without any template the text is that of the article, and where the template would take all the text of a page the page is
read as if its host had none.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import written
from plazaflow.llm.token_blocks import chunks
from plazaflow.llm.url_filter import host_of
from plazaflow.session import ensure_importable

#: Different pages of a host on which a subtree recurs to count as its template.
MIN_PAGES = 5
#: And the share of the host's different pages, so that what counts as template does not follow the size of the host.
MIN_SHARE = 0.3
#: Bytes of all hosts' templates that are broadcast at most; beyond that pages are joined with their host's.
MOST_BROADCAST = 16 << 20
#: Parts into which the pages of a host are dealt in that join.
SALT = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that do not part the text around them.
INLINE = frozenset("script style noscript template a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED_TAGS = frozenset("head title script style noscript template iframe object svg canvas nav footer aside form button select textarea input dialog menu xmp noembed noframes".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies share sharing social related recommended footer pagination pager toolbar".split()
)
OUTSIDE_NAMES = frozenset(["header", "masthead"])
#: What a name of several parts may hold besides names of boilerplate: ``ad-slot``, but not ``no-comments`` or ``related-work``.
HOLDERS = frozenset("area bar block bottom box col column container content group holder inner item items left link links list outer panel right row section site slot slots top unit widget widgets wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Bare blocks of text: they go with a template that holds them, but are none on their own.
TEXT_BLOCKS = HEADINGS | INLINE | frozenset("p li dt dd td th pre blockquote figcaption caption address".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A start tag of the first closes an open element of the second, unless one of the third stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_LIMIT = frozenset("table td th caption button object".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[^a-z0-9]+")


def _boilerplate(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names of a class or id says boilerplate with all of its parts."""
    for name in value.split():
        parts = set(filter(None, _NAME.split(name)))
        if not parts.isdisjoint(names) and parts <= names | HOLDERS:
            return True
    return False


class Page:
    """Blocks of text and elements of a page.

    blocks: of each its pieces, (text, element); parent, tag, drop (deleted by its name or with one that holds it), digest: of each element; 0 is
    the page itself.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self._weak = ["#page"], [-1], [False], [False]
        self.digest: list[int] = [0]
        self.blocks: list[list[tuple[str, int]]] = []
        self.main: list[int] = []
        self._state = [xxhash.xxh64()]
        self._open = [0]
        self._pieces: list[tuple[str, int]] = []
        self._read(source)
        while self._open:
            self._close()
        self._settle()

    def _settle(self) -> None:
        """Pass drops on to what elements hold; those that are weak spare an element that holds an article or main."""
        strong = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            strong[e] = strong[self.parent[e]] or (self.drop[e] and not self._weak[e])
        for e in self.main:
            if not strong[e]:
                for up in self.above(e):
                    self.drop[up] = False
        for e in range(1, len(self.tag)):
            self.drop[e] |= self.drop[self.parent[e]]
        self.main = [e for e in self.main if not self.drop[e]]

    def _flush(self) -> None:
        if self._pieces:
            self.blocks.append(self._pieces)
            self._pieces = []

    def _close(self) -> None:
        e = self._open[-1]
        if self.tag[e] not in INLINE:
            self._flush()
        self._open.pop()
        self.digest[e] = self._state.pop().intdigest()
        if self._open:
            self._state[-1].update(b"\1%d" % self.digest[e])

    def _close_to(self, e: int) -> None:
        while self._open[-1] != e:
            self._close()
        self._close()

    def _find(self, names, stop) -> int | None:
        for e in reversed(self._open):
            if self.tag[e] in names:
                return e
            if self.tag[e] in stop:
                break
        return None

    def _text(self, raw: str) -> None:
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            e = self._open[-1]
            self._pieces.append((text, e))
            bare = text.strip()
            if bare:
                self._state[-1].update(b"\2" + bare.encode("utf-8", "replace"))

    def _start(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            if tag in CLOSES:
                # the innermost and any that it is in, as td in tr
                while (e := self._find(*CLOSES[tag])) is not None:
                    self._close_to(e)
            elif (e := self._find({"p"}, P_LIMIT)) is not None:
                self._close_to(e)
            self._flush()
        elif tag in ("br", "wbr"):
            if tag == "br":
                self._pieces.append((" ", self._open[-1]))
            return
        if tag in VOID:
            return
        drop, weak, named = tag in DROPPED_TAGS and tag != "form", tag == "form", ""
        inside = any(self.tag[e] in ("article", "main") for e in self._open)
        if attrs:
            for m in _ATTR.finditer(attrs):
                value = (m[2] or m[3] or m[4] or "").lower()
                kind = m[1].lower()
                named += f"{kind}={value};"
                if tag in ("html", "body", "article", "main"):
                    drop |= kind == "role" and value in DROPPED_ROLES
                elif kind == "role":
                    drop |= value in DROPPED_ROLES
                elif kind == "class" or tag not in HEADINGS:  # the id of a heading is a place to link to
                    weak |= _boilerplate(value, DROPPED_NAMES if inside else DROPPED_NAMES | OUTSIDE_NAMES)
        drop |= tag == "header" and not inside
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.drop.append(drop or weak)
        self._weak.append(not drop)
        self.digest.append(0)
        if tag in ("article", "main") or "role=main;" in named:
            self.main.append(k)
        self._state.append(xxhash.xxh64(f"{tag};{named}".encode("utf-8", "replace")))
        self._open.append(k)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _TAG.search(source, at)
            if m is None:
                rest = source[at:]
                cut = re.search(r"<[a-zA-Z/]", rest)  # a tag that never ends takes the rest with it
                self._text(rest[: cut.start()] if cut else rest)
                return
            self._text(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                stop = () if name != "p" else P_LIMIT
                e = self._find({name}, stop)
                if e is not None and e:
                    self._close_to(e)
                elif name == "br":
                    self._pieces.append((" ", self._open[-1]))
            elif name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                self._start(name, m[3])
                if self.drop[self._open[-1]]:
                    self._state[-1].update(b"\3")  # scripts and the like count by their being there
                self._close()
                at = end.end() if end else len(source)
            else:
                self._start(name, m[3])

    def content(self) -> set[int]:
        """The elements that hold the main content: outermost articles, else mains; none if there is neither."""
        for kind in (("article",), None):
            found = {e for e in self.main if kind is None or self.tag[e] in kind}
            if found:
                return {e for e in found if not any(p in found for p in self.above(e))}
        return set()

    def above(self, e: int) -> Iterator[int]:
        while (e := self.parent[e]) >= 0:
            yield e

    def candidates(self) -> set[int]:
        """Elements that may be of the site's template: all but the main content as a whole, what holds it, and bare blocks of text."""
        whole = self.content()
        whole |= {p for e in whole for p in self.above(e)}
        return {e for e in range(1, len(self.tag)) if e not in whole and self.tag[e] not in ("html", "body") and self.tag[e] not in TEXT_BLOCKS}

    def text(self, template: set[int]) -> str:
        """The main text. template: digests of subtrees to delete; none if the host has no template."""
        if template:
            may = self.candidates()
            found = self._left({e for e in may if self.digest[e] in template}, set())
            if found:
                return found
        return self._left(set(), self.content())

    def _left(self, deleted: set[int], within: set[int]) -> str:
        """The text outside what is dropped or ``deleted``, and inside the elements of ``within`` unless there are none."""
        gone = [False] * len(self.tag)
        kept = [not within] * len(self.tag)
        for e in range(1, len(self.tag)):
            up = self.parent[e]
            gone[e] = gone[up] or self.drop[e] or e in deleted
            kept[e] = kept[up] or e in within
        blocks = (" ".join("".join([t for t, e in pieces if kept[e] and not gone[e]]).split()) for pieces in self.blocks)
        return "\n".join(filter(None, blocks))


def _signed(x) -> np.ndarray:
    return np.array(sorted(x), np.uint64).view(np.int64)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        found, texts = [], []
        for h in b.column("html").to_pylist():
            page = Page(h or "")
            found.append(_signed({page.digest[e] for e in page.candidates()}))
            texts.append(xxhash.xxh64_intdigest(page.text(set()).encode("utf-8", "replace")))
        columns = [b.column("host"), pa.array(np.array(texts, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "subtrees"])


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in chunks(batches):
        packed = pa.array([pack((h or "").encode("utf-8", "replace")) for h in b.column("html").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "salt")), packed], names=["page_id", "url", "host", "salt", "html"])


TEXTS = "page_id long, url string, text string, n_chars long"


def _texts(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _digests(template: list[int] | None) -> set[int]:
    return set(np.array(template, np.int64).view(np.uint64).tolist()) if template else set()


def _render_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield _texts(part, [Page(unpack(h).decode()).text(_digests(t)) for h, t in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True)])


def _renderer(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {host: _digests(t) for host, t in shipped.value.items()}
        for b in chunks(batches):
            yield _texts(b, [Page(h or "").text(of.get(host, set())) for h, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True)])

    return run


def host_templates(rows: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """host and template, the hashes of the subtrees that recur on its pages, of the hosts that have any, from ``rows(host, html)``.

    Pages of a host are the same if what the names leave of them is, so that one story under many addresses is no template.
    Each (host, page, subtree) counts once, repetitions being dropped before they are shuffled. A host's list is no
    longer than the subtrees of 1 / ``min_share`` of its pages.
    """
    found = written(rows.select("host", "html").mapInArrow(_subtrees, "host string, page long, subtrees array<long>"), "subtrees")
    hosts = found.select("host", "page").distinct().groupBy("host").agg((F.count("*") * min_share).alias("least"))
    each = found.select("host", "page", F.explode("subtrees").alias("subtree")).distinct()
    counts = each.groupBy("host", "subtree").count().filter(F.col("count") >= min_pages)
    recurring = counts.join(hosts, "host").filter(F.col("count") >= F.col("least"))
    return written(recurring.groupBy("host").agg(F.collect_list("subtree").alias("template")), "template")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text; a null url has the empty host, whose pages share a template
    like any other's. Rows that repeat each get a row, and count as one page for the template, as do a host's pages
    of the same text. A very long page is read whole, by one task that holds it. An empty table gives an empty
    result; other columns are ignored. A template is on ``min_pages`` different pages of its host at least and on
    ``min_share`` of them. Templates of ``most_broadcast`` bytes together at most are broadcast, and pages stay where they
    are; larger ones are joined with the pages, a host's dealt over several tasks.
    """
    spark = pages.sparkSession
    ensure_importable(spark)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    template = host_templates(rows, min_pages, min_share)
    size = template.agg(F.coalesce(F.sum(8 * F.size("template") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size <= most_broadcast:
        shipped = spark.sparkContext.broadcast({r["host"]: r["template"] for r in template.collect()})
        return rows.mapInArrow(_renderer(shipped), TEXTS)
    salt: Column = F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")
    small = rows.withColumn("salt", salt).select("page_id", "url", "host", "salt", "html").mapInArrow(_shrink, "page_id long, url string, host string, salt int, html binary")
    dealt = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return small.join(dealt, ["host", "salt"], "left").select("page_id", "url", "html", "template").mapInArrow(_render_joined, TEXTS)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from plazaflow.session import table

    return extract(table(spark, sf_dir, "pages"))


#: The rows of ``op8_html_text`` for pages made like those of the benchmark tables: one article, of headings and paragraphs.
OP8_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, [regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') for x in regexp_split_to_array(body, '</?(?:h1|p)>')] AS blocks FROM a),
c AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) for x in blocks] AS blocks FROM b),
d AS (SELECT page_id, url, array_to_string([x for x in blocks if x <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
