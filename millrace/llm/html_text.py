"""Main text of web pages.

A page is cut into lines, one for each block of text. Nearest-URL page differencing takes every page: within a host,
pages are ordered by URL path and each is paired with the neighbour that shares the longer path prefix; all lines of
both are aligned by their longest common subsequence, and the shared ones, the template, are deleted. Pages that are
mostly the same (copies) say nothing about a template and are not used. The order is made by range partitions, so a
host with a third of all pages is spread over tasks. Only hashes of lines are ordered and aligned.

An exact check of the markup follows. Elements that never hold main text (scripts, styles, navigation, asides,
footers, forms and elements whose class, id or role names them adverts, menus, notices, comments and the like) are left
out, shared or not. Where a page marks its main text (``article``, ``main``, or the role), its lines are among those, and
its headings, paragraphs, list items, quotations and table cells stay where two pages share them, as a licence line or
a quoted passage belongs to both; what lies bare in the marked text (a label in a ``div``) goes if it is shared,
unless the marked text has no such elements at all. An element that is only named beside the text
(``content-sidebar-wrap``) and holds the marked text or its first heading (``entry-header``) is not left out.

Defined results: null and empty pages have an empty text; truncated and unbalanced markup is read as far as it
goes; a page without a neighbour on its host keeps all its lines; pages with no ``://`` in the URL are one host;
repeated rows are extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, settle, spread
from .url_filter import host_of, path_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|title|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements tracked for nesting, those never main text, and those that end a line of text.
NESTED = frozenset("html head body header footer nav aside form main article section div ul ol table figure button dialog".split())
DROPPED = frozenset("head footer nav aside form button dialog".split())
LINES = NESTED | frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd tr td th caption figcaption blockquote pre hr address details summary legend fieldset option center".split())
MARKED = frozenset(("article", "main"))
#: Words in class, id or role that name an element as something beside the main text.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "copyright disclaimer footer header masthead menu menubar modal nav navbar navigation newsletter notice pagination popup promo promoted "
    "related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)


#: Words of elements that may hold articles of their own, which are not the page's.
OTHERS = frozenset("comment comments promo promoted related replies reply respond sponsor sponsored widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose lines in marked text are the article's own, shared or not.
OWN = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre".split())
#: How an element that is left out may yet be taken: never, for ``main`` only, for any marked text or heading.
NEVER, FOR_MAIN, FOR_ANY = range(3)


def _excuse(name: str, attrs: str, words: set[str]) -> int:
    """What excuses an element left out for its ``words``: a name that is no more than such a word needs ``main``."""
    if name in DROPPED:
        return FOR_MAIN if name == "form" else NEVER
    tokens = {t for x in _NAMED.finditer(attrs) for t in (x[1] or x[2] or x[3] or "").lower().split()}
    return FOR_MAIN if words & OTHERS or tokens & (BESIDE - {"header", "masthead"}) else FOR_ANY


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """The page's candidate lines in order, and whether they come from marked main text."""
    lines, marked = blocks_of(page)
    return [line for line, candidate, _ in lines if candidate], marked


def blocks_of(page: str | None) -> tuple[list[tuple[str, bool, bool]], bool]:
    """All lines of the page in order, each with whether it is a candidate and whether it stays though it is shared, and
    whether candidates come from marked main text."""
    lines: list[tuple[str, tuple[int, ...], bool, bool]] = []  # line, elements left out around it, whether in marked text, whether in OWN
    stack: list[tuple[str, int, bool]] = []  # name, number in ``excuses`` if left out or -1, whether marked
    excuses: list[int] = []
    excused: set[int] = set()
    roots: list[tuple[int, ...]] = []  # elements left out around each marked one
    text: list[str] = []
    out: tuple[int, ...] = ()
    inside = headed = own = False

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append((line, out, inside, own))

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
        if name not in LINES:
            # an inline element may be named as something beside the text, too, but its end is not tracked
            continue
        flush()
        own = name in OWN and not m["close"]
        if name in HEADINGS and inside and not headed and not m["close"]:
            around = {x[1] for x in stack[next(i for i, x in enumerate(stack) if x[2]) :]} - {-1}
            if all(excuses[i] == FOR_ANY for i in around):
                excused |= around
                headed = True
        if name not in NESTED:
            continue
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
        elif not m["attrs"].endswith("/"):
            names = {w for x in _NAMED.finditer(m["attrs"]) for w in _WORD.findall((x[1] or x[2] or x[3] or "").lower())} if m["attrs"] else set()
            is_marked = name in MARKED or "main" in names and "role" in m["attrs"].lower()
            beside = name in DROPPED or (name == "header" and not inside) or (not is_marked and name not in ("html", "body") and bool(names & BESIDE))
            if is_marked:
                if not inside:
                    headed = False
                    least = FOR_ANY if name == "article" else FOR_MAIN
                    if all(excuses[i] >= least for i in out):
                        excused.update(out)
                roots.append(out)
            stack.append((name, len(excuses) if beside else -1, is_marked))
            if beside:
                excuses.append(_excuse(name, m["attrs"], names & BESIDE))
        out, inside = tuple(x[1] for x in stack if x[1] >= 0), any(x[2] for x in stack)
    text.append(page[at:])
    flush()
    any_marked = any(excused.issuperset(x) for x in roots)
    if not any_marked:
        excused.clear()
    blocks = [(x, is_marked >= any_marked and excused.issuperset(around), is_own) for x, around, is_marked, is_own in lines]
    bare = not any(candidate and is_own for _, candidate, is_own in blocks)
    return [(x, candidate, any_marked and (is_own or bare)) for x, candidate, is_own in blocks], any_marked


def shared_lines(one: list, two: list) -> set[int]:
    """Places in ``one`` of a longest common subsequence with ``two`` (Hunt and Szymanski)."""
    where: dict = {}
    for j, line in enumerate(two):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(one):
        for j in reversed(where.get(line, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    found: set[int] = set()
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _row_key(*row: object) -> bytes:
    return hashlib.blake2b(repr(row).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _parse(pages: DataFrame, hashed: bool) -> DataFrame:
    """``(key, page_id, url, lines)``, the candidates; or if ``hashed`` ``(key, url, hashes, candidate, stays)``, all lines.

    Equal rows have an equal key.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
                keys = pa.array([_row_key(*row) for row in rows], pa.binary())
                done = [blocks_of(page)[0] for *_, page in rows]
                if hashed:
                    sums = [[int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x, *_ in lines] for lines in done]
                    flags = (pa.array([[x[k] for x in lines] for lines in done], pa.list_(pa.bool_())) for k in (1, 2))
                    yield pa.RecordBatch.from_arrays([keys, part.column("url"), pa.array(sums, pa.list_(pa.int64())), *flags], ["key", "url", "hashes", "candidate", "stays"])
                else:
                    kept = pa.array([[x for x, candidate, _ in lines if candidate] for lines in done], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([keys, part.column("page_id"), part.column("url"), kept], ["key", "page_id", "url", "lines"])

    schema = "key binary, url string, hashes array<long>, candidate array<boolean>, stays array<boolean>" if hashed else "key binary, page_id long, url string, lines array<string>"
    return pages.select("page_id", "url", "html").mapInArrow(parsed, schema)


def _template(pages: DataFrame, copies: float) -> DataFrame:
    """``(key, gone)`` of pages ``(key, url, hashes, candidate, stays)`` that lose candidates, by their place among these, when
    differenced with their nearest neighbour by URL path."""
    placed = pages.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = ranked(placed, ["host", "path", "url", "key"], spread(pages.sparkSession))
    donor = placed.select("rank", F.struct("host", "path", "hashes", "candidate").alias("near"))
    both = placed.join(donor.select((F.col("rank") + 1).alias("rank"), F.col("near").alias("before")), "rank", "left")
    both = both.join(donor.select((F.col("rank") - 1).alias("rank"), F.col("near").alias("after")), "rank", "left")

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            for row in batch.select(["key", "host", "path", "hashes", "candidate", "stays", "before", "after"]).to_pylist():
                near = [x for x in (row["before"], row["after"]) if x and x["host"] == row["host"]]
                prefix = lambda x: next((i for i, (a, b) in enumerate(zip(x["path"], row["path"])) if a != b), min(len(x["path"]), len(row["path"])))  # noqa: E731, B023
                text = [i for i, is_candidate in enumerate(row["candidate"]) if is_candidate]
                for x in sorted(near, key=prefix, reverse=True):
                    shared = shared_lines(row["hashes"], x["hashes"])
                    if len(shared.intersection(text)) < copies * min(len(text), sum(x["candidate"])):
                        lost = [k for k, i in enumerate(text) if i in shared and not row["stays"][i]]
                        if lost:
                            keys.append(row["key"])
                            gone.append(lost)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return both.mapInArrow(differenced, "key binary, gone array<int>")


def extract_text(pages: DataFrame, *, copies: float = 0.8) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``.

    Two pages that share the part ``copies`` of the shorter one's candidate lines are copies.
    """
    # settled, as ordering by ranges reads its input twice; a page that is there twice is no neighbour of its own
    hashed = settle(_parse(pages, hashed=True).dropDuplicates(["key"]))
    # settled, too, so that its shuffle files are gone before the lines are shuffled
    rows = _parse(pages, hashed=False).join(settle(_template(hashed, copies)), "key", "left")
    lines = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: ~F.array_contains("gone", k)))
    text = F.array_join(lines, "\n\n")
    return rows.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
