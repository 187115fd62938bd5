"""Main text of pages: structure first, then what the pages of a host repeat.

Markup that names its purpose (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts) is dropped wherever it stands, and a page that marks its article keeps
that article whole. Where a page marks none, a suffix array of its host decides: suffixes of
blocks that several pages of the host begin alike, for WIDTH tokens or up to the end of a
shorter block, are repeated; blocks that are repeated whole or covered by repeated runs are
boilerplate; the others are kept.

The array is sorted by Spark, in ranges of host and suffix, and neighbours are compared.
Suffixes are as long as they can matter: where pages share more than WIDTH tokens they
share WIDTH at each place of what they share. Every place of every block counts. Suffixes whose
start no LEAST_PAGES pages can share, by a hash of it, have no neighbours and are not sorted;
equal ones of a task are sorted once, with their number. So a passage that all pages of one
host hold is a few rows, and the array splits evenly over tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from millrace.llm.hash_files import HashSet, hash_set
from millrace.llm.suffix_dedup import Rolling
from millrace.llm.words import mixed
from millrace.sources.staging import stage

WIDTH = 12  # tokens of a run
SHOWN = 1024  # bytes of a suffix that are sorted as they are; of longer ones a hash stands for the rest
SEGMENTS = 1024  # of the hashes of suffixes, 32 bits each
HELD = 1_000_000  # hashes that a task packs at once
SORTED = 40_000  # different suffixes that a task counts before it sends them
LEAST_PAGES = 3  # pages that share a substring before it is boilerplate
COVERED = 0.8  # share of a block's runs that are repeated when it is boilerplate

NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
# The rest of a tag; quotes hide a bracket only around values, and only if they are closed.
TAG_END = re.compile(r"""(?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=[\s/>]|\Z)""", re.I)

# Elements by what they hold.
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var img wbr input label "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup semantics".split()
)
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words that name boilerplate in class names and ids; the second line not inside an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices popup modal newsletter subscribe subscription sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer comment comments disqus reply replies respond related share sharing social widget widgets "
    "login signin signup pagination pager toolbar".split()
)
OUTER = frozenset("header masthead topbar".split())
# Words that may stand beside them in one name without giving it another meaning.
LAYOUT = frozenset(
    "site page main top bottom left right primary secondary inner outer global mobile area list container wrapper "
    "wrap box block section bar row panel pane slot unit group buttons button links link icons item items form body "
    "text title content thread author meta post posts article articles story stories entry bottombar js the of on "
    "in for and mega sub sticky fixed floating overlay message count".split()
)
PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
# Elements that end an open one of some kinds, up to the element that holds them.
ENDS = {
    **{name: (frozenset(("li",)), frozenset(("ul", "ol", "menu"))) for name in ("li",)},
    **{name: (frozenset(("dt", "dd")), frozenset(("dl",))) for name in ("dt", "dd")},
    **{name: (frozenset(("td", "th")), frozenset(("table",))) for name in ("td", "th")},
    **{name: (frozenset(("tr", "td", "th")), frozenset(("table",))) for name in ("tr", "tbody", "thead", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}


def names_boilerplate(name: str, words: frozenset[str]) -> bool:
    """Whether a class name or id is made of such words, layout words beside them: share-price is not."""
    parts = [p.lower() for p in PARTS.split(name) if p]
    return any(p in words for p in parts) and all(p in words or p in LAYOUT or p.isdigit() for p in parts)


def boilerplate(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "role" and value.strip().lower() in ROLES:
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if key in ("class", "id"):
            if any(names_boilerplate(n, NAMES) or not inside and names_boilerplate(n, NAMES | OUTER) for n in value.split()):
                return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of the tags of a page in order, `/name` for an end tag, '' for comments and the like.

    A tag that is never closed is text. One pass: where quotes hide all that could close a
    tag, quotes mean nothing from there on.
    """
    at, quotes = page.find("<"), True
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            found = page.find("-->", at + 4)
            end = found + 3 if found >= 0 else len(page)
            yield at, end, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            if end > 0:
                yield at, end, "", ""
        elif m := NAME.match(page, at):
            close = TAG_END.match(page, m.end()) if quotes else None
            end = close.end() if close else page.find(">", m.end()) + 1
            quotes = quotes and (close is not None or end <= 0)
            if end > 0:
                yield at, end, ("/" if page[at + 1] == "/" else "") + m[1].lower(), page[m.end() : end - 1]
        if end == 0:  # nothing closes this tag, nor any later one
            return
        at = page.find("<", max(end, at + 1))


def blocks_of(page: str) -> tuple[list[str], bool]:
    """(text blocks, whether the page marks its article): the article's blocks, else all that are no boilerplate."""
    inner: list[str] = []
    outer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, inside the article; the last two inherited
    parts: list[str] = []
    at, skipped = 0, None  # where text goes on; the element whose content is skipped
    closings: dict[str, int] = {}  # where the last end tag of such elements stands

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            (inner if stack and stack[-1][2] else outer).append(text)

    def put(chunk: str) -> None:
        if chunk and not (stack and stack[-1][1]):
            parts.append(html.unescape(chunk) if "&" in chunk else chunk)

    def leave(names: frozenset[str], limits: frozenset[str]) -> None:
        """Close the open elements from the first of some names on that no limit holds."""
        first = len(stack)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in limits:
                break
            if stack[k][0] in names:
                first = k
        del stack[first:]

    for start, end, name, attributes in tags(page):
        if skipped is not None:
            if name == f"/{skipped}":
                at, skipped = end, None
            continue
        put(page[at:start])
        at = end
        if not name:
            continue
        plain = name.removeprefix("/")
        if plain not in INLINE:
            close()
        if name != plain:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == plain:
                    del stack[k:]
                    break
            continue
        if name not in INLINE:
            # A paragraph ends where a block begins; list items and cells where the next one does.
            held = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), -1)
            if held >= 0 and stack[held][0] == "p":
                del stack[held:]
            if name in ENDS:
                leave(*ENDS[name])
        if name in RAW:
            # One that is never closed holds nothing, but for scripts and styles, which end with the page.
            if name not in closings:
                closings[name] = max((m.start() for m in re.finditer(f"</{name}", page, re.I)), default=-1)
            if name in ("script", "style") or closings[name] >= end:
                skipped = name
        elif name not in VOID and not attributes.endswith("/"):
            bad, inside = stack[-1][1:] if stack else (False, False)
            main = name in MAIN and not bad
            bad = bad or boilerplate(name, attributes, inside or main) and not (name in INLINE and in_code(stack))
            main = main and not bad
            # Inline markup and paragraphs are left open so often that they hold no others.
            if name not in INLINE and name not in ("p", "li") or bad or name == "code":
                stack.append((name, bad, inside or main))
    if skipped is None:
        put(page[at:])
    close()
    return (inner, True) if inner else (outer, False)


def in_code(stack: list[tuple[str, bool, bool]]) -> bool:
    """Inside code, names of inline elements are those of a highlighter."""
    return any(name in ("pre", "code") for name, _, _ in stack)


def host_hash(url: str | None) -> int:
    m = re.match(r".*?://([^/?#]*)", url or "", re.S)
    return xxhash.xxh3_64_intdigest((m[1] if m else "").lower())


def places(blocks: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, owner, runs): the suffixes of blocks, cut after WIDTH tokens, the block of each and each block's number of them.

    A block of fewer tokens has one suffix, from its start to its end mark.
    """
    data = "".join(b + "\n" for b in blocks).encode()
    letters = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero((letters == 32) | (letters == 10))
    begins = np.append(0, stops[:-1] + 1)[: len(stops)]
    last = np.flatnonzero(letters[stops] == 10)
    sizes = np.diff(last, prepend=-1)
    token = np.arange(len(stops))
    owner = np.repeat(np.arange(len(blocks)), sizes)
    first = last - sizes + 1
    use = np.where(sizes[owner] < WIDTH, token == first[owner], token + WIDTH - 1 <= last[owner])
    at = token[use]
    own = owner[use]
    end = np.where(sizes[own] < WIDTH, stops[last[own]] + 1, stops[np.minimum(at + WIDTH - 1, last[own])])
    return data, begins[at], end, own, np.bincount(own, minlength=len(blocks))


def start_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, host: int) -> np.ndarray:
    """A number below SEGMENTS * 2^32 for each suffix, the same for equal ones of a host."""
    if not len(starts):
        return np.zeros(0, np.int64)
    found = Rolling(np.frombuffer(data, np.uint8)).of(starts, None, ends - starts)
    return (mixed(found, np.full(len(found), host, np.uint64)) % np.uint64(SEGMENTS << 32)).astype(np.int64)


def suffix(data: bytes, start: int, end: int) -> bytes:
    if end - start <= SHOWN:
        return data[start:end]
    return data[start : start + SHOWN - 16] + xxhash.xxh3_128_digest(data[start:end])


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, body, marked, blocks) of all pages; body is a hash of the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(page or "") for page in batch.column(2).to_pylist()]
            hosts = np.array([host_hash(u) for u in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            bodies = [xxhash.xxh3_64_intdigest("\n".join(b)) >> 1 for b, _ in found]
            columns = [*batch.columns[:2], pa.array(hosts), pa.array(bodies, pa.int64()), pa.array([m for _, m in found], pa.bool_())]
            columns.append(pa.array([b for b, _ in found], pa.list_(pa.string())))
            yield pa.record_batch(columns, ["page_id", "url", "host", "body", "marked", "blocks"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host long, body long, marked boolean, blocks array<string>"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def shared_starts(texts: DataFrame) -> DataFrame:
    """Start hashes that LEAST_PAGES pages have, each once a page; they travel sorted, as differences, a byte of all together."""
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        keys = np.concatenate((keys[:LEAST_PAGES], keys[LEAST_PAGES:][keys[LEAST_PAGES:] != keys[:-LEAST_PAGES]]))  # more say no more
        segments, first = np.unique(keys >> 32, return_index=True)
        low = [np.diff(part & 0xFFFFFFFF, prepend=0).astype("<u4") for part in np.split(keys, first[1:])]
        columns = [pa.array(segments.astype(np.int32)), pa.array([x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in low], pa.binary())]
        return pa.record_batch(columns, ["segment", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for host, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, starts, ends, _, _ = places(blocks)
                held.append(np.unique(start_hashes(data, starts, ends, host % (1 << 64))))
                size += len(held[-1])
                if size >= HELD:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def repeated(frame: pd.DataFrame) -> pd.DataFrame:
        parts = (np.frombuffer(k, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for k in frame["keys"])
        low = np.sort(np.concatenate([np.cumsum(x, dtype=np.uint32) for x in parts]))
        n = LEAST_PAGES - 1
        often = np.unique(low[n:][low[n:] == low[: max(len(low) - n, 0)]])
        return pd.DataFrame({"key": (int(frame["segment"].iloc[0]) << 32) + often.astype(np.int64)})

    rows = texts.select("host", "blocks").mapInArrow(run, "segment int, keys binary")
    return rows.groupBy("segment").applyInPandas(repeated, "key long")


def suffix_rows(texts: DataFrame, starts: HashSet) -> DataFrame:
    """(host, suffix, n, a, b): suffixes with shared starts, the pages that hold them, the least and the greatest of their bodies."""
    def table(held: dict) -> pa.RecordBatch:
        keys, values = zip(*held.items())
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary())]
        columns += [pa.array(c, pa.int64()) for c in zip(*values)]
        return pa.record_batch(columns, ["host", "suffix", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for batch in batches:
            for host, body, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                data, begin, end, _, _ = places(blocks)
                hit = starts.has(start_hashes(data, begin, end, host % (1 << 64)))
                for own in {suffix(data, s, e) for s, e in zip(begin[hit].tolist(), end[hit].tolist())}:
                    n, a, b = held.get((host, own), (0, body, body))
                    held[host, own] = n + 1, min(a, body), max(b, body)
                if len(held) >= SORTED:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    return texts.select("host", "body", "blocks").mapInArrow(run, "host long, suffix binary, n long, a long, b long")


def common_tokens(one: bytes, other: bytes) -> int:
    """Tokens that two suffixes begin with alike; the end of a block is part of its last token."""
    n = 0
    for a, b in zip(one.split(b" "), other.split(b" ")):
        if a != b:
            break
        n += 1
    return n


def repeated_suffixes(rows: DataFrame) -> DataFrame:
    """key of the suffixes that LEAST_PAGES pages of a host, not all copies of one, have whole as a common prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, a, b = None, 0, 0, 0
        for batch in batches:
            keys = []
            for host, own, more, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and at[0] == host and len(at[1]) == len(own) and common_tokens(at[1], own) == own.count(b" ") + 1:
                    n, a, b = n + more, min(a, low), max(b, high)
                    continue
                if n >= LEAST_PAGES and a != b:
                    keys.append(suffix_key(*at))
                at, n, a, b = (host, own), more, low, high
            yield pa.record_batch([pa.array(keys, pa.int64())], ["key"])
        if n >= LEAST_PAGES and a != b:
            yield pa.record_batch([pa.array([suffix_key(*at)], pa.int64())], ["key"])

    return rows.repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix").mapInArrow(run, "key long")


def suffix_key(host: int, own: bytes) -> int:
    key = xxhash.xxh3_64_intdigest(own, host % (1 << 64))
    return key - (1 << 64) if key >> 63 else key


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Blocks are joined by one space, white space inside a block becomes one space, character
    references are decoded. A page that marks an article or a main element yields what
    stands in it; passages that many articles share stay. Any other page yields the blocks
    that no boilerplate markup holds, and its host neither repeats nor covers by repeated runs; exact
    copies of a page count once for that. A NULL or empty page, or one of nothing but
    boilerplate, has an empty text. Pages with a NULL url form one host; repeated rows are
    extracted each; other columns are not read; an empty table gives no rows.
    """
    found = stage(parsed(pages), "blocks", codec="zstd")  # the most that this keeps on disk
    starts = hash_set(shared_starts(found), "shared-starts")
    known = hash_set(repeated_suffixes(stage(suffix_rows(found, starts), "suffixes")), "repeated-suffixes")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, marked, blocks in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                out.append(" ".join(blocks if marked else own_blocks(blocks, host, starts, known)))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    return found.select("page_id", "url", "host", "marked", "blocks").mapInArrow(
        texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    )


def own_blocks(blocks: list[str], host: int, starts: HashSet, known: HashSet) -> list[str]:
    """The blocks that the host does not repeat whole and its repeated runs do not cover."""
    data, begin, end, owner, runs = places(blocks)
    hit = np.flatnonzero(starts.has(start_hashes(data, begin, end, host % (1 << 64))))
    keys = [suffix_key(host, suffix(data, s, e)) for s, e in zip(begin[hit].tolist(), end[hit].tolist())]
    hit = hit[known.has(np.array(keys, np.int64))]
    share = np.bincount(owner[hit], minlength=len(blocks)) / np.maximum(runs, 1)
    return [b for b, s in zip(blocks, share) if s < COVERED]
