"""HTML extraction: the text of a page that markup leaves, without the runs that its host repeats.

Markup first: everything in the body is a candidate but what stands in an element of BOILERPLATE, of
a boilerplate role, hidden, or with a boilerplate word in its class or id, unless that element holds
the article.

Then the candidates of all pages are searched for strings that their host repeats. Runs of RUN
tokens within a block (all tokens of a shorter block) are looked up by (host, hash), every place of
every page; longer repeated strings are chains of these. This finds the repeated strings of RUN
tokens and more that a suffix array over the host's token stream would, without the order of
suffixes, so that a host need not fit in a task. A run is

1. repeated, if it stands on at least PAGES distinct pages of the host;
2. of a template, if PAGES of these have text of their own: repeated runs leave a share OWN of their
   places. Copies of an article, near ones too, leave nothing else, so they don't tell of a template
   and keep their text; a template's words are cut from them too, as other pages tell of it.

The words that a template's runs cover are cut, others of the block stay. Of what is left, an article
or main element is the text, unless more prose (blocks of RUN words) is left outside: then all is.

Runs travel as packed keys and places. A chunk of pages sends a key that it shows to be repeated by
itself only once, so a hot host or template fills no task.

Defined results: null or empty html has empty text; a null url is a host of its own; character
references are decoded once; white space within a block becomes one space; repeated rows give equal
rows (the same page_id counts as one page); unclosed elements end with their parents; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_count, bucket_of, pack, runs, squeeze, unpack, unsqueeze
from .common import materialised, pages, small_or_shuffled
from .kernel import U, Words, mixed, pieces, utf8, windows, words

RUN, PAGES, OWN = 8, 3, 0.25
#: Bits of a key. Runs that share one by chance would have to meet on PAGES pages.
KEY = 48
CHUNK_RUNS = 2_000_000
#: Elements that are never text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "canvas", "audio", "video"}
BOILERPLATE = SILENT | {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "input", "label", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
#: Words of class and id names. A name that is one of these counts anywhere; one with such a part counts for a
#: container outside articles alone, since parts say little: share-prices, related-work.
WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply responses "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element of the key ends when one of the values begins.
ENDED_BY = {
    "p": {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "address", "fieldset"},
    "head": {"body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
#: A tag whose quotes are closed; anything else, a tag with a broken attribute ends at the next angle bracket. Neither looks back.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>?|[^<]++|<", re.S)
#: So many broken tags of a page are read to the page's end for their quotes; later ones, and all after them, end at the next bracket.
BROKEN = 64
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: An attribute list without any of these needs no parsing.
TELLING = re.compile("class|id|role", re.I)
#: Parts of a name after these say what an element holds or lacks, not what it is: has-sidebar.
HOLDING = {"has", "with", "no", "without", "show", "hide", "hides", "shows"}
CONTAINERS = {"div", "section", "ul", "ol", "span", "a"}
#: Never judged by class or id.
WHOLE = {"html", "body", "main", "article"}
#: White space of any kind, Unicode's too.
SPACES = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    """By name, lower-cased; of equal names the first counts."""
    out: dict[str, str] = {}
    if TELLING.search(text):
        for m in ATTRIBUTE.finditer(text):
            out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def _named(value: str) -> int:
    """Whether a class or id is a boilerplate word (2), has one as a part (1), or neither (0)."""
    most = 0
    for name in value.split():
        if name in WORDS:
            return 2
        for part in re.split(r"[^a-z]+", name):
            if part in HOLDING:
                break
            if part in WORDS:
                most = 1
    return most


def _judged(tag: str, attributes: str) -> tuple[int, int, bool]:
    """(is boilerplate: 2, or 1 unless it heads an article; is boilerplate unless it holds the article: 2, or 1
    outside articles; is an article or main element)."""
    named = _attributes(attributes) if attributes else {}
    roles = named.get("role", "").split()
    told = "hidden" in named or named.get("aria-hidden") == "true" or not ROLES.isdisjoint(roles)
    hard = 2 if told or tag in BOILERPLATE and tag not in ("form", "header") else int(tag == "header")
    article = tag in ("article", "main") or "main" in roles
    soft = 2 * (tag == "form")
    if not soft and tag not in WHOLE and not article:
        soft = max(_named(named.get("class", "")), _named(named.get("id", "")))
        soft = soft if soft == 2 or tag in CONTAINERS else 0
    return hard, soft, article


_judged_before = lru_cache(1 << 14)(_judged)


def blocks(page: str) -> list[tuple[bool, str]]:
    """(in an article or main element, text) of each block that markup leaves.

    A class, an id or a form silences an element, but not the one that holds the page's article:
    the articles within the fewest such elements are the page's, and what holds them speaks. If
    there is no article and nothing else has text, the outermost such elements speak.
    """
    found, parent = _open_blocks(page)
    depth, named = [0], [True]  # of each element that class, id or form would silence, from place 1 on
    for up in parent[1:]:
        depth.append(depth[up] + 1)
        named.append(False)
    marks = {over for _, over, _ in found if over is not None} or {soft for soft, _, _ in found}
    least = min((depth[e] for e in marks), default=0)
    for e in marks:
        if depth[e] == least:
            while not named[e]:
                named[e], e = True, parent[e]
    speaks = [True]
    for e in range(1, len(parent)):
        speaks.append(named[e] and speaks[parent[e]])
    return [(over is not None, text) for soft, over, text in found if speaks[soft]]


def _open_blocks(page: str) -> tuple[list[tuple[int, int | None, str]], list[int]]:
    """([(element around it that class, id or form would silence, that around its outermost article or None, text)], parents).

    Such elements are numbered from 1 and name the one around them; 0 is none. Every step consumes what
    it reads, so a page takes time in proportion to its length.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate, boilerplate unless it holds the article, article
    opened: Counter[str] = Counter()
    block_at: list[int] = []  # places in the stack of elements that are not inline
    parts: list[str] = []
    soft, parent = [0], [0]
    over: list[int] = []
    quiet, silent, broken = 0, "", 0
    found: list[tuple[int, int | None, str]] = []

    def flush():
        if not parts:
            return
        text = "".join(parts)
        parts.clear()
        if text.isspace():
            return
        text = SPACES.sub(" ", entities.unescape(text)).strip(" ")
        if text:
            found.append((soft[-1], over[0] if over else None, text))

    def pop() -> str:
        nonlocal quiet
        element = stack.pop()
        opened[element[0]] -= 1
        if block_at and block_at[-1] == len(stack):
            block_at.pop()
        quiet -= element[1]
        if element[2]:
            soft.pop()
        if element[3]:
            over.pop()
        return element[0]

    at = 0
    while at < len(page):
        if silent:  # raw text up to its end tag
            end = re.compile(rf"</{silent}\s*>", re.I).search(page, at)
            at, silent = (end.end() if end else len(page)), ""
            continue
        m = TAG.match(page, at) if page[at] == "<" and broken < BROKEN else None
        if not m:
            m = PART.match(page, at)
            broken += bool(m[2])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                if not quiet:
                    parts.append(m[0])
            continue
        if m[1]:
            depth = len(stack)
            if opened[tag]:
                depth -= 1
                while stack[depth][0] != tag:
                    depth -= 1
            # an inline element may be judged by its attributes too, and its text is then a block of its own
            if tag not in INLINE or any(e[2] or e[3] for e in stack[depth:]):
                flush()
            while len(stack) > depth:
                pop()
            continue
        if tag not in INLINE:
            flush()
            while block_at and tag in ENDED_BY.get(stack[block_at[-1]][0], ()):
                while pop() in INLINE:
                    pass
        if tag in ("script", "style", "textarea", "noscript", "template", "iframe") and not m[3].rstrip().endswith("/"):
            silent = tag
            continue
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        hard, gentle, article = (_judged_before if len(m[3]) < 200 else _judged)(tag, m[3])
        hard = hard == 2 or hard == 1 and not opened["article"]
        gentle = gentle == 2 or gentle == 1 and not opened["article"]
        if tag in INLINE and (gentle or article):
            flush()
        if tag not in INLINE:
            block_at.append(len(stack))
        stack.append((tag, hard, gentle, article))
        opened[tag] += 1
        quiet += hard
        if article:
            over.append(soft[-1])
        if gentle:
            parent.append(soft[-1])
            soft.append(len(parent) - 1)
    flush()
    return found, parent


def parsed(pages_: DataFrame) -> DataFrame:
    """(row, page_id, url, host, page, blocks, inside): page is a hash of page_id; inside tells the blocks of an article or main element."""
    schema = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("blocks", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_()))])

    def rows(batches):
        for batch in pieces(batches, "html"):
            found = [blocks(page.as_py() or "") for page in batch.column("html")]
            texts, inside = pa.array([[t for _, t in f] for f in found], pa.list_(pa.string())), pa.array([[a for a, _ in f] for f in found], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "page_id", "url", "host", "page")), texts, inside], schema=schema)

    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    page_id = F.col("page_id").cast("long")
    numbered = pages_.select(F.monotonically_increasing_id().alias("row"), page_id.alias("page_id"), "url", host.alias("host"), F.xxhash64(page_id).alias("page"), "html")
    return numbered.mapInArrow(rows, "row long, page_id long, url string, host string, page long, blocks array<string>, inside array<boolean>")


def block_words(texts: list[str]) -> tuple[np.ndarray, Words, np.ndarray]:
    """(bytes, words, place of each block's first word, and the end). A block takes RUN places at least, so that no run of RUN places meets two."""
    raw, at = utf8(pa.array(texts, pa.string()))
    w = words(raw, at, fold=True)
    return raw, w, np.concatenate([[0], np.cumsum(np.maximum(np.diff(w.first), RUN))])


def runs_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its first word) of every run of RUN words within a block; all words of a shorter block."""
    n = np.diff(w.first)
    block = w.row()
    start = np.flatnonzero(np.arange(len(w.hash)) + RUN <= w.first[1:][block])
    every = windows(w.hash, RUN)[start]
    short = np.flatnonzero((n > 0) & (n < RUN))
    few = np.array([windows(w.hash[w.first[i] : w.first[i + 1]], int(n[i]))[0] for i in short], U)
    return np.concatenate([every, few]), np.concatenate([start, w.first[short]]).astype(np.int64)


#: Runs of a chunk of pages: key, place in the chunk, who votes (empty ``votes``: the pages, which ``slots`` tells).
#: ``sure`` has keys that the chunk alone shows to be repeated; held rows are known to be repeated, and go by the bucket.
PACK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("held", pa.bool_()), *((c, pa.binary()) for c in ("keys", "places", "votes", "slots", "sure", "rows", "ids", "sizes"))])
PACK_ROWS = "bucket long, chunk long, held boolean, keys binary, places binary, votes binary, slots binary, sure binary, rows binary, ids binary, sizes binary"


def _small(x: np.ndarray) -> bytes:
    """Whole numbers of any order: their number, the least, and what is above it, a frame for each plane of bytes:
    high bytes compress, low ones don't, and a frame of both would hide that. A frame that isn't shorter is left out."""
    if not len(x):
        return b""
    x = x.astype(np.int64)
    least = int(x.min())
    above = (x - least).view(U)
    planes = [p.tobytes() for p in above.view(np.uint8).reshape(-1, 8)[:, : (int(above.max()).bit_length() + 7) // 8].T]
    frames = [min(p, zstandard.compress(p, 1), key=len) for p in planes]
    return np.array([len(x), least], np.int64).tobytes() + b"".join(len(f).to_bytes(4, "little") + f for f in frames)


def _wide(block: bytes) -> np.ndarray:
    if not block:
        return np.zeros(0, np.int64)
    n, least = np.frombuffer(block, np.int64, 2)
    above, at, plane = np.zeros((n, 8), np.uint8), 16, 0
    while at < len(block):
        size, at = int.from_bytes(block[at : at + 4], "little"), at + 4
        frame = block[at : at + size]
        above[:, plane] = np.frombuffer(frame if size == n else zstandard.decompress(frame), np.uint8)
        at, plane = at + size, plane + 1
    return above.view(np.int64).ravel() + least


def _rising(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, and the steps."""
    return keys[:1].tobytes() + _small(np.diff(keys, prepend=keys[:1]))


def _risen(block: bytes) -> np.ndarray:
    if not block:
        return np.zeros(0, U)
    return np.cumsum(_wide(block[8:]).view(U), dtype=U) + np.frombuffer(block[:8], U)


def _slots(sizes: np.ndarray) -> np.ndarray:
    """Bits of the places of each page of a chunk. Pages stand there in falling order of size, each with a power of two
    of places, so that a place tells its page without the sizes of all: see ``_begun``."""
    return np.ceil(np.log2(sizes)).astype(np.int64)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    """The first place of each page, and the end."""
    return np.concatenate([[0], np.cumsum(np.int64(1) << _slots(sizes))])


def _begun(places: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The first place of the page of each place; ``slots``: how many pages have so many bits of places."""
    bits = np.arange(len(slots))[::-1]
    own = bits[np.searchsorted(np.cumsum(slots[::-1] << bits), places, "right")]
    return places >> own << own


def _voters(keys: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, where each key begins and the end, how many distinct voters it has)."""
    order = np.lexsort((votes, keys))
    k, v = keys[order], votes[order]
    at = runs(k)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    return order, at, np.add.reduceat(new & (v != 0), at[:-1]) if len(k) else np.zeros(0, np.int64)


def _dealt(chunk: int, keys, places, votes, sizes, head: list[bytes], buckets: int) -> list[tuple]:
    """Rows of PACK. A key that a chunk alone shows to be repeated goes to its bucket once, however many pages of the chunk have it."""
    slots = np.bincount(_slots(sizes))
    order, at, n = _voters(keys, _begun(places, slots) + 1 if votes is None else votes)
    sure = n >= PAGES
    settled = np.repeat(sure, np.diff(at))
    held, go = order[settled], order[~settled]
    known = keys[order[at[:-1]]][sure]
    out = [(int(bucket_of(mixed(np.array([chunk + 1], U)), buckets)[0]), chunk, True, _rising(keys[held]), _small(places[held]), b"", b"", b"", *head)]
    edges = (np.arange(buckets + 1, dtype=np.uint64) * U(1 << KEY) + U(buckets - 1)) // U(buckets)
    cut, known_cut = np.searchsorted(keys[go], edges), np.searchsorted(known, edges)
    for b in range(buckets):
        s, t = go[cut[b] : cut[b + 1]], known[known_cut[b] : known_cut[b + 1]]
        if len(s) or len(t):
            out.append((b, chunk, False, _rising(keys[s]), _small(places[s]), *((b"", squeeze(slots)) if votes is None else (_small(votes[s]), b"")), pack(t), b"", b"", b""))
    return out


def _packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), PACK)], schema=PACK)


def packed_runs(found: DataFrame, buckets: int) -> DataFrame:
    """The runs of all pages, dealt by host and hash."""

    def rows(batches):
        parts, n = [], 0

        def chunk():
            row, page, size, keys, places = zip(*sorted(parts, key=lambda p: -p[2]))
            first = _firsts(np.array(size))
            head = [_small(np.array(row)), _small(np.array(page)), _small(np.array(size))]
            return _packed(_dealt(row[0], np.concatenate(keys), np.concatenate([f + x for f, x in zip(first, places)]), None, np.array(size), head, buckets))

        for batch in batches:
            for row, host, page, texts in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "page", "blocks"))):
                if not texts:
                    continue
                _, w, place = block_words(texts)
                key, first = runs_of(w)
                block = w.row()[first]
                seed = U(0 if host is None else int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest(), "big") | 1)
                parts.append((row, page, int(place[-1]), mixed(key ^ seed) >> U(64 - KEY), place[block] + first - w.first[block]))
                n += len(key)
                if n >= CHUNK_RUNS:
                    yield chunk()
                    parts, n = [], 0
        if parts:
            yield chunk()

    return found.select("row", "host", "page", "blocks").mapInArrow(rows, PACK_ROWS)


def repeated_runs(packed: DataFrame) -> DataFrame:
    """The runs that have PAGES voters, as held rows."""

    def bucket(table: pa.Table) -> pa.Table:
        out = [tuple(r.values()) for r in table.filter(table.column("held")).to_pylist()]
        chunks, keys, places, votes, sure = [], [], [], [], []
        for r in table.filter(pa.compute.invert(table.column("held"))).to_pylist():
            chunks.append(r["chunk"])
            keys.append(_risen(r["keys"]))
            places.append(_wide(r["places"]))
            votes.append(mixed(_begun(places[-1], unsqueeze(r["slots"])).astype(U) + mixed(np.array([r["chunk"] + 1], U))).view(np.int64) if r["slots"] else _wide(r["votes"]))
            sure.append(unpack(r["sure"]))
        if chunks:
            k = np.concatenate(keys)
            order, at, n = _voters(k, np.concatenate(votes))
            distinct = k[order[at[:-1]]]
            common = np.union1d(distinct[n >= PAGES], np.concatenate(sure))
            for c, k, x in zip(chunks, keys, places):
                go = np.isin(k, common)
                if go.any():
                    out.append((0, c, True, _rising(k[go]), _small(x[go]), b"", b"", b"", b"", b"", b""))
        return pa.Table.from_batches([_packed(out)] if out else [], PACK)

    return packed.groupBy("bucket").applyInArrow(bucket, PACK_ROWS)


def _chunk(table: pa.Table):
    """(head, rows, ids, sizes, keys, pages, places, first place of each page in the chunk, covered places) of a chunk's repeated runs."""
    held = table.to_pylist()
    head = next([r["rows"], r["ids"], r["sizes"]] for r in held if r["rows"])
    rows, ids, sizes = map(_wide, head)
    keys, places = np.concatenate([_risen(r["keys"]) for r in held]), np.concatenate([_wide(r["places"]) for r in held])
    first = _firsts(sizes)
    change = np.bincount(places, minlength=first[-1] + RUN + 1) - np.bincount(places + RUN, minlength=first[-1] + RUN + 1)
    return head, rows, ids, sizes, keys, np.searchsorted(first, places, "right") - 1, places, first, np.cumsum(change)[: first[-1]] > 0


def votes_of(repeated: DataFrame, buckets: int, own: bool) -> DataFrame:
    """The repeated runs, dealt again with their pages' ids as voters; if ``own``, only of pages that repeated runs leave text of their own."""

    def chunk(table: pa.Table) -> pa.Table:
        head, rows, ids, sizes, keys, pages_, places, first, covered = _chunk(table)
        left = sizes - np.diff(np.concatenate([[0], np.cumsum(covered)])[first])
        voter = np.where((left >= np.maximum(RUN, OWN * sizes)) | (not own), np.where(ids == 0, 1, ids), 0)
        return pa.Table.from_batches([_packed(_dealt(table.column("chunk")[0].as_py(), keys, places, voter[pages_], sizes, head, buckets))], PACK)

    return repeated.groupBy("chunk").applyInArrow(chunk, PACK_ROWS)


def cuts(repeated: DataFrame) -> DataFrame:
    """(cut_row, cut): the covered places of each row that has any, as ascending starts and ends by turns."""
    schema = pa.schema([("cut_row", pa.int64()), ("cut", pa.list_(pa.int32()))])

    def chunk(table: pa.Table) -> pa.Table:
        _, rows, _, _, _, pages_, _, first, covered = _chunk(table)
        out = []
        for p in np.unique(pages_):
            own = np.concatenate([[False], covered[first[p] : first[p + 1]], [False]])
            out.append((int(rows[p]), np.flatnonzero(own[1:] != own[:-1]).astype(np.int32)))
        return pa.table([pa.array([r for r, _ in out], pa.int64()), pa.array([c for _, c in out], pa.list_(pa.int32()))], schema=schema)

    return repeated.groupBy("chunk").applyInArrow(chunk, "cut_row long, cut array<int>")


def left_of(texts: list[str], cut: list[int] | None) -> tuple[list[str], np.ndarray]:
    """(the blocks without the words at the cut places, how many words each has left)."""
    raw, w, place = block_words(texts)
    n = np.diff(w.first)
    if not cut:
        return texts, n
    gone = np.zeros(int(place[-1]) + 1, np.int64)
    gone[cut[::2]] += 1
    gone[cut[1::2]] -= 1
    block = w.row()
    stays = np.cumsum(gone)[place[block] + np.arange(len(block)) - w.first[block]] == 0
    out = []
    for i, text in enumerate(texts):
        a, b = w.first[i], w.first[i + 1]
        if not stays[a:b].all():
            text = " ".join(raw[w.start[j] : w.end[j]].tobytes().decode() for j in range(a, b) if stays[j])
        out.append(text)
    return out, np.bincount(block[stays], minlength=len(texts))


def text_of(texts: list[str], inside: list[bool], cut: list[int] | None) -> str:
    """What is left of an article or main element, unless the prose left outside outweighs it: then the mark was of a teaser, and all counts."""
    if cut or any(inside) and not all(inside):
        texts, n = left_of(texts, cut)
        inner = np.array(inside, bool)
        if inner.any() and n[inner].sum() >= n[~inner & (n >= RUN)].sum() and n[inner].any():
            texts = [t for t, i in zip(texts, inside) if i]
    return " ".join(t for t in texts if t)


def extract(pages_: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    found = parsed(pages_)
    buckets = bucket_count(found.sparkSession)
    by_row = materialised(repeated_runs(packed_runs(found, buckets)))
    by_page = materialised(repeated_runs(votes_of(by_row, buckets, False)))
    gone = materialised(cuts(repeated_runs(votes_of(by_page, buckets, True))))
    joined = found.join(small_or_shuffled(gone), F.col("row") == F.col("cut_row"), "left").select("page_id", "url", "blocks", "inside", "cut")

    def rows(batches):
        for batch in batches:
            texts = [text_of(t, i, c) for t, i, c in zip(*(batch.column(c).to_pylist() for c in ("blocks", "inside", "cut")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(rows, "page_id long, url string, text string").select("*", F.length("text").cast("long").alias("n_chars"))


def op7(spark, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir))
