"""Main text of web pages by nearest-URL page differencing, with element roles as a second check.

Pages are parsed into their visible lines, one for each block.  The lines of a
page are aligned with those of the pages nearest to it by URL path on its
host, by longest common subsequence; lines that its neighbours share are the
site's and go.  Several neighbours vote, so that a copy of the page among them
can't take the article with it, and where the vote would take most of an
article, or all but a little of a page without one, the neighbours are copies
and nothing of it goes.  Lines in menus, headers, footers, sidebars, notices,
adverts, forms and comment sections that no neighbour shares (menus and
notices made for one page, or a page alone on its host) go by the roles of
their elements.

Of the pages of a host that have the same lines one stands for all.  A range
partitioning of (host, path) gives every page its rank; pages meet
their neighbours in blocks of ranks, each block with a few pages of the next
ones, however many pages one host has.  Only line hashes travel.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.session import bound_batches, cut

#: Elements that never hold text of a page, that hold boilerplate, those of them that never hold all that a page has, that bound blocks, and that hold a page's own text.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea button title head".split())
BOILER = frozenset("nav header footer aside form menu dialog figcaption".split())
LINKS = frozenset("nav footer menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()) | BOILER
BODY = frozenset(("article", "main"))
#: Words that mark boilerplate as a class, id or role, words that may follow one in a name, and words that undo it.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies footer header menu nav navbar navigation newsletter notice notices popup promo reply replies related share sharing sidebar social sponsor sponsored subscribe widget".split())
PLACES = frozenset("area bar block body bottom box col column container content group inner left links list main menu outer panel primary right secondary section top widget wrap wrapper".split())
UNDONE = frozenset("has is no not with without".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"(?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))|=)*+>")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
#: Elements that a following block closes, as in HTML: p at any block, li, dt, dd, tr, td, th and option at their like.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Pages that a page is compared with at most, pages to either side that they are chosen from, and ranks of a block.
NEIGHBOURS, REACH, BLOCK_PAGES = 4, 4, 512
#: Pages that lose a line up to which their lists are broadcast.
BROADCAST_PAGES = 100_000
#: Parts of the text of an article, and of a page without one, that must stay; less and the neighbours are copies.
ARTICLE_STAYS, PAGE_STAYS = 0.5, 0.1


def _marked(attributes: str) -> bool:
    """Whether a name among class, id and role is a mark, or a mark with the word of a place after it or any word before it that doesn't undo it."""
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if words and words[0] not in UNDONE and (words[-1] in MARKS or words[0] in MARKS and all(w in PLACES for w in words[1:])):
                return True
    return False


def _tag_end(page: str, at: int) -> int:
    """Index of the > that ends the tag whose attributes start at ``at``; a quote opens a value only after =, and one that nothing closes well ends at the next >."""
    well = _ATTRIBUTES.match(page, at)
    if well:
        return well.end() - 1
    i = at
    while m := _QUOTE_OR_END.search(page, i):
        if m[0] == ">":
            return m.start()
        if page[i : m.start()].rstrip()[-1:] == "=":
            close = page.find(m[0], m.end())
            if close < 0 or not (page[close + 1 : close + 2].isspace() or page[close + 1 : close + 2] in ("/", ">", "")):
                end = page.find(">", m.end())
                return end if end >= 0 else len(page)
            i = close + 1
        else:
            i = m.end()
    return len(page)


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, is boilerplate by its role, is in an article) of each visible block of a page, in page order.

    Where an article or main element holds most of the text that no role
    claims, what lies outside is boilerplate by its role.  Roles are hints: an
    element loses its own where it holds the only article, a form of a page
    without one where it holds more text than lies free, and another, but for
    menus and footers, where it holds half of the page and nothing lies free.
    Class, id and role names are not heeded where they would leave a page with
    text without any.
    """
    page = page or ""
    found: list[tuple[str, tuple, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, is boilerplate by element, is by a name
    claims: list[int] = []  # open elements that are boilerplate
    kinds: list[tuple[str, bool]] = []  # of every such element: name, lies in no article
    open_: defaultdict[str, int] = defaultdict(int)
    text: list[str] = []
    names = bodies = at = 0

    def end_block():
        joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if joined:
            found.append((joined, tuple(claims), names > 0, bodies > 0))

    def pop() -> str:
        nonlocal names, bodies
        name, role, named = stack.pop()
        open_[name] -= 1
        names, bodies = names - named, bodies - (name in BODY)
        if role:
            claims.pop()
        return name

    while at < len(page):
        lt = page.find("<", at)
        text.append(page[at : lt if lt >= 0 else len(page)])
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[lt + 1 : lt + 2] in ("!", "?") and lt + 1 < len(page):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        closing = page[lt + 1 : lt + 2] == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        name, end = m[0].lower(), _tag_end(page, m.end())
        attributes, at = page[m.end() : end], end + 1
        if closing:
            if open_[name]:
                if name in BLOCKS:
                    end_block()
                if name in BLOCKS or stack[-1][0] == name:
                    while pop() != name:
                        pass
            elif name == "p":
                end_block()
            continue
        if name in SILENT:
            if not attributes.rstrip().endswith("/") and name != "embed":
                if name == "head":
                    end_block()
                close = _CLOSE[name].search(page, at)
                at = close.end() if close else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS:
            end_block()
            if name == "hr":
                continue
            if open_["p"]:
                while pop() != "p":
                    pass
            shut = _IMPLIED.get(name, ())
            while stack and stack[-1][0] in shut:
                pop()
        role = name in BOILER and not (bodies and name in ("header", "figcaption"))
        named = bool(attributes) and name not in ("body", "html", *BODY) and _marked(attributes)
        stack.append((name, role, named))
        open_[name] += 1
        if role:
            claims.append(len(kinds))
            kinds.append((name, not bodies))
        names, bodies = names + named, bodies + (name in BODY)
    end_block()
    void = _undone(found, kinds)
    lines = [(t, any(c not in void for c in own), named, inside) for t, own, named, inside in found]
    within = sum(len(t) for t, role, named, inside in lines if inside and not role and not named)
    free = sum(len(t) for t, role, named, inside in lines if not inside and not role and not named)
    article = within > 0 and within >= free
    heeded = within + free > 0
    return [(t, role or named and heeded or article and not inside, inside) for t, role, named, inside in lines]


def _undone(found: list[tuple[str, tuple, bool, bool]], kinds: list[tuple[str, bool]]) -> set[int]:
    """Elements whose role as boilerplate does not hold, of lines (text, elements that claim it, is named boilerplate, is in an article)."""
    if all(not own for _, own, _, _ in found):
        return set()
    void: set[int] = set()
    articles = [own for _, own, named, inside in found if inside and not named and all(kinds[c][1] for c in own)]
    if articles and all(articles):
        void.update(c for own in articles for c in own if kinds[c][0] not in LINKS)
    alone: defaultdict[int, int] = defaultdict(int)  # text that one element alone claims
    free = 0
    for text, own, named, _ in found:
        left = [c for c in own if c not in void]
        if not named and not left:
            free += len(text)
        elif not named and len(left) == 1:
            alone[left[0]] += len(text)
    forms = [] if articles else [c for c in alone if kinds[c][0] == "form" and alone[c] > free]
    if forms:
        void.add(max(forms, key=lambda c: (alone[c], -c)))
    elif not free:
        most = max((c for c in alone if kinds[c][0] not in LINKS), key=lambda c: (alone[c], -c), default=None)
        if most is not None and 2 * alone[most] >= sum(len(t) for t, _, _, _ in found):
            void.add(most)
    return void


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common lengths of ``a`` with each beginning of ``b``, by additions of bit sets of places in ``b``."""
    order = np.argsort(b, kind="stable")
    names, first = np.unique(b[order], return_index=True)
    spans = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(b)])))
    kept: dict[int, int] = {}

    def places(x: int) -> int:
        lo, hi = spans[x]
        if x in kept:
            return kept[x]
        if hi - lo < 16:
            return sum(1 << j for j in order[lo:hi].tolist())
        bits = np.zeros(len(b), np.uint8)
        bits[order[lo:hi]] = 1
        kept[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return kept[x]

    full = free = (1 << len(b)) - 1  # a place stays free until it adds to the length
    for x in a.tolist():
        if x in spans:
            hit = free & places(x)
            free = ((free + hit) | (free - hit)) & full
    bits = np.unpackbits(np.frombuffer(free.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _split(a: np.ndarray, b: np.ndarray, base: int, out: list[int]) -> None:
    """Adds to ``out`` the places in ``a`` of a longest common subsequence, halving ``a`` so that memory stays linear."""
    a_in = np.flatnonzero(np.isin(a, b))
    if not len(a_in):
        return
    if len(a_in) == 1:
        out.append(base + int(a_in[0]))
        return
    b = b[np.isin(b, a)]
    lo, hi = a_in[: len(a_in) // 2], a_in[len(a_in) // 2 :]
    cut_at = int((_lengths(a[lo], b) + _lengths(a[hi[::-1]], b[::-1])[::-1]).argmax())
    middle = int(hi[0])
    _split(a[:middle], b[:cut_at], base, out)
    _split(a[middle:], b[cut_at:], base + middle, out)


def shared_lines(a: np.ndarray, b: np.ndarray, matches: int = 200_000) -> np.ndarray:
    """Which items of ``a`` lie on a longest common subsequence of ``a`` and ``b``.

    Up to ``matches`` equal pairs are chained by increasing places, more by
    halving; memory is linear in the lines in either case.
    """
    common = np.zeros(len(a), bool)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    common[:n] = True
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    common[len(a) - m :] = True
    a, b = a[n : len(a) - m], b[n : len(b) - m]
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    if sum(len(places.get(x, ())) for x in a.tolist()) > matches:
        out: list[int] = []
        _split(a, b, n, out)
        common[out] = True
        return common
    tails: list[int] = []  # the least place in b that ends a chain of each length
    chains: list[tuple[int, tuple | None]] = []  # that chain's places in a, last first
    for i, x in enumerate(a.tolist()):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(chain)
            elif j < tails[k]:
                tails[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        common[n + chain[0]] = True
        chain = chain[1]
    return common


def _common(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared_with(own: dict, others: list[tuple[int, dict]]) -> np.ndarray:
    """Which lines of a page its neighbours make boilerplate.

    ``own`` and the pages of ``others``, each with its distance in rank, have
    path, hashes, chars (of each line), and kinds (1: in an article, 2:
    boilerplate by its role).  Pages of the same lines are passed over; the
    nearest ``NEIGHBOURS`` of the rest by path, then by distance, vote, and all
    but one must share a line (both of two, the only one).
    """
    mine = own["hashes"]
    others = [(d, o) for d, o in others if len(o["hashes"]) != len(mine) or (o["hashes"] != mine).any()]
    others.sort(key=lambda x: (-_common(own["path"], x[1]["path"]), abs(x[0]), x[0]))
    masks = [shared_lines(mine, o["hashes"]) for _, o in others[:NEIGHBOURS]]
    if not masks:
        return np.zeros(len(mine), bool)
    gone = np.sum(masks, 0) >= (len(masks) if len(masks) < 3 else len(masks) - 1)
    content = own["kinds"] < 2
    inside = content & (own["kinds"] == 1)
    for part, least in ((inside, ARTICLE_STAYS), (content & ~inside, PAGE_STAYS)):
        if own["chars"][part & ~gone].sum() < least * own["chars"][part].sum():
            gone = gone & ~part
    return gone


def _neighbourhoods(keys: DataFrame) -> DataFrame:
    """Rows (host, path, id, ...) ranked by them, as (block, rank, own, ...): each in its block of ranks, and as a guest in a block that it lies within ``REACH`` of."""
    spark = keys.sparkSession
    index = F.monotonically_increasing_id()
    placed = cut(keys.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id").withColumn("part", F.shiftright(index, 33)).withColumn("at", index.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted(placed.groupBy("part").count().collect())  # one row a partition
    first, before = [], 0
    for part, n in sizes:
        first.append((part, before))
        before += n
    offsets = spark.createDataFrame(first, "part long, before long")
    rank = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before")  # one row a partition
    near = F.array_distinct(F.array(*[F.floor((F.col("rank") + d) / BLOCK_PAGES).cast("long") for d in (0, -REACH, REACH)]))
    return rank.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == F.floor(F.col("rank") / BLOCK_PAGES))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that neighbours share) and n_role (others that went by their role), one row per page.

    Blocks are joined by two line feeds in page order, white space inside one
    is one space.  Null and empty pages, and pages of markup alone, have an
    empty text.  Null URLs form a host of their own; of equally near pages the
    one before in order of URL and content comes first; rows repeated in full
    get equal results; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(pages.sparkSession, 500)
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("id", F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))

    def hash_lines(batches):
        for batch in batches:
            every = [lines(p) for p in batch.column("html").to_pylist()]
            h = [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 1) >> 1 for t, _, _ in page] for page in every]
            chars = [[len(t) for t, _, _ in page] for page in every]
            kinds = [[2 if role else int(inside) for _, role, inside in page] for page in every]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(h, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int8()))], ["id", "url", "hashes", "chars", "kinds"])

    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1), "(/|\\.html?)$", "")
    keys = own.select("id", "url", "html").mapInArrow(hash_lines, "id long, url string, hashes array<long>, chars array<int>, kinds array<tinyint>")
    keys = keys.filter(F.size("hashes") > 0).select(host.alias("host"), path.alias("path"), "id", F.xxhash64("hashes", F.lit(1)).alias("same"), F.xxhash64("hashes", F.lit(2)).alias("same2"), "hashes", "chars", "kinds")
    keys = cut(keys)
    # of the pages of a host that have the same lines one is ranked, and its result is that of all
    every = keys.select("host", "same", "same2", "path", "id")
    least = every.groupBy("host", "same", "same2").agg(F.min(F.struct("path", "id")).alias("rep")).select("host", "same", "same2", F.col("rep.id").alias("rep"))
    members = every.join(least, ["host", "same", "same2"]).select("id", "rep").distinct()
    keys = keys.join(members.filter("id = rep"), "id", "left_semi").select("host", "path", "id", "hashes", "chars", "kinds")

    def compare(batches):
        block: list[dict] = []
        number = None

        def decide():
            ids, gone = [], []
            for i, r in enumerate(block):
                if not r["own"]:
                    continue
                near = [(block[j]["rank"] - r["rank"], block[j]) for j in range(max(0, i - REACH), min(len(block), i + REACH + 1)) if j != i and block[j]["host"] == r["host"]]
                mask = shared_with(r, near)
                if mask.any():
                    ids.append(r["id"])
                    gone.append(np.flatnonzero(mask).tolist())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["id", "gone"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != number:
                    if block:
                        yield decide()
                    block, number = [], r["block"]
                if block and block[-1]["id"] == r["id"]:  # a repeated row
                    block[-1]["own"] |= r["own"]
                    continue
                block.append(r | {c: np.array(r[c], np.int64) for c in ("hashes", "chars", "kinds")})
        if block:
            yield decide()

    near = _neighbourhoods(keys).repartition("block").sortWithinPartitions("block", "rank")
    decided = near.mapInArrow(compare, "id long, gone array<int>").groupBy("id").agg(F.min("gone").alias("gone"))
    decided = cut(members.join(decided.withColumnRenamed("id", "rep"), "rep").select("id", "gone"))
    rows, items = decided.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if rows <= BROADCAST_PAGES and items <= 16 * BROADCAST_PAGES:  # few pages lose a line: pages stay where they are
        decided = F.broadcast(decided)

    def write(batches):
        for batch in batches:
            texts, shared, roles = [], [], []
            for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
                skip, every = set(gone or ()), lines(page)
                texts.append("\n\n".join([t for i, (t, role, _) in enumerate(every) if i not in skip and not role]))
                shared.append(len(skip))
                roles.append(sum(role and i not in skip for i, (_, role, _) in enumerate(every)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shared, pa.int64()), pa.array(roles, pa.int64())], ["page_id", "url", "text", "n_chars", "n_shared", "n_role"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return own.join(decided, "id", "left").select("page_id", "url", "html", "gone").mapInArrow(write, f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_role long")
