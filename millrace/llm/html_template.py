"""Main text of web pages: a template of each host, deduced from equivalence classes of tokens, and its slots."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, mix, removed, string_buffer, table, text_chunks, unpack, written

#: Pieces of a page: a comment, an element whose content is not markup, a tag; text is what lies between.
_PIECE = re.compile(r"""<(?:!--.*?(?:-->|\Z)|((?i:script|style|noscript|textarea|template|iframe|svg))\b.*?(?:</(?i:\1)\s*>|\Z)|/?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[!?/a-zA-Z][^>]*+>)""", re.S)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_DIGITS = re.compile(r"[0-9]+")

# Fixed values of HTML, and of the names that page furniture usually has.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("html body article main p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre".split())
FURNITURE = frozenset("nav header footer aside form button select option menu dialog head title fieldset".split())
NAMES = frozenset("nav navbar navigation menu header masthead footer sidebar aside related recommended search form reply replies respond skip login signin signup toolbar overlay".split())
PARTS = frozenset("nav navbar menu footer sidebar ad ads adv advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing social breadcrumb breadcrumbs comment comments disqus pagination pager widget".split())
MAIN = frozenset("article main".split())

#: Tags of the template stand on at least this share of a host's distinct pages, and on two of them (one, if it has one).
SUPPORT = 0.05
#: Tokens of a class at least.
CLASS_TOKENS = 2
#: A text is of the template, or a slot's only text, on so many distinct pages and this share of the host's; in article
#: or main it takes more.  Texts are left to the slots if they would hold more than half of the host's text.
REPEATED, REPEATED_SHARE = 3, 0.5
REPEATED_INSIDE, REPEATED_SHARE_INSIDE = 5, 0.9
#: A slot outside article and main is furniture if it draws from few texts: this share of its pages, of so many.
POOL_SHARE, POOL_PAGES = 0.1, 20
#: A slot is furniture with a larger share of its characters in links, or in elements that are named as furniture.
LINKED, LINKED_INSIDE, NAMED = 0.5, 0.75, 0.5
#: Templates of this measured size at most go to the pages by broadcast, larger ones by a join on the host.
BROADCAST_BYTES = 32 << 20
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


@lru_cache(1 << 16)
def _id(parent: int, token: str) -> int:
    """64-bit number of a token at a path."""
    return int.from_bytes(hashlib.blake2b(f"{parent} {token}".encode(), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 15)
def _opened(parent: int, tag: str, marks: str) -> tuple[int, int]:
    """(path, token) of an element."""
    return _id(parent, f"{tag} {_DIGITS.sub('0', marks)}"), _id(parent, f"<{tag} {marks}")


@lru_cache(1 << 14)
def _tag(raw: str) -> tuple[str, bool, str, bool] | None:
    """(name, whether it closes, its class, id and role, whether these name furniture) of a tag."""
    name = _NAME.match(raw)
    if not name:
        return None
    tag, closes = name[1].lower(), raw.startswith("</")
    found = [(a.lower(), v.strip("\"'")) for a, v in _ATTRIBUTE.findall(raw)] if "=" in raw and not closes else []
    return tag, closes, " ".join(f"{a}={v.lower()}" for a, v in found), tag not in LEAF and any(_named(v) for _, v in found)


#: Tokens before and after each page; they put whole pages into one slot where there is no other template.
BEGIN, END = _id(0, "^"), _id(0, "$")


@lru_cache(1 << 14)
def _named(names: str) -> bool:
    """Whether a class, id or role names furniture: by a whole name, or a part between - and _."""
    for name in names.lower().split():
        if re.sub(r"^(?:site|page|global|top|main)[-_]", "", name) in NAMES or any(p in PARTS for p in re.split("[-_]+", name)):
            return True
    return False


class _Open:
    """The open elements of a page, the places of each tag among them, and how many are furniture by their names.

    Each is opened and closed once, whatever the depth.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.bad = 0

    def path(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def pop(self) -> int:
        tag, bad, path = self.stack.pop()
        self.places[tag].pop()
        self.bad -= bad
        return path

    def inside(self) -> bool:
        return bool(self.places["article"] or self.places["main"])

    def close(self, tag: str) -> int:
        """The closing token; a closing tag without its opening one closes nothing."""
        own = self.places[tag]
        if own and not (tag in ("p", "li", "a") and any(self.places[t] and self.places[t][-1] > own[-1] for t in (*MAIN, "body"))):
            for _ in range(len(self.stack) - own[-1]):
                path = self.pop()
            return _id(path, "/")
        return _id(self.path(), "/" + tag)

    def open(self, tag: str, marks: str, bad: bool) -> int:
        """The opening token; a paragraph, list item or cell closes the one that is open in the same parent."""
        if tag in ("p", "li", "td", "tr", "option") and self.stack and self.stack[-1][0] == tag:
            self.pop()
        path, token = _opened(self.path(), tag, marks)
        if tag not in VOID:
            self.places[tag].append(len(self.stack))
            self.stack.append((tag, bad, path))
            self.bad += bad
        return token


def tokens(page: str) -> Iterator[tuple[int, str, int, bool, bool]]:
    """(token, text, characters in links, named as furniture, inside article or main) in page order; tags have no text.

    A tag is told by its class, id and role, and its path: the open elements with theirs (any number in these is 0).
    A text is all between two tags that are not inline, decoded, white space as one space; comments and scripts
    give nothing.
    """
    yield BEGIN, "", 0, False, False
    held, at, parts, linked = _Open(), 0, [], 0
    links = held.places["a"]
    for m in (*_PIECE.finditer(page), None):
        start = m.start() if m else len(page)
        if start > at:
            text = page[at:start]
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
        known = None
        if m:
            at = m.end()
            if m[1]:
                continue
            known = ("a", False, "", False) if m[0].startswith("<a ") else _tag(m[0])
            if not known:
                continue
            if known[0] in INLINE:
                if known[0] == "a":
                    held.close("a") if known[1] else held.open("a", "", False)
                continue
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                print_ = hashlib.blake2b(joined.encode(), digest_size=8, salt=held.path().to_bytes(8, "little", signed=True))
                yield int.from_bytes(print_.digest(), "little", signed=True), joined, linked, held.bad > 0, held.inside()
            parts, linked = [], 0
        if not known:
            continue
        tag, closes, marks, bad = known
        if closes:
            yield held.close(tag), "", 0, False, False
        else:
            yield held.open(tag, marks, bad or tag in FURNITURE and not (tag == "header" and held.inside())), "", 0, False, False
    yield END, "", 0, False, False


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in text_chunks(batches, "html"):
        data, ends, starts = string_buffer(batch.column("html"))
        data = data.tobytes()
        yield batch, [data[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]


#: Bits of the characters, and of those in links, in the number that says what a token is; two flags stand below them.
_BITS = 30


def _said(text: str, linked: int, named: bool, inside: bool) -> int:
    """A token's text as a number: characters (tags have none), those in links, named as furniture, inside."""
    return len(text) << (_BITS + 2) | linked << 2 | named << 1 | inside


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, its tokens, what _said() of each, and a hash of each text; row_ tells distinct pages, as copies have the same tokens."""
    for batch, pages in _pages(batches):
        done: dict[tuple[int, int], tuple] = {}
        for site, page in zip(batch.column("site").to_pylist(), pages):
            found = list(tokens(page))
            seq = np.array([t[0] for t in found], np.int64)
            row = int.from_bytes(hashlib.blake2b(seq.tobytes(), digest_size=8).digest(), "little", signed=True)
            if (site, row) not in done:
                prints = np.array([_id(0, t[1]) for t in found if t[1]], np.int64)
                done[site, row] = seq, np.array([_said(*t[1:]) for t in found], np.int64), prints
        own = list(done.values())
        yield pa.record_batch([*(pa.array([k[i] for k in done], pa.int64()) for i in (0, 1)), *(binaries(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in own)]), [len(x[i]) for x in own]) for i in range(3))], names=["site", "row_", "seq", "said", "prints"])


def _parsed(pages: DataFrame) -> DataFrame:
    """The distinct pages of each host, parsed once."""
    rows = pages.mapInArrow(_parse, "site long, row_ long, seq binary, said binary, prints binary")
    return rows.groupBy("site", "row_").agg(*(F.first(c).alias(c) for c in ("seq", "said", "prints")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pages of a batch for each token of a host: see _vectors()."""
    for batch in batches:
        (seq, n), (said, _) = unpack(batch.column("seq"), np.int64), unpack(batch.column("said"), np.int64)
        if not len(seq):
            continue
        page = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((seq, page))
        seq, said, page = seq[order], said[order], page[order]
        start = np.flatnonzero(np.append(True, (seq[1:] != seq[:-1]) | (page[1:] != page[:-1])))
        times = np.diff(np.append(start, len(seq)))
        inside = np.minimum.reduceat(said & 1, start)
        token, page, chars = seq[start], page[start], said[start] >> (_BITS + 2)
        site, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("site", "row_"))
        h = mix(row.astype(np.uint64)[page] + mix(times.astype(np.uint64)))
        order = np.lexsort((token, site[page]))
        token, own = token[order], site[page][order]
        start = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])))
        total = lambda x: np.add.reduceat(x[order].astype(np.int64), start)
        yield pa.record_batch([pa.array(x) for x in (own[start], token[start], np.diff(np.append(start, len(token))), total(times), np.where(chars[order][start] > 0, chars[order][start], -1), np.minimum.reduceat(inside[order], start) > 0, total(h >> np.uint64(32)), total(h & np.uint64(0xFFFFFFFF)))], names=["site", "token", "pages", "times", "chars", "inside", "v0", "v1"])


def _vectors(parsed: DataFrame) -> DataFrame:
    """Of each token of a host: its pages, its number there, its characters (tags: -1), whether always inside, and the
    fingerprint of its occurrence vector.

    The vector of a token is how often it stands on each distinct page; its fingerprint is a sum of hashes of
    (page, count), upper and lower half, so vectors are compared without gathering them.
    """
    seen = parsed.select("site", "row_", "seq", "said").mapInArrow(_count, "site long, token long, pages long, times long, chars long, inside boolean, v0 long, v1 long")
    return seen.groupBy("site", "token").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.max("chars").alias("chars"), F.min("inside").alias("inside"), F.struct(F.sum("v0"), F.sum("v1")).alias("vector"))


def candidate_classes(vectors: DataFrame) -> DataFrame:
    """(site, classes, text): tokens of equal occurrence vectors, and characters of all texts of the host."""
    total = vectors.groupBy("site").agg(F.max("pages").alias("all"), F.sum(F.when(F.col("chars") > 0, F.col("chars") * F.col("times"))).alias("text"))
    text, share = F.col("chars") > 0, F.col("pages") / F.col("all")
    steady = (F.col("pages") >= F.when(F.col("inside"), REPEATED_INSIDE).otherwise(REPEATED)) & (share >= F.when(F.col("inside"), REPEATED_SHARE_INSIDE).otherwise(REPEATED_SHARE))
    tags = (F.col("pages") >= F.least(F.lit(2), F.col("all"))) & (share >= SUPPORT)
    total = written(total)
    kept = _beside(vectors, total, "all", "text").where(F.when(text, steady).otherwise(tags))
    kept = kept.groupBy("site", "vector", "pages").agg(F.collect_list("token").alias("tags"), F.collect_list(F.when(text, F.col("token"))).alias("texts"), F.coalesce(F.sum(F.when(text, F.col("chars") * F.col("times"))), F.lit(0)).alias("held"), F.first("text").alias("text"))
    # The whole size: a class that needs its texts to be large enough counts them, too.
    kept = kept.where(F.size("tags") >= CLASS_TOKENS)
    kept = written(kept.groupBy("site").agg(F.collect_list(F.struct("tags", "texts", "held")).alias("classes"), F.max("text").alias("text")))
    removed(total)
    return kept


def _candidates(classes: list[dict], text: int | None) -> dict[int, int]:
    """Token -> class, without the texts if these would hold more than half of the host's text."""
    classes = sorted(classes, key=lambda c: min(c["tags"]))
    drop = 2 * sum(c["held"] for c in classes) > (text or 0)
    out: dict[int, int] = {}
    for i, c in enumerate(classes):
        own = set(c["tags"]) - (set(c["texts"]) if drop else set())
        if len(own) >= CLASS_TOKENS:
            out |= dict.fromkeys(own, i)
    return out


def check_page(sequence: list[int], known: dict[int, int], size: dict[int, int], ranks: dict[int, list[int]], crossed: set) -> None:
    """Adds what a page says on order and nesting: the least and greatest rank of each token among those of its class,
    and (token, class): the token stands within an instance of the class that opened after the token's own."""
    seen: dict[int, int] = defaultdict(int)
    held: list[int] = []  # classes of the open instances, in the order of their first tokens
    for token in sequence:
        c = known.get(token)
        if c is None:
            continue
        rank = seen[c] % size[c]
        seen[c] += 1
        own = ranks.setdefault(token, [rank, rank])
        own[0], own[1] = min(own[0], rank), max(own[1], rank)
        if rank:
            for other in reversed(held):
                if other == c:
                    break
                crossed.add((token, other))
        else:
            held.append(c)
        if rank == size[c] - 1:
            del held[next(k for k in range(len(held) - 1, -1, -1) if held[k] == c)]


def _pairs(packed: bytes | None) -> dict[int, int]:
    flat = np.frombuffer(packed or b"", np.int64).tolist()
    return dict(zip(flat[::2], flat[1::2]))


def _packed(rows: list[dict[int, int]]) -> pa.Array:
    return binaries(np.array([v for r in rows for kv in r.items() for v in kv], np.int64), [2 * len(r) for r in rows])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("site"), _packed([_candidates(c, t) for c, t in zip(batch.column("classes").to_pylist(), batch.column("text").to_pylist())])], names=["site", "known"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host in a batch: ranks lo to hi of token a (b null), or token a within class b."""
    for batch in batches:
        sums: dict[int, tuple] = {}
        for site, packed, seq in zip(*(batch.column(c).to_pylist() for c in ("site", "known", "seq"))):
            if site not in sums:
                known = _pairs(packed)
                sums[site] = known, Counter(known.values()), {}, set()
            check_page(np.frombuffer(seq, np.int64).tolist(), *sums[site])
        rows = [(s, t, None, *r) for s, (_, _, ranks, _) in sums.items() for t, r in ranks.items()] + [(s, a, b, None, None) for s, (_, _, _, x) in sums.items() for a, b in x]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["site", "a", "b", "lo", "hi"])


#: What a template token does: begins its class, goes on with it, ends it.
FIRST, INNER, LAST = 0, 1, 2


def valid_template(known: dict[int, int], ranks: dict[int, tuple[int, int]], crossed: set[tuple[int, int]]) -> dict[int, int]:
    """The tokens of all valid classes, and what each does.

    A class keeps the tokens that have the same rank on all pages, and is valid with CLASS_TOKENS of them or more.
    Where tokens of a class stand within instances of another that opened after theirs, the other class goes if it has
    no more tokens, else only these tokens.  The class of BEGIN and END opens first on every page and keeps both, so it
    always stays, around all texts.
    """
    members: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for token, c in known.items():
        lo, hi = ranks.get(token, (0, 1))
        if lo == hi:
            members[c].append((lo, token))
    members = {c: own for c, own in members.items() if len(own) >= CLASS_TOKENS}
    within: dict[tuple[int, int], set[int]] = defaultdict(set)
    for token, other in crossed:
        if ranks[token][0] == ranks[token][1] and known[token] in members and other in members:
            within[known[token], other].add(token)
    gone: set[int] = set()
    for (c, other), own in within.items():
        gone |= {t for _, t in members[other]} if len(members[other]) <= len(members[c]) else own
    out: dict[int, int] = {}
    for own in members.values():
        own = sorted(m for m in own if m[1] not in gone)
        if len(own) >= CLASS_TOKENS:
            out |= {token: FIRST if k == 0 else LAST if k == len(own) - 1 else INNER for k, (_, token) in enumerate(own)}
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for known, found in zip(batch.column("known").to_pylist(), batch.column("found").to_pylist()):
            rows.append(valid_template(_pairs(known), {r["a"]: (r["lo"], r["hi"]) for r in found if r["b"] is None}, {(r["a"], r["b"]) for r in found if r["b"] is not None}))
        yield pa.record_batch([batch.column("site"), _packed(rows)], names=["site", "template"])


def templates(parsed: DataFrame) -> DataFrame:
    """(site, template): packed pairs (token, FIRST, INNER or LAST) of each host's valid classes, from its _parsed() pages.

    Candidates are the classes of equal occurrence vectors; a look at all pages then tests order and nesting.  As
    tags of a template are on at least SUPPORT of a host's pages and texts on more, they are at most 1 / SUPPORT
    times the distinct tokens of a mean page, so a host's template fits a task.
    """
    vectors = written(_vectors(parsed))
    classes = candidate_classes(vectors)
    known = written(classes.mapInArrow(_known, "site long, known binary"))
    removed(vectors, classes)
    found = _beside(parsed.select("site", "seq"), known, "known").mapInArrow(_check, "site long, a long, b long, lo long, hi long")
    found = found.groupBy("site", "a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("site").agg(F.collect_list(F.struct("a", "b", "lo", "hi")).alias("found"))
    out = written(known.join(found, "site").mapInArrow(_settle, "site long, template binary"))
    removed(known)
    return out


def _beside(pages: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """Rows with the columns of their host; side, a written table, is broadcast if its measured size allows it."""
    size = side.agg(F.sum(sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns) + 64)).first()[0] or 0
    return pages.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "site", "left")


def slots(found: list[tuple], template: dict[int, int]) -> Iterator[tuple]:
    """(slot, *what else the tuple of a token says) of every text that is not of the template; the second says whether it is a text.

    A slot is named by the template token that it follows; after the last token of a nested class it is that of
    the class around it again.  The class of BEGIN and END is around all texts, so each is in a slot.
    """
    held: list[int] = []
    for token, *more in found:
        does = template.get(token)
        if does is None:
            if more[0]:
                yield held[-1], *more
        elif does == FIRST:
            held.append(token)
        elif does == LAST:
            held.pop()
        else:
            held[-1] = token


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each slot of each distinct page: characters, those in links, named, inside; a fingerprint of the texts."""
    for batch in batches:
        templates, rows = {}, []
        for site, row, packed, *page in zip(*(batch.column(c).to_pylist() for c in ("site", "row_", "template", "seq", "said", "prints"))):
            if site not in templates:
                templates[site] = _pairs(packed)
            seq, said, prints = (np.frombuffer(x, np.int64) for x in page)
            own = np.zeros(len(seq), np.int64)
            own[said >> (_BITS + 2) > 0] = prints
            sums: dict[int, list] = {}
            for slot, said, text in slots(list(zip(seq.tolist(), said.tolist(), own.tolist())), templates[site]):
                x, chars = sums.setdefault(slot, [0, 0, 0, 0, 0]), said >> (_BITS + 2)
                x[0] += chars
                x[1] += said >> 2 & (1 << _BITS) - 1
                x[2] += chars * (said >> 1 & 1)
                x[3] += chars * (said & 1)
                x[4] = _id(x[4], str(text))
            rows += [(site, row, slot, *x) for slot, x in sums.items()]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(8)], names=_SUMS)


_SUMS = ["site", "row_", "slot", "chars", "linked", "named", "inside", "print"]


def judge(parsed: DataFrame) -> DataFrame:
    """(site, bad): the slots of each host that are not main text, packed; parsed pages have their host's template.

    Bad is a slot that holds mostly links; one with the same text on all of several pages; one outside article and
    main that draws many pages' texts from few; one most of whose text stands in elements named as furniture; and,
    where a host has no other page to tell by, one outside article and main, if these hold half of its text.  If all that would leave a host nothing, only links count.
    """
    seen = written(parsed.mapInArrow(_sum, ", ".join(f"{c} long" for c in _SUMS)))
    texts = seen.groupBy("site", "slot", "print").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("chars", "linked", "named", "inside")))
    sums = texts.groupBy("site", "slot").agg(F.count("*").alias("texts"), *(F.sum(c).alias(c) for c in ("n", "chars", "linked", "named", "inside")))
    total = seen.groupBy("site", "row_").agg(F.sum("chars").alias("c"), F.sum("inside").alias("i")).groupBy("site").agg(F.count("*").alias("all"), (2 * F.sum("i") >= F.sum("c")).alias("mostly"))
    inside = 2 * F.col("inside") > F.col("chars")
    by_prior = lambda out, own: F.when(inside, own).otherwise(out)
    linked = F.col("linked") > F.col("chars") * by_prior(LINKED, LINKED_INSIDE)
    same = (F.col("texts") == 1) & (F.col("n") >= by_prior(REPEATED, REPEATED_INSIDE)) & (F.col("n") >= F.col("all") * by_prior(REPEATED_SHARE, REPEATED_SHARE_INSIDE))
    pool = ~inside & (F.col("n") >= POOL_PAGES) & (F.col("texts") <= F.col("n") * POOL_SHARE)
    named = F.col("named") > F.col("chars") * NAMED
    alone = ~inside & (F.col("all") == 1) & F.col("mostly")
    total = written(total)
    judged = _beside(sums, total, "all").select("site", "slot", linked.alias("linked"), (linked | same | pool | named | alone).alias("bad"))
    judged = judged.groupBy("site").agg(F.collect_list(F.when(F.col("linked"), F.col("slot"))).alias("linked"), F.collect_list(F.when(F.col("bad"), F.col("slot"))).alias("bad"), F.min("bad").alias("none"))
    out = written(judged.select("site", F.when(F.col("none"), F.col("linked")).otherwise(F.col("bad")).alias("bad")).mapInArrow(_pack_bad, "site long, bad binary"))
    removed(seen, total)
    return out


def _pack_bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("bad").to_pylist()
        yield pa.record_batch([batch.column("site"), binaries(np.array([v for r in rows for v in r], np.int64), [len(r) for r in rows])], names=["site", "bad"])


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in _pages(batches):
        own: dict[int, tuple] = {}
        out = []
        for site, packed, bad, page in zip(*(batch.column(k).to_pylist() for k in ("site", "template", "bad")), pages):
            if site not in own:
                own[site] = _pairs(packed), frozenset(np.frombuffer(bad or b"", np.int64).tolist())
            template, bad = own[site]
            out.append(" ".join(text for slot, text, *_ in slots(tokens(page), template) if slot not in bad))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html), extra columns ignored.

    A null html is empty; a page without main text gives ''; a null url counts as the host ''; repeated rows stay,
    and copies of a page count once in all that is judged.  Each host's template is deduced from all its pages
    (templates()), and what is not of the template fills slots, which are judged by their texts on all pages
    (judge()).  The text of a page is that of its good slots; each text that is not of the template is in one, and
    nothing within a slot is dropped.  Names of tags,
    classes and ids count only as shares of a slot's text, article and main elements as a prior.  Pages of a large
    host are spread over tasks: only counts and sums are grouped by host.
    """
    site = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), site.alias("site"))
    parsed = written(_parsed(own.select("site", "html")))
    found = templates(parsed)
    bad = judge(_beside(parsed, found, "template"))
    side = written(found.join(bad, "site", "left"))
    removed(parsed, found, bad)
    kind = own.schema["page_id"].dataType.simpleString()
    return _beside(own, side, "template", "bad").mapInArrow(_text, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html": op3_html}
ORACLE: dict[str, str] = {}
