"""Suffix-array deduplication of bytes: longest previous factors across documents.

Every 50-byte string contains an anchor, the 24-byte string of smallest hash inside it, at a
place that depends on its bytes alone.  Equal strings have equal anchors, so only suffixes
that begin near equal anchors need to be sorted together: anchors that stand in several
texts are found by hash, the bytes around them are gathered by hash, and in each bucket the
suffixes are sorted.  In suffix order the nearest entries before and after with a smaller
document give each suffix its longest previous factor; where that reaches 50 bytes, the
string has occurred in an earlier document and its later copy is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.llm.chunks import (
    PACKED, bucket_count, by_bucket, chunk_count, dealt_rows, per_bucket, per_chunk, planes, runs, squeezed, unplanes, unsqueezed, with_keys,
)
from spanmart.llm.common import NO_ID

LENGTH = 50
SEED = 24
BACK = LENGTH - SEED  # an anchor lies 0 to BACK bytes after the start of its string
AROUND = BACK + LENGTH
# An anchor in this many chunks has its strings dealt by their own hash, so no bucket gets all texts around it.
WIDE_CHUNKS = 256
PIECE = 1 << 20
# Bytes of texts looked at together, and rows of a bucket sorted together.
BLOCK = 1 << 18
SORTED = 1 << 15
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
ENTRY = np.dtype([("around", "V76"), ("doc", "<i8"), ("ask", "<u4"), ("number", "<u4")])


def words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places, as big-endian numbers; data has 8 bytes more."""
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for o in range(8):
        part = data[o : o + len(out)]
        out[o::8] = part[: len(part) // 8 * 8].view(">u8")[: len(out) // 8]
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def slid(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, which of the strings that begin 0..BACK before it have this anchor) of a text's anchors."""
    _, at, h, own = _block_anchors([text])
    return at, h, own


def _block_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place, hash and own strings of the anchors of texts that are looked at as one run of bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size
    n = int(size.sum())
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint32)
    v = words_at(np.frombuffer(b"".join([*texts, bytes(24)]), np.uint8), n - 7)
    q = n - SEED + 1
    h = mixed(v[:q] * _A) + v[8 : 8 + q] * _C
    h = np.maximum(mixed(mixed(h) + v[16 : 16 + q] * _A), np.uint64(1))  # zero stands for no string
    # The least hash of every string; what begins in one text and ends in another is no string.
    high = np.zeros(q + BACK, np.uint64)
    high[BACK : BACK + n - LENGTH + 1] = slid(h, BACK + 1, np.minimum)
    for stop in (base + size).tolist():
        high[max(BACK, BACK + stop - LENGTH + 1) : BACK + stop] = 0
    # A hash is some string's least if the largest of the leasts over its strings equals it.
    at = np.flatnonzero(slid(high, BACK + 1, np.maximum) == h)
    value = h[at]
    own = np.zeros(len(at), np.uint32)
    for o in range(BACK + 1):
        own |= (high[at + (BACK - o)] == value).astype(np.uint32) << np.uint32(o)
    which = np.searchsorted(base, at, "right") - 1
    return which, at - base[which], value, own


def marks(size: np.ndarray, which: np.ndarray, at: np.ndarray, seen: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each of the texts of these sizes the stretches of bytes covered by the strings of ``seen``.

    Bits tell by how far before the anchor ``at`` of the text ``which`` a string begins.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in size]
    # One line for all texts, so far apart that stretches of two never meet.
    base = np.cumsum(size + LENGTH + 1) - (size + LENGTH + 1)
    some = seen > 0
    line, seen = (base[which] + at)[some], seen[some]
    begins = np.zeros(int((size + LENGTH + 1).sum()), bool)
    for o in range(BACK + 1):
        begins[line[(seen >> np.uint32(o)) & np.uint32(1) == 1] - o] = True
    starts = np.flatnonzero(begins)
    if not len(starts):
        return out
    first = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + LENGTH])
    begin = starts[first]
    end = starts[np.r_[first[1:], len(starts)] - 1] + LENGTH
    text = np.searchsorted(base, begin, "right") - 1
    for i, a, b in zip(text.tolist(), (begin - base[text]).tolist(), (end - base[text]).tolist(), strict=True):
        out[i].append((a, b))
    return out


def around(texts: list[bytes], which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes from BACK before to BACK after each anchor; beyond the ends 0xFF, which UTF-8 never holds."""
    out = np.zeros(len(at), "V76")
    size = np.array([len(t) for t in texts], np.int64)
    edge = np.searchsorted(which, np.arange(len(texts) + 1))
    for i, j in _blocks(size):
        # Each text stands after BACK such bytes and before AROUND of them.
        base = np.cumsum(size[i:j] + BACK + AROUND) - (size[i:j] + BACK + AROUND)
        gap = b"\xff" * (BACK + AROUND)
        data = np.frombuffer(gap[:BACK] + gap.join(texts[i:j]) + gap[:AROUND], np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(data, AROUND)
        a, b = edge[i], edge[j]
        out[a:b] = np.ascontiguousarray(view[base[which[a:b] - i] + at[a:b]]).view("V76").ravel()
    return out


def _blocks(size: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring texts of about BLOCK bytes together, so that small texts do not cost a call each."""
    part = np.cumsum(size) // BLOCK
    start, stop = runs(part)
    return list(zip(start.tolist(), stop.tolist(), strict=True))


def _chunk_anchors(texts: list[bytes]):
    """All anchors of a chunk: text number, place, hash, own strings."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    for i, j in _blocks(np.array([len(t) for t in texts], np.int64)):
        which, *more = _block_anchors(texts[i:j])
        found.append((which + i, *more))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _packed(bucket: np.ndarray, chunk: int, rows: np.ndarray, n: int):
    """Rows (in order of their bucket) as one message per bucket, in pieces of bounded size."""
    edge = np.searchsorted(bucket, np.arange(n + 1))
    for b in range(n):
        for a in range(edge[b], edge[b + 1], PIECE):
            yield {"bucket": [b], "chunk": [chunk], "data": [questions(rows[a : min(a + PIECE, edge[b + 1])])]}


def covered(ask: np.ndarray) -> np.ndarray:
    """Which of the bytes around it the asked strings of each anchor cover."""
    low, high = (np.frexp(v.astype(np.float64))[1][:, None] - 1 for v in (ask & (~ask + np.uint32(1)), ask))
    place = np.arange(AROUND)
    return (place >= BACK - high) & (place < BACK - low + LENGTH)


def questions(rows: np.ndarray) -> bytes:
    """Rows, in order of their numbers, as a message: of the bytes around their anchors those that their strings cover."""
    data = np.frombuffer(np.ascontiguousarray(rows["around"]).tobytes(), np.uint8).reshape(len(rows), AROUND)
    step = np.diff(rows["number"], prepend=np.uint32(0))
    part = [data[a : a + SORTED][covered(rows["ask"][a : a + SORTED])].tobytes() for a in range(0, len(rows), SORTED)]
    return squeezed(planes(rows["doc"].copy()), planes(rows["ask"].copy()), planes(step), b"".join(part))


def unquestions(message: bytes) -> np.ndarray:
    doc, ask_, step, flat = unsqueezed(message)
    rows = np.zeros(len(doc) // 8, ENTRY)
    rows["doc"], rows["ask"], rows["number"] = unplanes(doc, "<i8"), unplanes(ask_, "<u4"), np.cumsum(unplanes(step, "<u4"), dtype=np.uint32)
    flat, at = np.frombuffer(flat, np.uint8), 0
    for a in range(0, len(rows), SORTED):
        some = covered(rows["ask"][a : a + SORTED])
        data = np.full(some.shape, 0xFF, np.uint8)
        size = np.count_nonzero(some)
        data[some] = flat[at : at + size]
        rows["around"][a : a + SORTED] = data.view("V76").ravel()
        at += size
    return rows


def short(codes: np.ndarray) -> bytes:
    """Sorted codes of 40 bits as a message: what each is more than the one before it."""
    return squeezed(planes(np.diff(codes.astype("<u8"), prepend=np.uint64(0))))


def unshort(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(unsqueezed(data)[0], "<u8"), dtype=np.uint64)


def spread(hashes: np.ndarray) -> np.ndarray:
    """Anchors' hashes mixed again: the least ones of windows are small numbers, mixed they fill all buckets evenly."""
    return mixed((hashes & ~np.uint64(1)) * _C)


def codes_of(spread_: np.ndarray) -> np.ndarray:
    """What is sent of a hash within its bucket: 39 bits above a free lowest one.

    Hashes that agree in these only cause questions about bytes that differ.
    """
    return spread_ << np.uint64(1) & np.uint64((1 << 40) - 2)


def send_anchors(n: int):
    """Codes of a chunk's anchors, each once; the lowest bit tells whether several of its texts hold it."""

    def fn(chunk, ids, texts, _):
        which, _, hashes, _ = _chunk_anchors(texts)
        hashes = spread(hashes)
        order = np.lexsort((which, hashes))
        h, w = hashes[order], which[order]
        start, stop = runs(h)
        many = w[start] != w[stop - 1] if len(start) else np.zeros(0, bool)
        out = codes_of(h[start]) | many.astype(np.uint64)
        # Buckets are ranges of the hashes, so they are in order already.
        edge = np.searchsorted(by_bucket(h[start], n), np.arange(n + 1))
        for b in range(n):
            for a in range(edge[b], edge[b + 1], PIECE):
                yield {"bucket": [b], "chunk": [chunk], "data": [short(np.sort(out[a : min(a + PIECE, edge[b + 1])]))]}

    return fn


def shared_anchors(bucket, messages):
    """Back to each chunk: its codes that several texts hold; the lowest bit tells of wide ones."""
    if not messages:
        return
    every = [unshort(d) for _, d in messages]
    plain = np.sort(np.concatenate(every) >> np.uint64(1))
    start, stop = runs(plain)
    times = stop - start
    value = plain[start]
    for (chunk, _), own in zip(messages, every, strict=True):
        count = times[np.searchsorted(value, own >> np.uint64(1))]
        keep = (count > 1) | (own & np.uint64(1) == 1)
        out = own[keep] & ~np.uint64(1) | (count[keep] >= WIDE_CHUNKS).astype(np.uint64)
        if len(out):
            yield {"bucket": [bucket], "chunk": [chunk], "data": [short(np.sort(out))]}


class Entries:
    """The shared anchors of a chunk and the distinct surroundings that it asks about."""

    def __init__(self, ids, texts, messages, n):
        which, place, hashes, own = _chunk_anchors(texts)
        hashes = spread(hashes)
        told = [unshort(d) | np.uint64(b) << np.uint64(40) for b, d in messages]
        told = np.sort(np.concatenate(told or [np.zeros(0, np.uint64)]))
        key = codes_of(hashes) | by_bucket(hashes, n).astype(np.uint64) << np.uint64(40)
        if len(told):
            spot = np.minimum(np.searchsorted(told, key), len(told) - 1)
            shared = told[spot] & ~np.uint64(1) == key
            wide = (told[spot] & np.uint64(1) == 1)[shared]
        else:
            shared = np.zeros(len(key), bool)
            wide = np.zeros(0, bool)
        self.which, self.place = which[shared], place[shared]
        self.own, hashes = own[shared], hashes[shared]
        self.doc = np.asarray(ids)[self.which] if len(self.which) else np.zeros(0, np.int64)
        bytes_ = around(texts, self.which, self.place)
        # Bytes that none of its strings covers make no entry of its own.
        flat = np.frombuffer(bytes_, np.uint8).reshape(-1, AROUND)
        for a in range(0, len(flat), SORTED):
            np.putmask(flat[a : a + SORTED], ~covered(self.own[a : a + SORTED]), 0xFF)
        # One entry per surrounding and asked strings; the chunk's smallest document asks for it.
        order = np.lexsort((self.doc, self.own, _hashes(bytes_)))
        b, o = bytes_[order], self.own[order]
        new = np.r_[True, (b[1:] != b[:-1]) | (o[1:] != o[:-1])] if len(order) else np.zeros(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        first = order[new]
        self.around, self.ask, self.least = bytes_[first], self.own[first], self.doc[first]
        self.hash, self.wide = hashes[first], wide[first]


def _hashes(bytes_: np.ndarray) -> np.ndarray:
    """Hashes that bring equal surroundings together; whether they are equal is told by the bytes."""
    padded = np.zeros((len(bytes_), -(-AROUND // 8) * 8), np.uint8)
    padded[:, :AROUND] = np.frombuffer(bytes_.tobytes(), np.uint8).reshape(-1, AROUND)
    h = np.zeros(len(bytes_), np.uint64)
    for column in padded.view("<u8").T:
        h = mixed((h + column) * _A)
    return h


def ranked(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by columns in turn; later columns are looked at only among equals.

    Equal rows have the place of the first of them as their rank, so rows that are alone keep theirs.
    """
    rank = np.zeros(len(columns[0]), np.int64)
    todo = np.arange(len(rank))
    for c in columns:
        if not len(todo):
            break
        order = np.lexsort((c[todo], rank[todo]))
        todo = todo[order]
        r, v = rank[todo], c[todo]
        fresh = np.r_[True, r[1:] != r[:-1]]
        new = fresh | np.r_[True, v[1:] != v[:-1]]
        place = np.arange(len(todo))
        of_rank = np.maximum.accumulate(np.where(fresh, place, 0))
        of_value = np.maximum.accumulate(np.where(new, place, 0))
        rank[todo] = r + of_value - of_rank
        alone = new & np.r_[new[1:], True]
        todo = todo[~alone]
    return rank


def ask(n: int):
    """Surroundings of shared anchors, to the bucket of the anchor or, for wide ones, of each string."""

    def fn(chunk, ids, texts, messages):
        e = Entries(ids, texts, messages, n)
        bucket, rows = _questions(e, n)
        order = np.argsort(bucket, kind="stable")
        yield from _packed(bucket[order], chunk, rows[order], n)

    return fn


def _questions(e: Entries, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of what a chunk asks; rows carry the entry's number to be answered by."""
    rows = np.zeros(len(e.around), ENTRY)
    rows["around"], rows["doc"], rows["ask"] = e.around, e.least, e.ask
    rows["number"] = np.arange(len(rows))
    narrow = ~e.wide
    to, sent = by_bucket(e.hash[narrow], n), rows[narrow]
    wide = rows[e.wide]
    if not len(wide):
        return to, sent
    data = np.frombuffer(np.ascontiguousarray(wide["around"]).tobytes(), np.uint8).reshape(len(wide), AROUND)
    # Strings by their own hash: every string goes to one bucket, with the others of its entry that go there.
    at = np.zeros((len(wide), BACK + 1), np.int64)
    for o in range(BACK + 1):
        h = np.zeros(len(wide), np.uint64)
        for k in (0, 8, 16, 24, 32, 40, 42):
            part = np.ascontiguousarray(data[:, BACK - o + k : BACK - o + k + 8]).view("<u8").ravel()
            h = mixed((h + part) * _A)
        at[:, o] = by_bucket(mixed(h * _C), n)
    asked = (wide["ask"][:, None] >> np.arange(BACK + 1, dtype=np.uint32)) & np.uint32(1) == 1
    r, o = np.nonzero(asked)
    pair = r * n + at[r, o]
    order = np.argsort(pair, kind="stable")
    start, _ = runs(pair[order])
    out = wide[r[order][start]]
    out["ask"] = np.bitwise_or.reduceat(np.uint32(1) << o[order].astype(np.uint32), start) if len(start) else 0
    return np.concatenate([to, at[r, o][order][start]]), np.concatenate([sent, out])


def longest_previous(doc: np.ndarray, beside: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of suffixes in suffix order.

    ``beside[i]`` is the common prefix of suffixes i-1 and i, ``doc`` their documents.  The
    nearest suffixes before and after with a smaller document hold the longest match.
    Both are found by jumping: past a suffix of an equal or later document to the one it was itself
    sent to.  A jump whose common prefix is under ``least`` ends the search.
    """
    best = np.zeros(len(doc), np.int64)
    for d, c in ((doc, beside), (doc[::-1], np.r_[0, beside[:0:-1]] if len(beside) else beside)):
        n = len(d)
        to = np.arange(n) - 1
        common = c.astype(np.int64).copy()
        todo = np.flatnonzero(common >= least)
        while len(todo):
            j = to[todo]
            later = d[j] >= d[todo]
            move, j = todo[later], j[later]
            # Jumps are read before any is changed.
            on, limit = to[j].copy(), np.minimum(common[move], common[j])
            to[move], common[move] = on, np.where(on >= 0, limit, 0)
            todo = move[common[move] >= least]
        found = np.where(to >= 0, common, 0)
        best = np.maximum(best, found if d is doc else found[::-1])
    return best


def answer(bucket, messages):
    """For every question: which of the strings have occurred in a smaller document."""
    if not messages:
        return
    each = [unquestions(d) for _, d in messages]
    sizes = [len(r) for r in each]
    rows = np.concatenate(each)
    del each
    bytes_ = np.ascontiguousarray(rows["around"])
    # Equal surroundings are sorted once, for the smallest document and all strings that any asks for.
    order = np.lexsort((rows["doc"], _hashes(bytes_)))
    b = bytes_[order]
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    stop = np.r_[start[1:], len(b)]
    first = order[start]
    asked = np.bitwise_or.reduceat(rows["ask"][order], start)
    doc = rows["doc"][first]
    seen = judged(bytes_[first], asked, doc)
    entry = np.empty(len(rows), np.int64)
    entry[order] = np.repeat(np.arange(len(start)), stop - start)
    out = np.where(rows["doc"] > doc[entry], rows["ask"], seen[entry] & rows["ask"]).astype("<u4")
    reply = np.zeros(len(rows), np.dtype([("number", "<u4"), ("seen", "<u4")]))
    reply["number"], reply["seen"] = rows["number"], out
    at = 0
    for (chunk, _), size in zip(messages, sizes, strict=True):
        part = reply[at : at + size]
        at += size
        part = part[part["seen"] > 0]
        if len(part):
            step = np.diff(part["number"], prepend=np.uint32(0))
            yield {"bucket": [bucket], "chunk": [chunk], "data": [squeezed(planes(step), planes(part["seen"].copy()))]}


def judged(bytes_: np.ndarray, asked: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits of the asked suffixes of distinct surroundings that have a previous factor of LENGTH.

    Equal strings have equal anchors, so the rows of some anchors are sorted without the others, and what a
    bucket takes is bounded by its rows and not by all their suffixes.
    """
    data = np.frombuffer(bytes_.tobytes(), np.uint8).reshape(len(bytes_), AROUND)
    anchor = np.zeros(len(data), np.uint64)
    for k in range(BACK, BACK + SEED, 8):
        anchor = mixed((anchor + np.ascontiguousarray(data[:, k : k + 8]).view("<u8").ravel()) * _A)
    order = np.argsort(anchor, kind="stable")
    start, _ = runs(anchor[order])
    seen = np.zeros(len(data), np.uint32)
    part, _ = runs(start // SORTED)
    for a, b in zip(start[part], np.r_[start[part][1:], len(order)], strict=True):
        rows = order[a:b]
        seen[rows] = _judged(data[rows], asked[rows], doc[rows])
    return seen


def _judged(data: np.ndarray, asked: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``judged`` for whole anchors: sort their asked suffixes."""
    at, back = np.nonzero((asked[:, None] >> np.arange(BACK + 1, dtype=np.uint32)) & np.uint32(1) == 1)
    flat = np.frombuffer(data.tobytes() + bytes(16), np.uint8)
    eight = words_at(flat, len(data) * AROUND)
    begin = at * AROUND + (BACK - back)
    columns = [eight[begin + k] for k in (0, 8, 16, 24, 32, 40, 42)]
    rank = ranked(columns)
    order = np.lexsort((doc[at], rank))
    r, d = rank[order], doc[at][order]
    # Of neighbours in suffix order only whether they agree in LENGTH bytes matters.
    beside = np.where(np.r_[False, r[1:] == r[:-1]], LENGTH, 0) if len(r) else np.zeros(0, np.int64)
    factor = longest_previous(d, beside, LENGTH)
    hit = order[factor >= LENGTH]
    seen = np.zeros(len(data), np.uint32)
    np.bitwise_or.at(seen, at[hit], np.uint32(1) << back[hit].astype(np.uint32))
    return seen


def once(ids, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], list[int]]:
    """A chunk's distinct texts with their smallest ids, and the place among them of every row; ids are in order."""
    place: dict[bytes, int] = {}
    of = [place.setdefault(t, len(place)) for t in texts]
    ids = np.asarray(ids)
    return ids[np.unique(of, return_index=True)[1]] if of else ids, list(place), of


def on_distinct(fn):
    """Have a chunk's copies of a text looked at once."""

    def run(chunk, ids, texts, messages):
        ids, texts, _ = once(ids, texts)
        yield from fn(chunk, ids, texts, messages)

    return run


def apply(ids, texts, told, answers, n):
    """Removed stretches of every row of a chunk."""
    least, distinct, of = once(ids, texts)
    e = Entries(least, distinct, told, n)
    seen = np.zeros(len(e.around), np.uint32)
    for _, d in answers:
        step, told_seen = (unplanes(p, "<u4") for p in unsqueezed(d))
        np.bitwise_or.at(seen, np.cumsum(step, dtype=np.uint32), told_seen)
    mine = np.where(e.doc > e.least[e.entry], e.own, seen[e.entry] & e.own) if len(e.doc) else e.own
    found = marks(np.array([len(t) for t in distinct], np.int64), e.which, e.place, mine)
    for i, k in enumerate(of):
        # A later copy goes as a whole.
        copied = ids[i] > least[k] and len(distinct[k]) >= LENGTH
        yield i, distinct[k], [(0, len(distinct[k]))] if copied else found[k]


FOUND = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary"
)


def removed(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (``start-end``), and the kept bytes if asked for.

    A missing text is empty.  Copies of a whole text are all removed but the one with the
    smallest doc_id (texts under 50 bytes stay); rows without a doc_id come after all others,
    but not after each other; repeated rows give repeated rows; other columns are ignored.
    """
    rows = with_keys(docs)
    chunks = chunk_count(rows)
    n = bucket_count(chunks)
    texts = dealt_rows(rows, chunks)
    told = per_bucket(per_chunk(texts, None, on_distinct(send_anchors(n)), PACKED), shared_anchors)
    answers = per_bucket(per_chunk(texts, told, on_distinct(ask(n)), PACKED), answer)
    back = told.withColumn("bucket", -F.col("bucket") - 1).unionByName(answers)

    def fn(chunk, ids, bodies, messages):
        shared = [(-b - 1, d) for b, d in messages if b < 0]
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        for i, t, spans in apply(ids, bodies, shared, [m for m in messages if m[0] >= 0], n):
            kept, at = [], 0
            for a, b in spans:
                kept.append(t[at:a])
                at = b
            kept.append(t[at:])
            rest = b"".join(kept)
            out["doc_id"].append(int(ids[i]) if ids[i] != NO_ID else None)
            out["n_bytes"].append(len(t))
            out["n_removed"].append(len(t) - len(rest))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["spans"].append(",".join(f"{a}-{b}" for a, b in spans))
            out["kept"].append(rest if keep_bytes else None)
        yield out

    found = per_chunk(texts, back, fn, FOUND)
    return found if keep_bytes else found.drop("kept")
