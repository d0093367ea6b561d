"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items form one automaton, whose states stand for all their
passages.  A document's words are streamed through it; the current state and matching
length tell the longest item passage that ends at each word.  Where the length reaches a
window, the words under it are hit and the items that hold the passage are noted.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import binaries, documents, map_rows

WINDOW = 10
# Items are sent to every task only up to this many bytes; beyond it they are dealt into as many shards as needed.
SHARD_BYTES = 16 << 20
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
WORDS = re.compile(rb"[^ ]+").finditer


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and everything beyond ASCII."""
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton over the words of many items, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        spelled: list[tuple[str, list[int]]] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                spelled.append((name, ids))
        for _, ids in spelled:
            last = 0
            for c in ids:
                last = self._add(last, c)
        # Windows: the state of each and its length; a short item is one window.
        self.items: list[set[str] | None] = [None] * len(self.next)
        self.short: list[dict[int, set[str]] | None] = [None] * len(self.next)
        for name, ids in spelled:
            state = 0
            for n, c in enumerate(ids, 1):
                state = self.next[state][c]
                if n >= window:
                    self._note(state, name)
            if len(ids) < window:
                if self.short[state] is None:
                    self.short[state] = {}
                self.short[state].setdefault(len(ids), set()).add(name)
        self.least = min((min(len(ids), window) for _, ids in spelled), default=0)
        self.has_short = any(len(ids) < window for _, ids in spelled)
        n = len(self.vocabulary)
        pairs = {a * n + b for _, ids in spelled for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _add(self, last: int, c: int) -> int:
        """Extend the passages that end in state ``last`` by a word."""
        if c in self.next[last]:
            old = self.next[last][c]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, c, old)
        new = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            old = self.next[at][c]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, c, old)
        return new

    def _state(self, moves: dict[int, int], length: int) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, c: int, old: int) -> int:
        """Give the shorter passages of a state a state of their own."""
        copy = self._state(dict(self.next[old]), self.length[at] + 1)
        self.link[copy], self.link[old] = self.link[old], copy
        while at >= 0 and self.next[at].get(c) == old:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def _note(self, state: int, name: str) -> None:
        """Add an item to the state that holds its window, and to the states of longer passages' suffixes."""
        while state > 0 and self.length[state] >= self.window:
            if self.items[state] is None:
                self.items[state] = set()
            if name in self.items[state]:
                return
            self.items[state].add(name)
            state = self.link[state]

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a match that is at least as long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches in which all neighbouring words are neighbours in some item: only there can windows lie."""
        if not len(ids) or not self.least:
            return []
        known = ids >= 0
        if self.least == 1:
            joined = known[:-1] & known[1:]
        else:
            codes = ids[:-1] * len(self.vocabulary) + ids[1:]
            place = np.searchsorted(self.pairs, codes)
            place[place == len(self.pairs)] = 0
            joined = known[:-1] & known[1:] & (self.pairs[place] == codes) if len(self.pairs) else known[:-1] & False
        cuts = np.flatnonzero(~joined) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(ids)]
        long = (ends - starts >= self.least) & known[starts]
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit stretches of words (disjoint, ordered), the items found, and the longest match."""
        ids = self.numbers(words)
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        window = self.window

        def hit(start: int, end: int) -> None:
            if hits and start <= hits[-1][1]:
                start = min(start, hits[-1][0])
                while hits and start <= hits[-1][1]:
                    before = hits.pop()
                    start, end = min(start, before[0]), max(end, before[1])
            hits.append((start, end))

        for first, stop in self.stretches(ids):
            state = length = 0
            for i, c in enumerate(ids[first:stop].tolist(), first):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    length += 1
                longest = max(longest, length)
                if length >= window:
                    hit(i + 1 - window, i + 1)
                    found |= self.items[self.window_state(state)]
                if self.has_short:
                    at = state
                    while at > 0:
                        for n, names in (self.short[at] or {}).items():
                            if n <= length:
                                hit(i + 1 - n, i + 1)
                                found |= names
                        at = self.link[at]
        return hits, found, longest


def shards(benchmark: DataFrame, limit: int = SHARD_BYTES) -> list[list[tuple[str, bytes]]]:
    """The items, read in groups of at most about ``limit`` bytes.

    The benchmark is a test set, whose size is checked here first: as long as it is within
    the limit there is one shard; a larger one is dealt by item into more, each of which
    passes over the documents on its own.
    """
    plain = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("item_id").isNotNull())
    size = plain.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    n = -(-size // limit)
    if n <= 1:
        rows = [plain]
    else:
        rows = [plain.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]
    return [[(r["item_id"], r["text"].encode()) for r in part.collect()] for part in rows]


def _through(docs: DataFrame, parts: list, window: int, schema: str, finish) -> DataFrame:
    """Pass rows through each shard's automaton; ``finish`` makes columns of the last batch.

    The columns go along unchanged, with the spans and items found so far; nothing is
    shuffled.  An automaton is built once per worker.
    """
    carried = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    names = docs.columns
    context = docs.sparkSession.sparkContext
    for k, items in enumerate(parts):
        last = k == len(parts) - 1
        docs = map_rows(
            docs,
            _pass(context.broadcast(items), names, window, k == 0, finish if last else None),
            schema if last else f"{carried}, __spans array<struct<a:long,b:long>>, __names array<string>, __longest long",
        )
    return docs


def _pass(sent, names: list[str], window: int, first: bool, finish):
    built: list[ItemAutomaton] = []

    def run(batch):
        if not built:
            built.append(ItemAutomaton(sent.value, window))
        found = []
        for i, text in enumerate(binaries(batch.column("text"))):
            words = words_of(text)
            hits, items, longest = built[0].scan(words)
            if not first:
                hits = merged(hits + [(x["a"], x["b"]) for x in batch.column("__spans")[i].as_py()])
                items = items | set(batch.column("__names")[i].as_py())
                longest = max(longest, batch.column("__longest")[i].as_py())
            found.append((text, words, hits, items, longest))
        if finish:
            return finish(batch, found, built[0])
        return {c: batch.column(c) for c in names} | {
            "__spans": [[{"a": a, "b": b} for a, b in f[2]] for f in found],
            "__names": [sorted(f[3]) for f in found],
            "__longest": [f[4] for f in found],
        }

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest match and hit spans.

    Spans are of words, as ``start-end`` with an exclusive end.  A missing text has no
    words and is not contaminated; items without words or id match nothing; a missing doc_id
    stays missing; repeated rows give repeated rows; other columns are ignored.
    """
    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "longest_match long, hit_spans string"
    )

    def finish(batch, found, _):
        n_hit = [sum(b - a for a, b in f[2]) for f in found]
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": [len(f[1]) for f in found],
            "n_hit": n_hit,
            "n_items": [len(f[3]) for f in found],
            "items_sha256": [hashlib.sha256(",".join(sorted(f[3])).encode()).hexdigest() for f in found],
            "contaminated": [n > 0 for n in n_hit],
            "longest_match": [f[4] for f in found],
            "hit_spans": [",".join(f"{a}-{b}" for a, b in f[2]) for f in found],
        }

    return _through(documents(docs), shards(benchmark, shard_bytes), window, schema, finish)


def without(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """A text without the given stretches of words; what stood between them goes too."""
    places = [m.span() for m in WORDS(text.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return b"".join(out)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Documents without item passages, with the columns they had.

    Hit stretches are cut out of the text, again until none is left (cutting can bring two
    halves of a passage together); a document of which more than ``max_coverage`` of the
    words was hit is removed.  Texts without a hit, missing ones among them, stay as they are.
    """
    plain = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    read = plain.withColumn("text", F.coalesce(F.col(f"__{at}").cast("string"), F.lit("")))
    kept = ", ".join(f"__{i} {t}" for i, (_, t) in enumerate(docs.dtypes))

    columns = plain.columns
    parts = shards(benchmark, shard_bytes)

    def finish(batch, found, automaton):
        texts, share = [], []
        for text, words, hits, _, _ in found:
            share.append(sum(b - a for a, b in hits) / len(words) if words else 0.0)
            was = text
            while hits:
                text = without(text, hits)
                hits = automaton.scan(words_of(text))[0]
            texts.append(None if text == was else text.decode())
        return {c: batch.column(c) for c in columns} | {"cleaned": texts, "share": share}

    wide = _through(read, parts, window, f"{kept}, cleaned string, share double", finish)
    wide = wide.where(F.col("share") <= max_coverage)
    out = [F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)]
    out[at] = F.coalesce("cleaned", f"__{at}").alias("text")
    return wide.select(*out)
