"""SentencePiece merge-type encoding and decoding, by backtracking over longest matches.

A text is cut where no piece can cross (before a space mark or a sign that follows
another character).  Each part is then covered from left to right with the longest piece that
starts there.  A piece stays only if merging would not have joined or split it
differently together with the piece before it; otherwise the next shorter piece is
tried, and when none is left, the position is marked as failed and the piece before it
is given up.  The bitfield of failed positions keeps this linear.
"""

from __future__ import annotations

import hashlib
import string
from array import array
from itertools import groupby

import ahocorasick
from pyspark.sql import DataFrame

from spanmart.llm.common import documents, map_rows

SPACE = "▁"
NO_RANK = 1 << 62
CACHED_PARTS = 1 << 19
CACHED_PAIRS = 1 << 19
_LOADED: dict[str, PieceModel] = {}


class PieceModel:
    """Tables of one merge-type model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.unknown = model.unk_id()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.id_of = {p: i for i, p in enumerate(self.piece) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece holds a space mark after other characters")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id_of):
            raise ValueError("a piece begins with several space marks")
        # Runs of space marks are merged by score on their own, see spaces().
        self.space_score = {len(p): model.get_score(i) for p, i in self.id_of.items() if not p.strip(SPACE)}
        self.signs = self._signs()
        words = [p for p in self.id_of if p.strip(SPACE) or p == SPACE]
        self._rank(words, model)
        self._spaces: dict[int, list[int]] = {}
        # Bytes of each token as it is printed: controls vanish, the mark is a space.
        self.printed = [self.piece[i].replace(SPACE, " ").encode() for i in range(size)]
        for i in special:
            self.printed[i] = b""
        self.printed[self.unknown] = " ⁇ ".encode()
        self.single = {}
        for value, i in enumerate(self.bytes):
            self.printed[i] = bytes([value])
            self.single[i] = value
        self.controls = special - set(self.bytes) - {self.unknown}

    def _signs(self) -> set[str]:
        """Punctuation before which a text can be cut where another character precedes: no piece crosses there."""
        signs = set("\t\n" + string.punctuation)
        crossings = {(a, b) for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a != SPACE}
        while more := {(a, b) for a, b in crossings if b in signs and a not in signs}:
            signs |= {a for a, _ in more if not a.isalpha()}
            signs -= {b for a, b in more if a.isalpha()}
        return signs

    def _rank(self, words: list[str], model) -> None:
        """Order pieces by merging: single characters, then falling scores; learn what each is merged from."""
        scored = sorted((w for w in words if len(w) > 1), key=lambda w: (-model.get_score(self.id_of[w]), self.id_of[w]))
        scores = [model.get_score(self.id_of[w]) for w in scored]
        if len(set(scores)) != len(scores):
            raise ValueError("two pieces have one score")
        self.order = sorted(w for w in words if len(w) == 1)
        self.singles = len(self.order)
        self.order += scored
        self.rank = {w: r for r, w in enumerate(self.order)}
        self.token = [self.id_of[w] for w in self.order]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.order)
        self.dead: set[int] = set()
        self.shorter: list[int] = [-1] * len(self.order)
        for r in range(self.singles, len(self.order)):
            found = self._halves(self.order[r])
            if found is None:
                self.dead.add(r)  # merging never makes it: a text never holds it as a token
            else:
                self.halves[r] = found
        self.size = [len(w) for w in self.order]
        self.characters = set(self.order[: self.singles])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.trie = ahocorasick.Automaton()
        for r, w in enumerate(self.order):
            if r not in self.dead:
                self.trie.add_word(w, (len(w) - 1, r))
        self.trie.make_automaton()
        live = {w for r, w in enumerate(self.order) if r not in self.dead}
        for r, w in enumerate(self.order):
            for cut in range(len(w) - 1, 0, -1):
                if w[:cut] in live:
                    self.shorter[r] = self.rank[w[:cut]]
                    break

    def _halves(self, word: str) -> tuple[int, int] | None:
        """Merge a piece's own characters; the last merge joins its two halves."""
        parts = list(word)
        if any(c not in self.rank for c in parts):
            return None
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NO_RANK:
                return None
            at = ranks.index(best)
            if len(parts) == 2:
                return self.rank[parts[0]], self.rank[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbours apart.

        Walk back through the merges on both sides of the border, the latest first; a
        merge across the border that would have come before the one undone last forbids
        the pair.
        """
        order, rank, halves = self.order, self.rank, self.halves
        before = NO_RANK
        while True:
            if rank.get(order[left] + order[right], NO_RANK) < before:
                return False
            # Of equal merges the left one comes first, so the right one is undone first.
            if left > right and halves[left] is not None:
                before, left = left, halves[left][1]
            elif halves[right] is not None:
                before, right = right + 1, halves[right][0]
            elif halves[left] is not None:
                before, left = left, halves[left][1]
            else:
                return True

    def known(self, text: str) -> list[int]:
        """Ranks of the pieces of a text whose characters are all pieces."""
        n = len(text)
        size, shorter, pairs = self.size, self.shorter, self.pairs
        longest = [-1] * n
        for end, (back, r) in self.trie.iter(text):
            longest[end - back] = r  # later ends are longer matches
        failed = 0  # bit p: no cover of the first p characters can be continued
        out: list[int] = []
        at, pick, last = 0, longest[0] if n else -1, -1
        while at < n:
            while pick >= 0:
                to = at + size[pick]
                if not (failed and failed >> to & 1):
                    if last < 0:
                        break
                    fits = pairs.get((last, pick))
                    if fits is None:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        fits = pairs[last, pick] = self.compatible(last, pick)
                    if fits:
                        break
                pick = shorter[pick]
            if pick >= 0:
                out.append(pick)
                last, at = pick, to
                pick = longest[at] if at < n else -1
            else:
                failed |= 1 << at
                if not out:
                    raise ValueError("a text has no cover")
                pick = shorter[out.pop()]
                at -= size[last]
                last = out[-1] if out else -1
        return out

    def spaces(self, n: int) -> list[int]:
        """Tokens of n space marks alone.

        Their pieces' scores do not fall with the merges (the shortest have the lowest),
        which backtracking needs, so runs are merged directly, best score and leftmost first.
        """
        if n <= 1:
            return [self.id_of[SPACE]] * n
        if n not in self._spaces:
            import heapq

            size = [1] * n
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            alive = [True] * n
            heap: list = []

            def offer(a: int) -> None:
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (score := self.space_score.get(size[a] + size[b])) is not None:
                    heapq.heappush(heap, (-score, a, b, size[a], size[b]))

            for a in range(n - 1):
                offer(a)
            while heap:
                _, a, b, x, y = heapq.heappop(heap)
                if not (alive[a] and b < n and alive[b] and after[a] == b and size[a] == x and size[b] == y):
                    continue
                size[a] += size[b]
                alive[b] = False
                after[a] = after[b]
                if after[b] < n:
                    before[after[b]] = a
                offer(before[a])
                offer(a)
            out = [self.id_of[SPACE * size[a]] for a in range(n) if alive[a]]
            if len(self._spaces) >= 4096 or n > 4096:
                return out
            self._spaces[n] = out
        return self._spaces[n]

    def part(self, part: str) -> list[int]:
        """Tokens of space marks followed by other characters."""
        rest = part.lstrip(SPACE)
        run = len(part) - len(rest)
        if not rest:
            return self.spaces(run)
        text = SPACE + rest if run else rest
        token = self.token
        if self.characters.issuperset(text):
            out = [token[r] for r in self.known(text)]
        else:
            out = []
            for known, group in groupby(text, self.characters.__contains__):
                if known:
                    out += [token[r] for r in self.known("".join(group))]
                else:
                    out += [self.bytes[b] for b in "".join(group).encode()]
        if run > 1:
            # The last mark may have joined the word; if not, it merges with the others.
            alone = out[0] == self.id_of[SPACE]
            out = self.spaces(run - 1 + alone) + out[alone:]
        return out


class Parts(dict):
    """Encoded parts of texts, made on first use and forgotten together when there are too many."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.model.part(part)).tobytes()
        if len(part) <= 64:
            self[part] = ids
        return ids


class Codec:
    """Encode and decode texts with one model."""

    def __init__(self, path: str):
        import re

        if path not in _LOADED:
            _LOADED[path] = PieceModel(path)
        self.model = _LOADED[path]
        self.parts = Parts(self.model)
        sign = "".join(map(re.escape, sorted(self.model.signs)))
        self.find = re.compile(f"{SPACE}*[{sign}]*[^{SPACE}{sign}]*").findall
        self.begin = array("I", [self.model.begin]).tobytes()
        self.end = array("I", [self.model.end]).tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids with begin and end as 32-bit integers in memory's (little-endian) order."""
        if not text:
            return self.begin + self.end
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        marked = (SPACE + text).replace(" ", SPACE)
        return b"".join([self.begin, *map(self.parts.__getitem__, self.find(marked)), self.end])

    def decode(self, ids: bytes) -> str:
        """The text of token ids; the mark put before the first word is taken away again."""
        numbers = array("I")
        numbers.frombytes(ids)
        model = self.model
        raw = b"".join(map(model.printed.__getitem__, numbers))
        first = next((i for i in numbers if i not in model.controls), None)
        if first is not None and model.piece[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._mended(numbers)

    def _mended(self, numbers) -> str:
        """As decode, where bytes of a run that are no UTF-8 become replacement characters, one each."""
        model, out, run = self.model, [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    width = 1
                    out.append("�")
                at += width
            run.clear()

        first = True
        for i in numbers:
            if i in model.single:
                run.append(model.single[i])
                first = False
                continue
            flush()
            text = model.printed[i].decode()
            if first and i not in model.controls:
                text = text[1:] if model.piece[i].startswith(SPACE) else text
                first = False
            out.append(text)
        flush()
        return "".join(out)


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, and token ids if asked for.

    A missing text is empty and has the begin and end tokens alone; a missing doc_id stays
    missing; repeated rows give repeated rows; other columns are ignored.  ``round_trip``
    tells whether decoding gives the text back.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    if keep_ids:
        schema += ", ids binary"
    codecs: list[Codec] = []

    def run(batch):
        if not codecs:
            codecs.append(Codec(model_path))
        codec = codecs[0]
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip")}
        kept = []
        for text in batch.column("text").to_pylist():
            ids = codec.encode(text)
            back = codec.decode(ids)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            out["round_trip"].append(back == text)
            if keep_ids:
                kept.append(ids)
        return {"doc_id": batch.column("doc_id"), **out, **({"ids": kept} if keep_ids else {})}

    return map_rows(documents(docs), run, schema)
