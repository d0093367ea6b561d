"""Strings that share their prefixes, compared without being written out.

A node is a string made by appending a piece to another node's string; nothing is ever copied or
changed, so thousands of strings that begin alike cost one node each.  Every node keeps its length,
a rolling hash of the whole string, and its ancestors at distances one, two, four and so on.  The
hash of any prefix is then found in logarithmic time, and so is the longest common prefix of two
strings.  Equal hashes are taken as a hint: what they say is verified on the letters, back to the
node where both strings part.
"""

from __future__ import annotations

BASE = 1_000_003
MODULUS = (1 << 61) - 1


class Audits:
    """``modulus`` may be small in tests, to make hashes collide."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.empty = 0
        self.piece = [""]
        self.length = [0]
        self.hash = [0]
        self.up: list[tuple[int, ...]] = [()]
        self.power = [1]

    def _power(self, n: int) -> int:
        while len(self.power) <= n:
            self.power.append(self.power[-1] * BASE % self.modulus)
        return self.power[n]

    def _hashed(self, start: int, piece: str) -> int:
        for c in piece:
            start = (start * BASE + ord(c)) % self.modulus
        return start

    def extend(self, node: int, piece: str) -> int:
        """The node of ``node``'s string and ``piece`` behind it."""
        if not piece:
            return node
        up = [node]
        while len(self.up[up[-1]]) > len(up) - 1:
            up.append(self.up[up[-1]][len(up) - 1])
        self.piece.append(piece)
        self.length.append(self.length[node] + len(piece))
        self.hash.append(self._hashed(self.hash[node], piece))
        self.up.append(tuple(up))
        return len(self.piece) - 1

    def holder(self, node: int, n: int) -> int:
        """The first node on the way to ``node`` whose string has ``n`` letters or more."""
        for k in range(len(self.up[node]) - 1, -1, -1):
            if k < len(self.up[node]) and self.length[self.up[node][k]] >= n:
                node = self.up[node][k]
        return node

    def _at(self, node: int, n: int) -> tuple[int, int]:
        """Holder of the first ``n`` letters, and how many letters of its piece belong to them."""
        node = self.holder(node, n)
        return node, n - self.length[node] + len(self.piece[node])

    def prefix_hash(self, node: int, n: int) -> int:
        if not n:
            return 0
        node, part = self._at(node, n)
        if part == len(self.piece[node]):
            return self.hash[node]
        return self._hashed(self.hash[self.up[node][0]], self.piece[node][:part])

    def letter(self, node: int, k: int) -> str:
        node, part = self._at(node, k + 1)
        return self.piece[node][part - 1]

    def text(self, node: int, least: int = 0) -> str:
        """The string from its letter ``least`` on."""
        found = []
        while self.length[node] > least:
            found.append(self.piece[node])
            node = self.up[node][0]
        return "".join(reversed(found))[least - self.length[node] :]

    def _parting(self, a: int, b: int) -> int:
        """Letters of a prefix that both strings share as nodes, without looking at letters."""
        while a != b:
            # Pieces differ in length, so that the longer string gives way.
            if self.length[a] >= self.length[b]:
                a = self.up[a][0]
            else:
                b = self.up[b][0]
        return self.length[a]

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        low, high = 0, min(self.length[a], self.length[b])
        if self.prefix_hash(a, high) == self.prefix_hash(b, high):
            low = high
        while low < high:
            middle = (low + high + 1) // 2
            if self.prefix_hash(a, middle) == self.prefix_hash(b, middle):
                low = middle
            else:
                high = middle - 1
        # Verified on the letters that the two strings do not share as nodes.
        parted = min(self._parting(a, b), low)
        x, y = self.text(self.holder(a, low), parted), self.text(self.holder(b, low), parted)
        x, y = x[: low - parted], y[: low - parted]
        if x != y:
            return parted + next(k for k, (p, q) in enumerate(zip(x, y, strict=True)) if p != q)
        return low

    def less(self, a: int, b: int) -> bool:
        """Whether a's string is smaller than b's."""
        if a == b:
            return False
        n = self.common(a, b)
        if n == min(self.length[a], self.length[b]):
            return self.length[a] < self.length[b]
        return self.letter(a, n) < self.letter(b, n)
