"""Token ids of whole texts by the tokenizers library, one call per distinct word.

The vocabulary drops white space and never joins what white space parts, so a text's ids are those
of its words in order.  A batch is split at white space, every distinct word is encoded once, and the
ids are put in place again by Arrow.  Words of plain letters, digits and signs are cut into the
vocabulary's own pieces here and only these go to the library's model; every other word goes through
the library whole.  Any other vocabulary file is given whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The pre-tokenizer's pattern of the vocabularies that can be encoded word by word.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters on which Python and the library agree about case, composition and classes.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# Pieces whose ids a worker remembers.
REMEMBERED = 1 << 18


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _by_words(spec: dict) -> bool:
    """Whether the file is of the kind that drops white space and lower-cases."""
    kinds = lambda part, name: [x.get("type") for x in (spec.get(part) or {}).get(name, [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
        and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        and split.get("pattern") == {"Regex": WORD_PATTERN}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and not any(re.search(r"\s", x["content"]) for x in spec["added_tokens"])
    )


class WordEncoder:
    """Ids of a batch of texts, as the library gives them without special tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # One core per task.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            source = file.read()
        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.by_words = _by_words(spec)
        marks = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.marks = re.compile("|".join(marks) or r"(?!)", re.IGNORECASE)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.known: dict[str, list[int]] = {}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            shown = piece.encode().decode("latin-1").translate(self.letters)
            ids = self.known[piece] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int] | None] = []
        odd: list[int] = []
        for k, word in enumerate(words):
            if PLAIN.fullmatch(word) and not self.marks.search(word):
                ids: list[int] = []
                for piece in PIECES.findall(word.lower()):
                    ids += self._piece(piece)
                out.append(ids)
            else:
                odd.append(k)
                out.append(None)
        for k, ids in zip(odd, self._whole([words[k] for k in odd]), strict=True):
            out[k] = ids
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of each text's ids."""
        if not self.by_words:
            found = self._whole(texts.to_pylist())
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = np.asarray(split.offsets, dtype=np.int64)
        coded = split.values[bounds[0] : bounds[-1]].dictionary_encode()
        ids = self.words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(offsets[-1]))
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.uint32()))
        placed = lists.take(coded.indices)
        ends = np.concatenate(([0], np.cumsum(sizes[np.asarray(coded.indices)])))
        bounds = bounds - bounds[0]
        return np.asarray(placed.flatten(), dtype=np.uint32), ends[bounds[1:]] - ends[bounds[:-1]]
