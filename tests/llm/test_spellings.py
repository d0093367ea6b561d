"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from spanmart.llm import spellings

SCHEMA = "doc_id long, text string, word string, n string, form string"


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def a_corpus(seed, n_docs=120, stems=40, letters="abé×"):
    """Few letters and long runs of equal ones, so that words have many neighbours and ties."""
    rng = random.Random(seed)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(stems)]
    weights = [1 / (k + 1) for k in range(stems)]

    def word():
        w = rng.choices(made, weights)[0]
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
        return rng.choice([w, w.upper(), w.capitalize()])

    seps = [" ", "\n", "1", "$", ", ", " 日本 "]
    return [(k, "".join(word() + rng.choice(seps) for _ in range(rng.randint(1, 60)))) for k in range(n_docs)]


@pytest.mark.parametrize("seed", range(4))
def test_variants_equal_brute_force(spark, seed):
    rows = a_corpus(seed)
    rows += [rows[0], rows[0], (None, rows[1][1]), (9000, None), (9001, ""), (9002, "aaaaaa " * 3000), (9003, "é" * 5000)]
    rows += [(9004, "mnopq " * 40 + "mnopqr " * 12 + "mnopqrs " * 4)]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(4)
    want = brute(rows)
    assert any(len(w) > 0 and v[0] for w, v in want.items())
    assert any(v[1] != v[0] and v[0] for v in want.values())  # chains of more than one step
    assert found(spellings.variants(docs)) == want


def test_a_word_counts_once_for_runs_of_equal_letters(spark):
    rows = [(1, "aaaaa " * 8 + "aaaaaa " * 4 + "aaaaaaa " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute_words(rows) == {"aaaaa": 8, "aaaaaa": 4, "aaaaaaa": 3}
    assert found(spellings.variants(docs)) == {
        "aaaaa": (None, "aaaaa", 8, 1, None),
        "aaaaaa": ("aaaaa", "aaaaa", 4, 2, 8),
        "aaaaaaa": (None, "aaaaaaa", 3, 1, None),
    }


def test_damage_follows_the_checksum(spark):
    runs = [f"w{''.join(chr(97 + int(d)) for d in str(k))}xyz" for k in range(3000)]
    rows = [(k % 7, (r + " ") * 3) for k, r in enumerate(runs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_words(rows)
    assert sum(w not in set(runs) for w in want) > 1
    assert {r["word"]: r["n"] for r in spellings.words_of(docs).collect()} == want


def test_a_group_never_emits_pairs(spark):
    """Every word emits at most two rows per letter, even where all words are near each other."""
    words = spark.createDataFrame([("aaaa" + chr(0xC0 + k), 3 + k) for k in range(60)], "word string, n long")
    rotated = spellings.rotations(words)
    assert rotated.count() == 60 * (5 + 6)
    got = {r["word"]: (r["n_near"], r["best"]["word"]) for r in spellings.neighbours(rotated).collect()}
    assert got["aaaaÀ"] == (59, "aaaa" + chr(0xC0 + 59))
    assert got["aaaa" + chr(0xC0 + 59)] == (59, "aaaa" + chr(0xC0 + 58))


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        got = spellings.variants(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
        assert got.collect() == []
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
