"""Packing: token ids against the library, placements against their rules and a sequential best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmart.llm import packing
from spanmart.llm.common import written
from spanmart.llm.wordtokens import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, piece string, sequence_id string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def awkward_texts():
    rng = random.Random(3)
    letters = "abcXYZ'.,-0123456789 \t\n\xa0\x1c éÀßµªº÷×İıſKſ日本🙂́ȩ<|>$"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + [
        "", "   \n ", "it's I'LL don't '' 'S", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x" * 5000,
        "don't stop " * 3000, "ÀÉÎ Straße naïve", "a\x85b c d\x1fe", "１２３ ½ ²", "﻿word",
    ]


def test_ids_equal_the_library():
    texts = awkward_texts()
    ids, counts = WordEncoder(PATH).batch(pa.array(texts))
    want = [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_other_vocabularies_take_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = WordEncoder(path)
    assert not encoder.by_words
    texts = ["two words", "", " lead"]
    ids, counts = encoder.batch(pa.array(texts))
    assert ids.tolist() == [i for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False) for i in x.ids]
    assert len(counts) == 3


def check_places(rows, capacity):
    """Sequences are gapless from 0 and no longer than the capacity."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit(lengths, capacity):
    """Plain best fit from long to short, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k, g in enumerate(gaps) if g >= n), key=lambda k: gaps[k], default=None)
        if best is None:
            gaps.append(capacity - n)
        else:
            gaps[best] -= n
    return len(gaps)


def test_documents_are_packed(spark):
    texts = [t * 40 for t in awkward_texts()[:60]] + awkward_texts()[-10:] + [None, "", ""]
    rows = [(k, t, "clash", "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    capacity = 64
    found = packing.packed(docs, PATH, capacity, keep_ids=True).collect()
    tokenizer = library()
    want = defaultdict(int)
    for k, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[k, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    got = defaultdict(int)
    for r in found:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])] += 1
    assert got == want
    n = check_places(found, capacity)
    assert n <= best_fit([r["length"] for r in found], capacity)


def stored_pieces(spark, lengths, parts=5):
    """A stored table of pieces of given lengths, dealt to tasks."""
    seen, rows = defaultdict(int), []
    for k, n in enumerate(lengths):
        rows.append((k, 0, 0, n, 0, k % parts, seen[n, k % parts]))
        seen[n, k % parts] += 1
    return written(spark.createDataFrame(rows, packing.PIECES))


@pytest.mark.parametrize("seed", range(2))
def test_as_few_sequences_as_sequential_best_fit(spark, seed):
    rng = random.Random(seed)
    capacity = 100
    lengths = [min(capacity, int(rng.expovariate(1 / 25)) + 1) for _ in range(1500)]
    lengths += [1] * 400 + [50] * 300 + [34] * 100  # lengths that hold a third of all pieces
    pieces = stored_pieces(spark, lengths)
    one = packing.placed(pieces, capacity).collect()
    assert len(one) == len(lengths)
    assert check_places(one, capacity) == best_fit(lengths, capacity)
    # Many ranges of sizes, swept apart, cost next to nothing.
    many = packing.placed(pieces, capacity, range_runs=7).collect()
    assert len(many) == len(lengths)
    assert check_places(many, capacity) <= best_fit(lengths, capacity) * 1.01 + 1


def test_runs_do_not_follow_the_number_of_pieces(spark):
    few = spark.createDataFrame([(k, 3 + k % 5) for k in range(1, 101)], "length int, n long")
    many = few.withColumn("n", F.col("n") * 1_000_000)
    runs = [sum(d.count() for d in packing.placements(t, 100)) for t in (few, many)]
    assert runs[1] <= 2 * runs[0]


def test_no_documents(spark):
    got = packing.packed(spark.createDataFrame([], SCHEMA), PATH)
    assert got.collect() == []
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
