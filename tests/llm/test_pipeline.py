"""The pipeline from documents to token ids, against brute force by stage."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from spanmart.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def prose(rng, vocabulary, k):
    return " ".join(rng.choice(vocabulary) for _ in range(k)) + "."


def print_of(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stages_equal_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece as library

    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    vocabulary += ["the", "and", "of", "to", "in", "that", "is", "with"] * 40
    texts = [prose(rng, vocabulary, rng.randint(90, 160)) for _ in range(60)]
    texts += [texts[0]] * 20 + ["Note: " + texts[1], "short one", "", None]
    item = prose(rng, vocabulary, 14)
    texts += [f"{prose(rng, vocabulary, 100)} {item} {prose(rng, vocabulary, 60)}"]
    secret = "ghp_" + "aB3dE6gH9j" * 4
    texts += [f"{prose(rng, vocabulary, 100)} login with {secret} today {prose(rng, vocabulary, 30)}"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("x", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}

    accepted = {r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()}
    assert set(range(60)) <= accepted and not {81, 82, 83} & accepted
    prints = {i: print_of(texts[i]) for i in accepted}
    kept = set()
    for i in accepted:
        reach, grown = {i}, True
        while grown:
            more = {j for j, q in prints.items() if j not in reach and any((q ^ prints[k]).bit_count() <= 2 for k in reach)}
            grown = bool(more)
            reach |= more
        if i == min(reach):
            kept.add(i)
    assert set(found) == kept and not set(range(60, 80)) & kept and {84, 85} <= kept
    model = library.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    for i in kept:
        text = texts[i].replace(secret, "[SECRET]")
        if i == 84:
            # The passage is cut; what lies around it stays.
            assert found[i]["n_tokens"] < len(model.encode(text, add_bos=True, add_eos=True))
            continue
        ids = np.array(model.encode(text, add_bos=True, add_eos=True), "<u4")
        assert found[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, base string"
    docs = spark.createDataFrame([(1, None, None, None, None, "a", "b"), (None, "word " * 40, "en", "s", 1, None, None)], schema)
    spark.createDataFrame([("x", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= df.count()
