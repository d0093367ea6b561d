"""SimHash near duplicates, with Golay-code fuzzy hashing to find close fingerprints.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Of 2 differing bits some
segment has none, and each of the others at most 2.  So close fingerprints agree in a segment
and share a codeword index of the segment after it: each fingerprint gets a key for every
index of that segment (1 or 6) and every choice of the agreeing one.  Fingerprints that meet
under a key are joined and their distance is verified.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmart.llm import golay
from spanmart.llm.common import NO_ID, binaries, cut, documents, map_rows, sha256_hex
from spanmart.llm.components import connected_components

SEED = 42
RADIUS = 2
SEGMENTS = ((0, 23), (23, 23), (46, 18))
# Fingerprints under one key that are compared with each other; more are linked through their common neighbours.
PAIRED = 48


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; fewer words than ``size`` are one shingle."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        joined = [b" ".join(words)] if words else []
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((digest(s, SEED) for s in joined), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; no hash gives zero."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def run(batch):
        prints = [fingerprint(shingle_hashes(words_of(t), shingle)) for t in binaries(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "fingerprint": np.array(prints, np.uint64).view(np.int64)}

    return map_rows(documents(docs), run, "doc_id long, fingerprint long")


def key_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of all fingerprints."""
    prints = prints.view(np.uint64)
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    places, found = [], []
    for i in range(len(SEGMENTS)):
        at, index = golay.keys(parts[(i + 1) % len(SEGMENTS)])
        places.append(at)
        found.append((np.int64(i) << 40) | (parts[i][at] << golay.DATA) | index)
    return np.concatenate(places), np.concatenate(found)


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(fingerprint, key) for distinct fingerprints."""

    def run(batch):
        prints = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        at, key = key_rows(prints)
        return {"fingerprint": prints[at], "key": key}

    return map_rows(distinct, run, "fingerprint long, key long")


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints within 2 bits of each other.

    Small keys: all pairs under the key, verified.  A key with more than ``paired``
    fingerprints would give the square of its size; there every fingerprint is linked to the
    words at most 1 bit away, which two fingerprints have in common exactly if they are
    within 2 bits.  Only the agreeing segment of the key stays fixed, so those rows grow with
    the fingerprints.  Words that only one fingerprint reaches are dropped, the others are
    linked to their smallest fingerprint.  Both ways give the same components; ``paired`` affects
    speed only.
    """
    keyed = fuzzy_keys(distinct)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    shared = keyed.join(sizes.where("n > 1"), "key")
    few = shared.where(F.col("n") <= paired)
    left = few.select("key", F.col("fingerprint").alias("a"))
    right = few.select("key", F.col("fingerprint").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (_distance("a", "b") <= RADIUS)).select("a", "b")
    many = shared.where(F.col("n") > paired).select("fingerprint").distinct()
    flips = [F.lit(0).cast("long"), *(F.lit(_signed(1 << b)).cast("long") for b in range(64))]
    near = many.select("fingerprint", F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(f) for f in flips])).alias("word"))
    hub = near.groupBy("word").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1")
    joined = near.join(hub, "word").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return pairs.unionByName(joined).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _components(prints: DataFrame) -> DataFrame:
    """(fingerprint, component) of all fingerprints; a component is named by one of its fingerprints."""
    distinct = cut(prints.select("fingerprint").distinct())
    components = connected_components(links(distinct)).withColumnRenamed("node", "fingerprint")
    return distinct.join(components, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, its smallest reachable doc_id.

    Documents of one fingerprint are gathered first, so copies cost one row each however many
    there are.  A missing text has no words and the zero fingerprint; rows without an id get
    their component from the others (missing if there is none); repeated rows give repeated rows;
    other columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle))
    placed = _components(prints)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    joined = cut(placed.join(least, "fingerprint"))
    first = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of = joined.join(first, "component").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id, with the columns it had.

    Rows without an id come after all others, by the hash of their text; of repeated rows one
    stays; missing texts have no words, and the zero fingerprint like any other text without words.
    """
    names = docs.columns
    plain = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(names)])
    text, key = (f"__{names.index(c)}" for c in ("text", "doc_id"))
    marked = plain.withColumns({
        "doc_id": F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)),
        "text_hash": F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256),
    })

    def run(batch):
        texts = binaries(batch.column("text"))
        prints = [fingerprint(shingle_hashes(words_of(t), shingle)) for t in texts]
        return {
            "doc_id": batch.column("doc_id"), "text_hash": [sha256_hex(t) for t in texts],
            "fingerprint": np.array(prints, np.uint64).view(np.int64),
        }

    told = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rows = map_rows(told, run, "doc_id long, text_hash string, fingerprint long")
    prints = cut(rows.groupBy("doc_id", "text_hash", "fingerprint").agg(F.count("*").alias("n_rows")))
    # The first of each fingerprint before they meet, so that copies cost no join.
    least = prints.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_hash", "n_rows")).alias("first"))
    first = (
        least.join(_components(prints), "fingerprint").groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    )
    found = marked.join(first, ["doc_id", "text_hash"])
    once = found.where("n_rows = 1")
    again = found.where("n_rows > 1").dropDuplicates(["doc_id", "text_hash"])
    return once.unionByName(again).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
