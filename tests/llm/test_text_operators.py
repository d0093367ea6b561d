"""The text operators against brute force on small tables, with awkward rows."""

import hashlib
import json
import random
import re
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanmart.llm import (
    decontaminate, disclosure, golay, mincut, pages, passages, quality, secret_scan, sentencepiece, simhash, suffixes, tools,
)
from spanmart.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_words string"


def some_texts(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = [make(rng.randint(80, 200)) for _ in range(n)]
    passage = make(60)
    base += [base[0], base[0], base[1] + " end", make(20) + " " + passage + " " + make(20), passage + " " + make(9)]
    words = base[2].split()
    words[len(words) // 2] = "changed"
    return base + [" ".join(words), "", "   \n\t ", "one", "é ü 日本   🙂 ###", "x" * 30_000, "ab " * 4000, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash", "clash") for i, t in enumerate(some_texts())]
    rows += [(None, "a row without an id " * 5, None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_pieces_equal_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece as library

    path = tokenizers.path("piece_bpe_32k.model")
    model = library.SentencePieceProcessor(model_file=path)
    codec = sentencepiece.Codec(path)
    rng = random.Random(5)
    signs = string.ascii_letters[:20] + "  \n\t.,#é日▁🙂\x00²"
    texts = [t for _, t in plain(docs)] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in [*texts, " " * 37 + "the" + " " * 9, "<s>"]:
        ids = model.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == ids
        assert codec.decode(codec.encode(t)) == model.decode(ids)
    found = sentencepiece.encode_decode(docs, path).collect()
    assert len(found) == docs.count() and sentencepiece.encode_decode(empty, path).count() == 0
    of = {r["doc_id"]: r for r in found}
    for i, t in plain(docs):
        ids = np.array(model.encode(t, add_bos=True, add_eos=True), "<u4")
        assert (of[i]["n_tokens"], of[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_suffixes_equal_brute_force(docs, empty):
    rows = plain(docs)
    first = {}
    for i, t in sorted((i, t.encode()) for i, t in rows if i is not None):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    found = suffixes.removed(docs).collect()
    assert len(found) == len(rows) and suffixes.removed(empty).count() == 0
    of = {r["doc_id"]: r for r in found}
    for i, t in rows:
        if i is None:
            continue
        t = t.encode()
        hit = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                hit[k : k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~hit[:-1]].tobytes()
        spans = int((hit[1:] < hit[:-1]).sum())
        r = of[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), int(hit.sum()), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_longest_previous_factor():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        doc, beside = rng.integers(0, 6, n), rng.integers(0, 4, n) * 25 * (np.arange(n) > 0)
        want = []
        for i in range(n):
            best = 0
            for step, edge in ((-1, lambda j: beside[j + 1]), (1, lambda j: beside[j])):
                j, common = i + step, 1 << 30
                while 0 <= j < n:
                    common = min(common, edge(j))
                    if doc[j] < doc[i]:
                        best = max(best, common)
                        break
                    j += step
            want.append(best if best >= 50 else 0)
        got = suffixes.longest_previous(doc, beside, 50)
        assert [g if g >= 50 else 0 for g in got.tolist()] == want


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500)
    y = x ^ (1 << rng.integers(0, 23, 500)) ^ (1 << rng.integers(0, 23, 500))
    (at, kx), (bt, ky) = golay.keys(x), golay.keys(y)
    for i in range(500):
        assert set(kx[at == i]) & set(ky[bt == i])
    assert set(np.bincount(at)) <= {1, 6}


@pytest.mark.parametrize("paired", [48, 1])
def test_fingerprint_links(spark, paired):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6)
    prints = {int(c) for c in centre}
    for _ in range(120):
        c = int(rng.choice(list(prints)))
        for b in rng.integers(0, 63, int(rng.integers(1, 4))):
            c ^= 1 << int(b)
        prints.add(c)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, paired)).collect()}
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_fingerprints_and_components(docs, empty):
    found = by_id(simhash.near_duplicates(docs))
    assert simhash.near_duplicates(empty).count() == 0
    for i, t in plain(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert found[i]["fingerprint"] == f"{bits:016x}"
    assert found[41]["component_id"] == 0 and found[0]["component_id"] == 0


def test_one_of_each_group_stays(docs, empty):
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns and simhash.deduplicated(empty).count() == 0
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert {0, 1, 2} <= set(kept) and not {40, 41} & set(kept)
    found = by_id(simhash.near_duplicates(docs))
    assert set(kept) == {r["component_id"] for r in found.values() if r["component_id"] is not None} | {
        i for i, r in found.items() if r["component_id"] is None
    }
    # The component by brute force.
    prints = {i: int(r["fingerprint"], 16) for i, r in found.items() if i is not None}
    for i, p in prints.items():
        reach, grown = {i}, True
        while grown:
            more = {j for j, q in prints.items() if j not in reach and any((q ^ prints[k]).bit_count() <= 2 for k in reach)}
            grown = bool(more)
            reach |= more
        assert (i in kept) == (i == min(reach)) and found[i]["component_id"] == min(reach)


def test_quality_counts(docs, empty):
    found = by_id(quality.verdicts(docs))
    assert quality.verdicts(empty).count() == 0
    for i, t in plain(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = set()
        for k, g in enumerate(grams):
            if grams.count(g) > 1 if len(grams) < 500 else len(set(grams)) < 5:
                covered |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        r = found[i]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == len(re.findall("[#*$%&|<>]", t)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    kept = [r["doc_id"] for r in quality.rejected_removed(docs).collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in quality.verdicts(docs).collect() if r["kept"])
    entries = quality.ledger(docs)
    for r in quality.ablation(entries).collect():
        rest = [x for x in quality.POLICIES["v2"] if x != r["rule"]]
        want = entries.where(f"failed_bits & {quality.mask(tuple(rest))} = 0").count()
        assert r["n_kept_without"] == want


@pytest.mark.parametrize("shard", [1 << 24, 600])
def test_contamination(spark, docs, empty, shard):
    texts = [t.split() for _, t in plain(docs)]
    items = [("a", " ".join(texts[0][5:30]).upper()), ("b", " ".join(texts[1][:10])), ("c", " ".join(texts[5][3:7])),
             ("d", ""), ("e", None), (None, "x"), ("f", "é ü"), ("g", "no such words anywhere in it")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = by_id(decontaminate.contamination(docs, bench, shard_bytes=shard))
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for i, t in plain(docs):
        w, hit, names = word(t), set(), set()
        for name, text in items:
            v = word(text or "")
            if not name or not v:
                continue
            n = min(10, len(v))
            for window in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit |= set(range(k, k + n))
                        names.add(name)
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    clean = decontaminate.decontaminated(docs, bench, shard_bytes=shard)
    assert clean.columns == docs.columns
    assert not any(r["contaminated"] for r in decontaminate.contamination(clean, bench).collect())
    untouched = {i for i, r in found.items() if not r["contaminated"]}
    assert untouched <= {r["doc_id"] for r in clean.collect()}
    assert decontaminate.decontaminated(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def calls(rows, spark):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_tool_calls(spark):
    def call(i, name, **arguments):
        return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": json.dumps(arguments)}]})

    rows = [
        (1, 0, "assistant", call("a", "search", query="é \"x\"", limit=3, uses={"$call": "b"})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})),
        (1, 2, "assistant", call("b", "search", limit=99, query=5, more=1)),
        (1, 2, "assistant", call("b", "search", limit=99, query=5, more=1)),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": None})),
        (2, 0, "assistant", call("a", "nothing")), (2, 1, "assistant", "{broken tool_calls"), (None, 1, "tool", "x"),
        (3, 0, "assistant", call("p", "count", words=1, uses={"$call": "q"})),
        (3, 1, "assistant", call("q", "count", words=2, uses={"$call": "p"})), (3, 2, "user", None),
    ]
    found = {(r["conv_id"], r["call_id"]): r for r in tools.linked(calls(rows, spark), tools.DERIVED).collect()}
    a, b = found[1, "a"], found[1, "b"]
    assert a["status"] == "linked" and a["valid"] and a["order_key"] > b["order_key"]
    assert a["canonical"] == '{"arguments":{"limit":3,"query":"é \\"x\\"","uses":{"$call":"b"}},"id":"a","name":"search","result":"ok"}'
    assert b["faults"] == "query is no string; limit out of range; more unknown" and b["n_same"] == 2
    assert found[1, "zz"]["status"] == "no call" and found[2, "a"]["faults"] == "unknown tool"
    assert found[3, "p"]["cyclic"] and found[3, "q"]["cyclic"] and not b["cyclic"]
    assert tools.linked(calls([], spark), tools.DERIVED).count() == 0


def test_secrets(spark, docs, empty):
    rng = random.Random(4)
    rows, secret = [], set()
    for i in range(120):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        if i % 2:
            secret.add(i)
            rows.append((i, f'some words token = "{value}" and more'))
        else:
            rows.append((i, f"see page {value[:10]}-{i}-of-the-long-list and {rng.randint(10**15, 10**16)} more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train, held = df.where("doc_id < 80"), df.where("doc_id >= 80")
    forest = secret_scan.fitted(secret_scan.features(secret_scan.candidates(train)))
    got = {r["doc_id"] for r in secret_scan.scan(held, forest).where("is_secret").collect()}
    assert got == {i for i in secret if i >= 80}
    out = by_id(secret_scan.masked(df))
    assert all(("[SECRET]" in out[i]["text"]) == (i in secret) for i, _ in rows)
    assert secret_scan.scan(empty).count() == 0 and secret_scan.masked(empty).count() == 0
    assert secret_scan.masked(docs).count() == docs.count()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_matches(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            sums = sum((2 * int(c) - 9 * (int(c) > 4)) if j % 2 else int(c) for j, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and sums % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, docs, empty):
    rng = random.Random(6)
    bits = ["a@b.c", "x@y", "+d@e.f.g", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (23) 456-7890", "+1", " ", "é", "🙂", "0000.01.1.1", "..", "@", "12", "-"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(1000, "1" * 20_000), (1001, "a" * 50_000 + "@"), (1002, "1 " * 9000), (1003, "a@" + "b." * 5000 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(disclosure.report(df, min_contexts=10_000))
    for i, t in rows:
        want = base_matches(t)
        assert found[i]["spans"] == ",".join(want)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert found[i]["n_card"] == sum(w.startswith("card") for w in want)
    assert disclosure.report(docs).count() == docs.count() and disclosure.report(empty).count() == 0


def test_terms_that_reveal(spark):
    rows = [(i, f"{w} quetzal writes from boss@firm.example about {w}") for i, w in enumerate(["red", "blue", "green", "grey"])]
    rows += [(100 + i, f"plain text number {i} writes from here about things") for i in range(400)]
    rows += [(900, "Quetzal was seen again")]
    found = by_id(disclosure.report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[900]["spans"] == "term:0:7" and found[100]["spans"] == ""
    assert found[0]["spans"].split(",")[0] == "term:4:11" and found[0]["spans"].count("term") == 1
    clean = by_id(disclosure.sanitised(spark.createDataFrame(rows, "doc_id long, text string")))
    assert clean[900]["text"] == "[TERM] was seen again" and clean[0]["text"].startswith("red [TERM] writes from [EMAIL]")


def test_minimum_cut_is_least():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(2 * n)]

        def total(label, costs=costs, edges=edges):
            return sum(c for c, x in zip(costs, label, strict=True) if x) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(total([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(total(mincut.minimum_cut(costs, edges)) - best) < 1e-6


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body class='sidebar'><nav><a href=x>Home</a></nav>"
        "<div class='ad'>Buy now.</div><article><header><h1>Big &amp; small</h1></header><p>One <b>bold</b>\n line &lt;here&gt;.<p>No."
        "<aside>See also this.</aside></article><section id=comments><p>Nice article, thanks a lot.</p></section>"
        "<form>Mail <input></form><footer>&copy; 2020"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<!-- never closed"), (4, "u", "<" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in pages.main_texts(df).collect()}
    assert found[1]["text"] == "Big & small\nOne bold line <here>.\nNo."
    assert found[2]["text"] == "" and found[3]["n_chars"] == 0 and len(found) == 5
    assert pages.main_texts(df.where("false")).count() == 0


def test_passages(spark, docs, empty):
    found = passages.repeated(docs).collect()
    assert len(found) == docs.count() and passages.repeated(empty).count() == 0
    of = {r["doc_id"]: r for r in found}
    assert of[40]["sources"] == "0" and of[40]["n_repeated"] == of[40]["n_words"]
    assert of[44]["sources"] == "43" and abs(of[44]["n_repeated"] - 60) <= 2
    assert of[45]["sources"] == "2" and of[2]["n_repeated"] == 0
    assert all(of[i]["n_repeated"] == 0 for i in range(3, 40))


def test_chains_are_best():
    rng = np.random.default_rng(9)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        x, y = rng.integers(0, 30, n), rng.integers(0, 30, n)
        order = np.lexsort((y, x))
        best = {}
        for i in order:
            best[i] = float(passages.SEED)
            for j in order:
                if x[j] < x[i] and y[j] < y[i] and j in best:
                    dx, dy = x[i] - x[j], y[i] - y[j]
                    gap = passages.GAP_COST * (dx + dy)
                    best[i] = max(best[i], best[j] + passages.SEED - gap + passages.GAP_COST * 2 * passages.SEED if min(dx, dy) >= passages.SEED else best[i])
        for chain in passages.chained(x, y):
            assert (np.diff(x[chain]) > 0).all() and (np.diff(y[chain]) > 0).all()


def test_a_far_chain_hides_no_near_one():
    rng = np.random.default_rng(12)
    for _ in range(40):
        x = np.unique(rng.integers(0, 900, 160))
        y = np.where(rng.random(len(x)) < 0.7, x, rng.integers(0, 900, len(x)))
        best = []
        for i in range(len(x)):
            score = 5.0
            for j in range(i):
                dx, dy = int(x[i] - x[j]), int(y[i] - y[j])
                if 0 < dx <= passages.MAX_GAP and 0 < dy <= passages.MAX_GAP:
                    score = max(score, best[j] + min(5, dx, dy) - 0.1 * (max(0, dx - 5) + max(0, dy - 5)))
            best.append(score)
        top = passages.chained(x, y)[0]
        dx, dy = np.diff(x[top]), np.diff(y[top])
        got = 5 + np.sum(np.minimum(5, np.minimum(dx, dy)) - 0.1 * (np.maximum(0, dx - 5) + np.maximum(0, dy - 5)))
        assert got == pytest.approx(max(best))


def test_passages_apart(spark):
    rng = random.Random(21)
    words = lambda k: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(k))
    one, two = words(200), words(200)
    rows = [(1, f"{one} {words(60)} {two}"), (2, f"{words(30)} {one} {words(60)} {two} {words(30)}")]
    found = by_id(passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[2]["spans"] == "30-230,290-490"


def test_words_have_their_library_hashes():
    rng = random.Random(29)
    texts = ["".join(rng.choice("aZé\x00\x1c0 \t\n\r\x0b\x0c" + "bQ" * 12) for _ in range(rng.randint(0, 400))).encode() for _ in range(300)]
    texts += [b"", b" ", b"A" * 31 + b" " + b"A" * 32 + b" " + b"A" * 900, *(bytes([33]) * n for n in range(40))]
    words = passages.Words(texts)
    want = [[xxhash.xxh64_intdigest(w) for w in t.lower().split()] for t in texts]
    assert np.diff(words.start).tolist() == [len(w) for w in want]
    assert words.hash.tolist() == [h for w in want for h in w]
    assert passages.Words([]).hash.size == passages.Words([b""]).hash.size == 0


def test_words_repeated_over_and_over(spark):
    """Stretches of few words make few pairs of seeds, and are still found in all earlier texts."""
    rng = random.Random(31)
    text = " ".join(f"{w} " * 170 for w in ("to", "the", "of", "in", "ha ho", "to")).encode()
    words = passages.Words([text])
    at, h = words.seeds()
    seen = np.zeros(len(at), passages.SEEN)
    seen["place"], seen["hash"], seen["many"] = at, h, 1
    assert len(at) > 800 and len(passages._near_pairs(seen)[0]) < 250

    def other(n):
        return " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))

    rows = [(i, f"{other(30)} {'la ' * 60}{other(30)}") for i in range(3)] + [(9, f"{other(40)} {'la ' * 300}{other(40)}")]
    found = by_id(passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[9]["spans"] == "40-340" and found[9]["sources"] == "0,1,2"
    assert [found[i]["n_repeated"] for i in range(3)] == [0, 60, 60]


def test_pairs_need_an_earlier_text():
    """A key whose only open places are in the first text of one of its seeds is not asked for."""
    seen = np.zeros(8, passages.SEEN)
    seen["text"], seen["hash"], seen["many"] = np.repeat(np.arange(4), 2), np.tile([2, 4], 4), 1
    seen["place"], seen["open"][:2], seen["begun"][:2] = np.tile([0, 7], 4), 1, 1
    sent = list(passages.send_pairs(1)(0, pa.table({"text": range(4), "seeds": [seen[i : i + 2].tobytes() for i in range(0, 8, 2)]})))
    asked = list(passages.open_pairs(1)(0, [(0, m["data"][0]) for m in sent if m["bucket"] == [0]]))
    assert not asked
    seen["open"][6] = 1
    sent = list(passages.send_pairs(1)(0, pa.table({"text": range(4), "seeds": [seen[i : i + 2].tobytes() for i in range(0, 8, 2)]})))
    assert len(list(passages.open_pairs(1)(0, [(0, m["data"][0]) for m in sent if m["bucket"] == [0]]))) == 1


def test_passages_whose_seeds_began_elsewhere(spark):
    """Every seed of a passage is first held by a text of its own, so that no two of them meet in a first text."""
    rng = random.Random(22)
    words = lambda k: ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(k)]
    rows = []
    for case in range(5):
        whole = words(100)
        for i in range(20):
            rows.append((1000 * case + i, " ".join(words(20) + whole[5 * i : 5 * i + 9] + words(20))))
        changed = [w if k % 14 else words(1)[0] for k, w in enumerate(whole)]
        rows.append((1000 * case + 100, " ".join(words(30) + whole + words(30))))
        rows.append((1000 * case + 101, " ".join(words(40) + whole + words(20))))
        rows.append((1000 * case + 102, " ".join(words(10) + changed + words(60))))
    found = by_id(passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")))
    for case in range(5):
        assert found[1000 * case + 100]["n_repeated"] == 0
        assert found[1000 * case + 101]["spans"] == "40-140" and found[1000 * case + 101]["sources"] == str(1000 * case + 100)
        assert found[1000 * case + 102]["n_repeated"] >= 95


def test_common_phrases_hide_no_passage(spark):
    """A phrase that very many texts hold is no passage; the few that share more than it are found among them."""
    rng = random.Random(23)
    words = lambda k: ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(k)]
    phrase, before, after = words(36), words(14), words(9)
    rows = [(i, " ".join(words(40) + phrase + words(40))) for i in range(300)]
    every = [w if k != 4 else words(1)[0] for k, w in enumerate(before)]
    rows.append((400, " ".join(words(40) + before + phrase + after + words(40))))
    rows.append((401, " ".join(words(26) + every + phrase + after + words(40))))
    found = by_id(passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(found[i]["n_repeated"] == 0 for i in [*range(300), 400])
    assert found[401]["sources"] == "400" and found[401]["spans"].endswith("-85") and found[401]["n_repeated"] >= 54


def test_secrets_without_quotes(spark):
    rng = random.Random(14)
    mixed = lambda k: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(k - 2)) + "7q"
    forms = [
        lambda: f"export API_TOKEN={mixed(16)}", lambda: f"password: {mixed(10)}", lambda: f'api_key = "{mixed(16)}"',
        lambda: f"login with ghp_{mixed(36)} today", lambda: f"send eyJ{mixed(20)}.{mixed(30)}.{mixed(24)} along",
        lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{mixed(60)}\n{mixed(40)}\n-----END RSA PRIVATE KEY-----",
        lambda: f"postgres://reader@db1:5432/?auth_token={mixed(24)}",
    ]
    plain = [lambda: f"PAGE_NAME=part-{rng.randint(100, 999)}-of-the-long-list", lambda: f"see src/main/module_{rng.randint(10, 99)}/file"]
    rows = [(i, f"some words {(forms + plain)[i % 9]()} and more") for i in range(270)]
    out = by_id(secret_scan.masked(spark.createDataFrame(rows, "doc_id long, text string")))
    left = [out[i]["text"] for i, _ in rows if ("[SECRET]" in out[i]["text"]) != (i % 9 < 7)]
    assert not left
    assert out[0]["text"] == "some words export API_TOKEN=[SECRET] and more"
    assert out[4]["text"] == "some words send [SECRET] along and more" and "KEY" not in out[5]["text"]


def test_layout_names_do_not_drop_the_article():
    prose = "The river rose in the night, and by morning, the lower streets stood under water. Nobody was hurt."
    weights = np.array([-1.0, 1.0, -1.0, -2.0, 1.0, 1.0, 0.0, -1.0, 0.0])
    side = "<div class='sidebar'><p>Menu</p></div><div class='site-footer'><p>All rights kept</p></div>"
    for wrap in ("class='content-sidebar-wrap'", "class='has-sidebar'", "id='page-with-menu'", "class='search'"):
        page = f"<body><div {wrap}><main><article><p>{prose}</p></article></main></div>{side}"
        assert pages.extract(page, weights) == prose
        page = f"<body><div {wrap}><p>{prose}</p><p>{prose}</p></div>{side}"
        assert pages.extract(page, weights) == f"{prose}\n{prose}"
    for name in ("search", "share", "related", "notice", "section-header notice"):
        page = f"<body><article><p>{prose}</p><div class='{name}'><p>{prose}</p></div></article>{side}"
        assert pages.extract(page, weights) == f"{prose}\n{prose}"
    assert pages.extract(f"<body><article><p>{prose}</p></article><div class='comments'><p>{prose}</p></div>", weights) == prose


def placed(calls, uses):
    """Places by peeling calls without unplaced uses, and what is left."""
    place, left = {}, set(calls)
    while ready := [c for c in left if all(u in place for u in uses[c])]:
        for c in ready:
            place[c] = max([(*calls[c], 0)] + [(*place[u][:2], place[u][2] + 1) for u in uses[c]])
        left -= set(ready)
    return place, left


def test_order_equals_peeling(spark):
    rng = random.Random(3)
    rows, edges, want = [], [], {}

    def add(conv, calls, uses):
        place, left = placed(calls, uses)
        rows.extend((conv, c, *calls[c]) for c in calls)
        edges.extend((conv, c, u) for c in calls for u in uses[c])
        want.update({(conv, c): (place.get(c, (*calls[c], 0)), c in left) for c in calls})

    for conv in range(30):
        calls = {f"c{i}": (rng.randint(0, 30), 0) for i in range(rng.randint(1, 20))}
        names = list(calls)
        order = rng.sample(names, len(names))
        # Every other conversation may have circles.
        pools = {c: order[:i] if conv % 2 else names for i, c in enumerate(order)}
        add(conv, calls, {c: set(rng.sample(p, min(rng.choice([0, 1, 1, 2]), len(p)))) for c, p in pools.items()})
    # An acyclic chain of 200 calls, with a circle of seven beside it that others build on.
    calls = {f"c{i}": (i, 0) for i in range(230)}
    uses = {f"c{i}": {f"c{i + 1}"} if i < 199 else set() for i in range(230)}
    uses |= {f"c{200 + i}": {f"c{200 + (i + 1) % 7}"} for i in range(7)} | {"c210": {"c205"}, "c220": {"c0", "c1"}}
    add(100, calls, uses)
    got = tools._ordered(
        spark.createDataFrame(rows, "conv_id long, call_id string, turn long, place int"),
        spark.createDataFrame(edges, "conv_id long, call_id string, used string"),
    ).collect()
    found = {(r["conv_id"], r["call_id"]): ((r["at_turn"], r["at_place"], r["depth"]), r["cyclic"]) for r in got}
    assert len(got) == len(want) and found == want
    assert not found[100, "c0"][1] and found[100, "c210"][1]


def test_tool_messages_without_turn(spark):
    call = lambda name: json.dumps({"tool_calls": [{"id": "a", "name": name, "arguments": json.dumps({"words": 2})}]})
    rows = [
        (1, None, "assistant", call("search")), (1, 5, "assistant", call("count")),
        (1, None, "tool", json.dumps({"tool_call_id": "a", "content": "late"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})),
        (2, None, "assistant", call("count")), (2, 0, "assistant", call("count").replace('"a"', '"b"')),
        (3, 1, "assistant", call("count").replace("2", "2" * 4000)),
    ]
    df = calls(rows, spark).withColumn("name", F.lit("clash")).withColumn("status", F.lit("clash"))
    found = {(r["conv_id"], r["call_id"]): r for r in tools.linked(df, tools.DERIVED).collect()}
    r = found[1, "a"]
    assert (r["name"], r["turn"], r["result_turn"], r["status"], r["n_same"]) == ("count", 5, 6, "linked", 2)
    assert found[2, "a"]["turn"] is None and found[2, "a"]["status"] == "no result"
    assert found[2, "a"]["order_key"] > found[2, "b"]["order_key"]
    assert found[3, "a"]["faults"] and len(found) == 4


def test_a_shared_signature_reveals(spark):
    words = lambda i: " ".join(f"w{chr(97 + i * k % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for k in (1, 3, 5))
    rows = [(i, f"{words(i)} and so on. Regards, Quetzal, boss@firm.example") for i in range(200)]
    rows += [(1000 + i, f"{words(i)} and so on. Regards") for i in range(14_000)]
    # Copies of one text reveal nothing: a name and an address that stand in it alone.
    rows += [(20_000 + i, "Axolotl writes from x@y.example") for i in range(50)]
    # Far from the address in the text.
    rows += [(30_000 + i, f"Okapi {words(i)} {'so on ' * 200} mail z@firm.example") for i in range(5)] + [(31_000, "seen: OKAPI")]
    found = by_id(disclosure.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    for i, t in rows[:200]:
        assert f"term:{t.index('Quetzal')}:{t.index('Quetzal') + 7}" in found[i]["spans"].split(",")
    assert found[20_000]["spans"] == "email:20:31"
    assert found[31_000]["spans"] == "term:6:11" and "term" not in found[1500]["spans"]


def test_terms_equal_counting(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(500):
        # Some words are used beside one entity more than elsewhere.
        k = rng.randrange(3) if i % 12 == 0 else None
        own = "" if k is None else ("p@q.r", "s@t.u", "10.0.0.7")[k]
        near = vocabulary[12:] if k is None else vocabulary[4 * k : 4 * k + 4]
        rows.append((i, " ".join([*rng.choices(vocabulary, k=rng.randint(3, 9)), own, *rng.choices(near, k=3)])))
    rows += [(600 + i, rows[12][1]) for i in range(6)]
    limits = {"min_contexts": 2, "min_probability": 0.2, "min_bits": 1.0}
    holds = [(t, {w for w in t.split() if w.isalpha()}, {w for w in t.split() if "@" in w or w == "10.0.0.7"}) for _, t in rows]
    over = set()
    for e in ("p@q.r", "s@t.u", "10.0.0.7"):
        n_entity = sum(e in x for _, _, x in holds)
        for w in vocabulary:
            both = [t for t, ws, x in holds if w in ws and e in x]
            n_term = sum(w in ws for _, ws, _ in holds)
            if len(set(both)) >= 2 and len(both) >= 0.2 * n_term and np.log2(len(both) * len(rows) / (n_term * n_entity)) >= 1:
                over.add(w)
    found = by_id(disclosure.sanitised_spans(spark.createDataFrame(rows, "doc_id long, text string"), **limits))
    assert 3 <= len(over) < 40
    for i, t in rows:
        assert {p["value"] for p in found[i]["terms"] or []} == over & set(t.split())


def test_suffixes_of_a_bucket_in_bounded_memory():
    """A bucket's suffixes are many times its rows: they are not sorted all at once."""
    rng = np.random.default_rng(5)
    n = 120_000
    data = rng.integers(97, 123, (n, suffixes.AROUND), dtype=np.uint8)
    data[1::2] = data[::2]
    data[1::2, 0] ^= 1  # all strings but the one that begins at the first byte
    asked = np.full(n, (1 << (suffixes.BACK + 1)) - 1, np.uint32)
    doc = np.arange(n)
    tracemalloc.start()
    seen = suffixes.judged(data.view("V76").ravel(), asked, doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not seen[::2].any() and (seen[1::2] == asked[1::2] & ~np.uint32(1 << suffixes.BACK)).all()
    assert peak < 250 << 20


def test_suffixes_ask_about_few_bytes():
    """Questions about shared anchors are most of what is shuffled: as messages they are well under their 92 bytes a row."""
    rng = random.Random(23)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    texts = [[" ".join([*rng.choices(words, k=9), s, *rng.choices(words, k=9)]).encode() for s in shared] for _ in range(2)]
    ids = [np.arange(300), np.arange(300, 600)]
    sent = [m for c in (0, 1) for m in suffixes.send_anchors(1)(c, ids[c], texts[c], [])]
    told = list(suffixes.shared_anchors(0, [(m["chunk"][0], m["data"][0]) for m in sent]))
    rows = size = 0
    for c in (0, 1):
        own = [(0, m["data"][0]) for m in told if m["chunk"] == [c]]
        rows += len(suffixes.Entries(ids[c], texts[c], own, 1).around)
        size += sum(len(m["data"][0]) for m in suffixes.ask(1)(c, ids[c], texts[c], own))
    assert rows > 10_000 and size < 50 * rows


def test_suffixes_with_zero_bytes(spark):
    rng = random.Random(19)
    rows = []
    for i in range(60):
        t = "".join(rng.choice(string.ascii_letters) for _ in range(60))
        rows += [(2 * i, t), (2 * i + 1, t + "\0" * 10), (1000 + i, "\0" * 5 + t)]
    found = by_id(suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(found[2 * i]["n_removed"] == 0 and found[2 * i + 1]["n_removed"] == 60 for i in range(60))
    assert all(found[1000 + i]["n_removed"] == 60 for i in range(60))


def test_open_elements_hide_no_text():
    prose = "The river rose in the night, and by morning, the lower streets stood under water. Nobody was hurt."
    weights = np.array([-1.0, 1.0, -1.0, -2.0, 1.0, 1.0, 0.0, -1.0, 0.0])
    article = f"<article><p>{prose}</p></article><div class='sidebar'><p>Menu</p></div><footer><p>All rights kept</p></footer>"
    home = "<nav><a href=y>Home</a></nav>"
    for page in (
        f"<html><head><title>a <p> b</title><meta charset=x><script>'<p>'</script>{article}",
        f"<html><head><title>T</title><noscript><p>Enable it</p></noscript><body>{article}",
        f"<head>{prose}",
        f"<body><article><svg><path d=1><p>{prose}</p></article>",
        f"<body><article><button>Buy<p>{prose}</p></article>",
        f"<body><article><button>Buy<button>Sell</button><p>{prose}</p></article>",
        f"<body><article><button><div>Buy</div> now</button><p>{prose}</p></article>",
        f"<body><div><svg><g></div>{article}<svg></svg>",
        f"<body><div><select><option>One</div>{article}<select></select>",
        f"<body><article><svg><svg><text>x</text></svg><text>y</text></svg><p>{prose}</p></article>",
        f"<body><form action=x>{home}<main><p>{prose}</p></main></form>",
        f"<body><form action=x>{home}{article}</form>",
        f"<body><form action=x>{home}<div><p>{prose}</p></div></form>",
        f"<body><div role=form><main><p>{prose}</p></main></div>",
        f"<body><article><p>{prose}</p><form><p>Your name and mail, please, and a comment.</p></form></article>",
    ):
        assert pages.extract(page, weights) == prose


def test_pages_awkward_rows(spark):
    page = "<body><nav>Home</nav><article><p>One line of the text, and more.</p></article><footer>End</footer>"
    long = "<body><article>" + "<p>Some words of a long page, with a stop.</p>" * 3000 + "</article>"
    rows = [(1, None, page, "a"), (1, None, page, "a"), (2, "u", long, "b"), (None, "u", page, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("clash"))
    found = pages.main_texts(df).collect()
    assert len(found) == 4 and [r["text"] for r in found if r["page_id"] == 1] == ["One line of the text, and more."] * 2
    line = "Some words of a long page, with a stop."
    assert found[2]["text"] == "\n".join([line] * 3000)
    assert pages.train(df, most=1) == [0.0] * pages.FEATURES


def test_masked_rows(spark):
    key = "ghp_" + "aB3dE6gH9j" * 4
    rows = [(1, f"token {key} here", "a"), (1, f"token {key} here", "a"), (2, None, "b"), (None, f"token {key} here", None), (3, "", "c")]
    rows += [(10 + i, f"see page {i}0-of-the-very-long-list-of-pages", "d") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string").withColumn("key", F.lit("clash"))
    out = secret_scan.masked(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect() if r["doc_id"] is None or r["doc_id"] < 10), key=str)
    hidden = "token [SECRET] here"
    assert got == sorted([(False, 1, hidden), (False, 1, hidden), (False, 2, None), (True, 0, hidden), (False, 3, "")], key=str)
    text = F.col("text")
    both = df.na.fill("", ["text"]).select((F.size(secret_scan.candidate_spans(text)) > 0).alias("a"), secret_scan.has_candidates(text).alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())


def test_messages_follow_the_texts_and_not_the_partitions(spark):
    """Repeated passages and byte matches: chunks times buckets must not grow with a session's many partitions."""
    from spanmart.llm import chunks

    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(80))) for i in range(40)]
    docs = chunks.with_keys(spark.createDataFrame(rows, "doc_id long, text string"))
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def sent(sender, dealt):
        n = chunks.chunk_count(docs)
        fn = sender(chunks.bucket_count(n))
        return chunks.per_chunk(dealt(docs, n), None, fn, chunks.PACKED).count()

    found = []
    try:
        for partitions in ("40", "160"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(
                (
                    sent(suffixes.send_anchors, chunks.dealt_rows),
                    sent(passages.send_seeds, chunks.distinct_texts),
                )
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_chunks_grow_with_the_texts(spark, monkeypatch):
    from spanmart.llm import chunks

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(10)], "doc_id long, text string")
    assert chunks.chunk_count(docs) == chunks.CHUNKS * 2  # the session has two partitions
    monkeypatch.setattr(chunks, "FEW_CHUNKS", 1)
    assert chunks.chunk_count(docs) == 1
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 250)
    assert chunks.chunk_count(docs) == 4
