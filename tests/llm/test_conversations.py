"""Conversation repair against brute force over all edits; linked strings against plain ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from spanmart.llm import conversations
from spanmart.llm.audits import Audits

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string, nth string, segment string"


@pytest.mark.parametrize("modulus", [7, 101, (1 << 61) - 1])
def test_linked_strings_compare_like_plain_ones(modulus):
    """With a small modulus nearly all hashes collide, and only the verification tells strings apart."""
    rng = random.Random(modulus)
    linked, nodes = Audits(modulus), [(0, "")]
    for _ in range(300):
        node, text = rng.choice(nodes[-60:])
        piece = "".join(rng.choice("DIKR" if rng.random() < 0.2 else "KR") for _ in range(rng.choice([1, 1, 1, 5])))
        nodes.append((linked.extend(node, piece), text + piece))
    for _ in range(2500):
        (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
        assert linked.text(a) == x
        common = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert linked.common(a, b) == common
        assert linked.less(a, b) == (x < y)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append(fault)
    return found


def all_repairs(rows, fault, inserts=2):
    """Every way to edit: (cost, audit, repaired rows) with at most some insertions at each place."""
    options = []
    for (_, role, text), f in zip(rows, fault, strict=True):
        extra = 5 * (f == "truncated")
        edits = [("D", 2, None)]
        if f not in ("blank", "duplicate"):
            edits += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        options.append(edits)
    fillers = [()] + [c for k in range(1, inserts + 1) for c in itertools.product(["user", "assistant"], repeat=k)]
    places = [[[("I", 5, (r, "")) for r in f] for f in fillers]]
    for edits in options:
        places += [[[e] for e in edits], places[0]]
    for chosen in itertools.product(*places):
        yield [e for part in chosen for e in part]


def brute(rows):
    rows = damage(rows)
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    fault = faults(rows)
    best = None
    for edits in all_repairs(rows, fault, 2 if len(rows) < 3 else 1):
        kept = [e[2] for e in edits if e[2]]
        if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
            continue
        found = (sum(e[1] for e in edits), "".join(e[0] for e in edits), kept)
        if best is None or found[:2] < best[:2]:
            best = found
        elif found[:2] == best[:2]:
            assert found[2] == best[2]  # the audit tells the repair
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], digest)


def a_conversation(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Assistant"]
    texts = ["Yes.", "No", "", " \t\n", "Why? ", "Stop!", None, "a.b", "Yes."]
    rows = []
    for k in range(n):
        role = ["user", "assistant"][k % 2] if rng.random() < 0.6 else rng.choice(roles)
        turn = rng.choice([k, k, k, k + 3, None, 1])
        rows.append((conv, turn, role, f"text {k}." if rng.random() < 0.5 else rng.choice(texts)))
    return rows


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(4)


def test_repairs_equal_all_edits_tried(spark):
    rng = random.Random(4)
    rows = [r for conv in range(120) for r in a_conversation(rng, conv, rng.choice([1, 2, 3, 3]))]
    rows += [(None, k, "user", "no conversation id.") for k in range(2)] + [(500, 1, "user", "Same.")] * 3
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    want = {conv: brute(part) for conv, part in by_conv.items() if len(damage(part)) <= 4}
    assert len(want) > 100
    # Deleting a row is cheaper than inserting its partner, so that no audit holds an insertion.
    assert any(v[6] == "" for v in want.values()) and not any("I" in v[6] for v in want.values())
    got = found(conversations.repaired_conversations(frame(spark, rows)))
    assert set(got) == set(by_conv)
    assert {k: got[k] for k in want} == want


def plain_search(codes):
    """The same search with whole strings in place of linked ones."""
    best = {(0, s): None for s in range(4)}
    states = {0: (0, "")}

    def closed(states):
        for _ in range(6):
            for s, (cost, text) in list(states.items()):
                to = conversations.STEP[s, conversations.NEXT[s]]
                states[to] = min(states.get(to, (1 << 30, "")), (cost + 5, text + "I"))
        return states

    states = closed(states)
    for code in codes:
        after = {}
        for s, (cost, text) in states.items():
            low = code.lower()
            extra = 5 * (low != code)
            offers = [(s, cost + 2, "D")]
            if code != "-":
                offers.append((conversations.STEP[s, conversations.NEXT[s]], cost + 1 + extra, "R"))
                if (s, low) in conversations.STEP:
                    offers.append((conversations.STEP[s, low], cost + extra, "K"))
            for to, c, edit in offers:
                after[to] = min(after.get(to, (1 << 30, "")), (c, text + edit))
        states = closed(after)
    assert best
    return min(states[s] for s in (0, 3) if s in states)


def test_segments_join_to_the_whole():
    rng = random.Random(8)
    for _ in range(40):
        codes = "".join(rng.choice("uauauasxUAX-") for _ in range(rng.randint(0, 60)))
        want = plain_search(codes)
        assert conversations.accepted(conversations.solve(codes, 0)) == want
        assert conversations.accepted(conversations.solve(codes, 0, Audits(5))) == want
        for size in (1, 7, 25):
            parts = [codes[k : k + size] for k in range(0, len(codes), size)]
            solved = [[conversations.solve(p, entry) for entry in range(4)] for p in parts]
            assert conversations.joined(solved) == want


def test_long_conversations_go_by_segments(spark):
    rng = random.Random(12)
    rows = [r for conv in range(30) for r in a_conversation(rng, conv, rng.choice([2, 5, 9]))]
    rows += a_conversation(rng, 900, 300) + a_conversation(rng, None, 40)  # one holds most rows
    rows += [(901, k, "user", "Ok.") for k in range(50)]
    df = frame(spark, rows)
    whole = found(conversations.repaired_conversations(df))
    assert found(conversations.repaired_conversations(df, segment=4)) == whole
    assert whole[900][6] and whole[901][2] > 30


def test_very_long_text_and_nothing(spark):
    rows = [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "Fine.")]
    got = found(conversations.repaired_conversations(frame(spark, rows)))
    assert got == {1: brute(rows)}
    empty = conversations.repaired_conversations(frame(spark, []))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = found(conversations.repaired_conversations(frame(spark, [(7, gone, "user", "x")])))
    assert got == {7: brute([(7, gone, "user", "x")])}
