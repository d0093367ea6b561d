"""Cheapest repair of conversations, with an audit of every edit.

A conversation is a sequence of rows; each is kept, given another role or deleted, and empty rows may
be inserted, so that the roles read system?, then user and assistant in turn.  A row matters to the
search only by a code (what its role's initial is, whether it must go, whether it is cut off), so a
conversation is a short string of codes.

The search is a dynamic programme over codes and the four states of the role pattern.  Each state's
cheapest edits so far are a linked node (``audits.Audits``): extending shares the whole prefix, and
ties are decided by a search for the longest common prefix.  A long conversation is cut into segments.
Each segment is solved for every state it may begin in, in tasks of their own, and a fold over its
segments joins the pieces; its texts are hashed in one pass over its segments in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmart.llm.audits import Audits
from spanmart.llm.common import arrow_schema, map_rows, with_library, written
from spanmart.operators.hotkeys import find_hot_keys
from spanmart.operators.ordinals import running_ordinal

# Rows of a conversation that one task looks at together.
SEGMENT = 256

# White space, sentence ends, and what a change costs.
SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

# States of the role pattern: nothing yet, a system row, ends with user, ends with assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
STEP = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
# The only role among user and assistant that may follow.
NEXT = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ACCEPTED = (NOTHING, ASSISTANT)

# A row's code: the initial of its role (x for any other) in lower case; upper case when it is
# truncated; a minus when it is blank or a duplicate and must be deleted.
MUST_GO = "-"

RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


# ------------------------------------------------------------------ rows


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after damage by the checksum of conversation and turn.

    A missing role, text or number is one space, also in the checksum; ``copies`` is 2 for a repeated row.
    """
    shown = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")) % 20
    out = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"),
        rows["turn"].cast("long").alias("turn"),
        shown("role").alias("role"),
        shown("text").alias("text"),
        kind.alias("kind"),
    )
    k = F.col("kind")
    return out.filter(k != 0).select(
        "conv_id",
        "turn",
        F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 3, 2).otherwise(1).alias("copies"),
    )


# ------------------------------------------------------------------ search


def solve(codes: str, entry: int, audits: Audits | None = None) -> list[tuple[int, str] | None]:
    """For each state the cheapest (cost, audit) that leads from ``entry`` to it; ties: the smallest audit."""
    audits = Audits() if audits is None else audits
    best: list[tuple[int, int] | None] = [None] * STATES
    best[entry] = (0, audits.empty)

    def offer(into: list, state: int, cost: int, node: int, edit: str) -> bool:
        old = into[state]
        if old is not None and old[0] < cost:
            return False
        made = audits.extend(node, edit)
        if old is not None and old[0] == cost and not audits.less(made, old[1]):
            return False
        into[state] = (cost, made)
        return True

    def insert(into: list) -> None:
        # An insertion costs more than none, so a state is never entered twice.
        moved = True
        while moved:
            moved = False
            for state in range(STATES):
                if into[state] is not None:
                    cost, node = into[state]
                    moved |= offer(into, STEP[state, NEXT[state]], cost + INSERT_COST, node, INSERT)

    insert(best)
    for code in codes:
        after: list[tuple[int, int] | None] = [None] * STATES
        initial = code.lower()
        extra = TRUNCATED_COST if code != initial else 0
        for state, reached in enumerate(best):
            if reached is None:
                continue
            cost, node = reached
            offer(after, state, cost + DELETE_COST, node, DELETE)
            if code == MUST_GO:
                continue
            if (state, initial) in STEP:
                offer(after, STEP[state, initial], cost + extra, node, KEEP)
            offer(after, STEP[state, NEXT[state]], cost + REROLE_COST + extra, node, REROLE)
        insert(after)
        best = after
    return [None if x is None else (x[0], audits.text(x[1])) for x in best]


def joined(segments: list[list[list[tuple[int, str] | None]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its segments' solutions by entry and exit state."""
    audits = Audits()
    best: list[tuple[int, int] | None] = [None] * STATES
    best[NOTHING] = (0, audits.empty)
    for solutions in segments:
        after: list[tuple[int, int] | None] = [None] * STATES
        for entry, reached in enumerate(best):
            if reached is None:
                continue
            for state, found in enumerate(solutions[entry]):
                if found is None:
                    continue
                cost = reached[0] + found[0]
                old = after[state]
                if old is not None and old[0] < cost:
                    continue
                made = audits.extend(reached[1], found[1])
                if old is None or cost < old[0] or audits.less(made, old[1]):
                    after[state] = (cost, made)
        best = after
    return accepted([None if x is None else (x[0], audits.text(x[1])) for x in best])


def accepted(solutions: list[tuple[int, str] | None]) -> tuple[int, str]:
    return min(solutions[s] for s in ACCEPTED if solutions[s] is not None)


class Solver:
    """Solutions of code strings, each distinct one found once a batch."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], list] = {}

    def __call__(self, codes: str, entry: int) -> list[tuple[int, str] | None]:
        if (codes, entry) not in self.known:
            if len(self.known) >= 1 << 14:
                self.known.clear()
            self.known[codes, entry] = solve(codes, entry)
        return self.known[codes, entry]


def repaired(audit: str, rows: Iterable[tuple[str, str]], before: str = "") -> Iterator[tuple[str, str]]:
    """Role and text of the rows after the edits; ``before``: role initial of the row that came last."""
    rows = iter(rows)
    last = before
    for edit in audit:
        if edit == INSERT:
            last = "a" if last == "u" else "u"
            yield ROLES[last], ""
            continue
        role, text = next(rows)
        if edit == REROLE:
            last = "a" if last == "u" else "u"
            yield ROLES[last], text
        elif edit == KEEP:
            last = role[:1]
            yield role, text


# ------------------------------------------------------------------ jobs


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task: their rows in an array, all work on one array at a time."""
    row = F.struct("turn", "role", "text", "copies")
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # A repeated row stands next to itself.
    spread = F.flatten(F.transform("rows", lambda r: F.array_repeat(r, r["copies"])))
    held = held.withColumn("rows", spread).select(
        "conv_id", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("turn", "role", "text")]
    )
    solver: list[Solver] = []

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        if not solver:
            solver.append(Solver())
        out = {name: [] for name in RESULT_NAMES}
        for r in batch.to_pylist():
            rows = list(zip(r["roles"], r["texts"], strict=True))
            found = counted(rows)
            cost, audit = accepted(solver[0](found.pop("codes"), NOTHING))
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired(audit, rows)).encode())
            turns = {t for t in r["turns"] if t is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            found |= {"conv_id": r["conv_id"], "gaps": gaps, "cost": cost, "audit": audit}
            for name, value in {**found, "repaired_sha256": digest.hexdigest()}.items():
                out[name].append(value)
        return out

    return map_rows(held, run, RESULT)


WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = frozenset(("su", "ua", "au"))


def counted(rows: list[tuple[str, str]]) -> dict:
    """Faults, illegal neighbours and codes of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    codes = []
    before = None
    for role, text in rows:
        initial = role[:1]
        code = initial if initial in ("s", "u", "a") else "x"
        bare = text.rstrip(WHITE)
        if not bare:
            out["blank"] += 1
            code = MUST_GO
        elif (role, text) in seen:
            out["duplicate"] += 1
            code = MUST_GO
        elif bare[-1] not in ".!?":
            out["truncated"] += 1
            code = code.upper()
        seen.add((role, text))
        codes.append(code)
        out["illegal"] += before is not None and before + initial not in LEGAL
        before = initial
    return {**out, "codes": "".join(codes)}


SOLVED = "conv_id long, segment long, entry int, state int, cost long, audit string"
VERDICT = "conv_id long, cost long, audit string"


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Conversations of any length: rows are numbered, cut into segments and solved segment by segment."""
    spread = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    numbered = written(running_ordinal(spread, ["conv_id"], ["turn", "role", "text", "copy"], "nth").drop("copy"))
    coded = _coded(numbered, segment)
    item = F.struct("nth", "code", "initial")
    held = written(
        coded.groupBy("conv_id", "segment").agg(
            F.sort_array(F.collect_list(item)).alias("rows"),
            *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        )
    )
    solver: list[Solver] = []
    verdict = arrow_schema(VERDICT)

    def solve_all(batch: pa.RecordBatch) -> dict[str, list]:
        if not solver:
            solver.append(Solver())
        made = []
        names = [c.split()[0] for c in SOLVED.split(", ")]
        for r in batch.to_pylist():
            for entry in range(STATES) if r["segment"] else (NOTHING,):
                for state, found in enumerate(solver[0]("".join(r["codes"]), entry)):
                    if found is not None:
                        made.append((r["conv_id"], r["segment"], entry, state, *found))
        return dict(zip(names, map(list, zip(*made, strict=True)), strict=True)) if made else None

    codes = held.select("conv_id", "segment", F.col("rows.code").alias("codes"))
    pieces = map_rows(codes, solve_all, SOLVED)

    def fold(key, table):
        segments: dict[int, list] = {}
        for r in table.to_pylist():
            found = segments.setdefault(r["segment"], [[None] * STATES for _ in range(STATES)])
            found[r["entry"]][r["state"]] = (r["cost"], r["audit"])
        cost, audit = joined([segments[s] for s in sorted(segments)])
        row = {"conv_id": [key[0].as_py()], "cost": [cost], "audit": [audit]}
        return pa.Table.from_pydict(row, schema=verdict)

    # The audit is one value of the result, so one task holds it in any case; texts are not here.
    audits = written(pieces.groupBy("conv_id").applyInArrow(fold, VERDICT))
    spread_of = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = numbered.groupBy("conv_id").agg(F.coalesce(spread_of, F.lit(0)).alias("gaps"))
    key = F.struct("conv_id")
    out = audits.withColumn("key", key)
    for part in (_counts(held), gaps, _hashes(numbered, audits)):
        out = out.join(part.withColumn("key", key).drop("conv_id"), "key")
    return out.select(*RESULT_NAMES)


def _coded(numbered: DataFrame, segment: int) -> DataFrame:
    """Segment, initial, code and faults of every numbered row."""
    # The first row of each role and text; combined before the shuffle, however often a text is repeated.
    row = F.struct("conv_id", "role", "text")
    first = numbered.groupBy("conv_id", "role", "text").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = first.filter(F.col("n") > 1).select(row.alias("row"), "first")
    marked = numbered.withColumn("row", row).join(repeats, "row", "left").drop("row")
    blank = ~F.rlike("text", F.lit(f"[^{SPACE}]"))
    again = ~blank & F.coalesce(F.col("nth") > F.col("first"), F.lit(False))
    truncated = ~blank & ~again & ~F.rlike("text", F.lit(rf"[.!?][{SPACE}]*\z"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    code = F.when(blank | again, F.lit(MUST_GO)).when(truncated, F.upper(known)).otherwise(known)
    return marked.select(
        "conv_id", "nth", F.floor((F.col("nth") - 1) / segment).alias("segment"), initial.alias("initial"),
        code.alias("code"), blank.alias("blank"), again.alias("duplicate"), truncated.alias("truncated"),
    )


def _counts(held: DataFrame) -> DataFrame:
    """Faults and illegal neighbours per conversation, from one narrow row per segment."""
    initials = F.col("rows.initial")
    legal = lambda a, b: F.concat(a, b).isin(*LEGAL)
    pairs = F.zip_with(initials, F.slice(initials, 2, F.size(initials)), lambda a, b: ~F.coalesce(legal(a, b), F.lit(True)))
    borders = held.select(
        "conv_id", "segment", "blank", "duplicate", "truncated", initials[0].alias("head"),
        F.element_at(initials, -1).alias("tail"), F.size(F.filter(pairs, lambda p: p)).alias("inner"),
    )
    before = F.lag("tail").over(Window.partitionBy("conv_id").orderBy("segment"))
    across = (~F.coalesce(legal(before, F.col("head")), F.lit(True))).cast("int")
    return (
        borders.withColumn("illegal", F.col("inner") + across)
        .groupBy("conv_id")
        .agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    )


HASHED = "conv_id long, repaired_sha256 string"


def _hashes(numbered: DataFrame, audits: DataFrame) -> DataFrame:
    """Digest of each long conversation after repair: its rows are read in order, one at a time.

    A digest cannot be split, so a conversation's rows pass one task; it holds none of them but the last.
    """
    rows = numbered.select(F.struct("conv_id").alias("key"), "nth", "role", "text")
    known = audits.select(F.struct("conv_id").alias("key"), "audit")
    # An audit has no number and so comes before its conversation's rows.
    ordered = rows.unionByName(known, allowMissingColumns=True).repartition("key")
    ordered = ordered.sortWithinPartitions("key", F.col("nth").asc_nulls_first())
    arrow = arrow_schema(HASHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading: Reading | None = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["nth"] is None:
                    done += [reading] if reading else []
                    reading = Reading(r["key"]["conv_id"], r["audit"])
                else:
                    reading.row(r["role"], r["text"])
            yield finished(done)
        yield finished([reading] if reading else [])

    def finished(done: list[Reading]) -> pa.RecordBatch:
        columns = {"conv_id": [r.conv_id for r in done], "repaired_sha256": [r.finish() for r in done]}
        return pa.RecordBatch.from_pydict(columns, schema=arrow)

    return with_library(ordered).mapInArrow(run, HASHED)


class Reading:
    """A conversation that is being repaired row by row."""

    def __init__(self, conv_id: int | None, audit: str) -> None:
        self.conv_id, self.audit, self.at = conv_id, audit, 0
        self.digest, self.last, self.some = hashlib.sha256(), "", False

    def _feed(self, edits: str, rows: list[tuple[str, str]]) -> None:
        for role, text in repaired(edits, rows, self.last):
            self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.last, self.some = role[:1], True

    def row(self, role: str, text: str) -> None:
        stop = self.at
        while self.audit[stop] == INSERT:
            stop += 1
        self._feed(self.audit[self.at : stop + 1], [(role, text)])
        self.at = stop + 1

    def finish(self) -> str:
        self._feed(self.audit[self.at :], [])
        return self.digest.hexdigest()


def repaired_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id: faults, cost and audit of the cheapest repair, digest of the repaired rows.

    ``rows`` have conv_id, turn, role and text; other columns are ignored.  A missing conv_id is a
    conversation of its own; a missing turn comes first; a missing role or text is one space; rows of
    one turn are ordered by role and text, and repeated rows are duplicates.  A role without letters
    has no initial and is never kept.  An empty table gives an empty result.
    """
    hurt = damaged(rows)
    size = hurt.select("conv_id", F.lit(0).alias("__lo"), F.lit(0).alias("__hi"))
    long_ones = find_hot_keys([size], ["conv_id"], segment)
    found = _short(long_ones.regular(hurt))
    if long_ones.found:
        found = found.unionByName(_long(long_ones.hot(hurt).select(*hurt.columns), segment))
    every = rows.select(rows["conv_id"].cast("long").alias("conv_id")).distinct()
    every = every.select(F.struct("conv_id").alias("key"))
    found = found.withColumn("key", F.struct("conv_id")).drop("conv_id")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    out = every.join(found, "key", "left")
    return out.select(
        F.col("key.conv_id").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in found.columns if c != "key"],
    )
