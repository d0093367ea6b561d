"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens.  Pieces and the gaps of open sequences are
range-sorted by size and held as runs: pieces of one length with consecutive ranks, sequences of
one gap with consecutive numbers.  A round takes the unplaced pieces of a band of lengths.  Every
size range sweeps its runs from large to small; a piece goes to its successor, the smallest gap that
holds it, and where several want the same gap their ranks decide.  What found no gap in its own
range is swept once more against the gaps left in all ranges, and opens new sequences after that.
Then gaps are updated and the next band's round begins.  A run table has a few rows per distinct
size, whatever the number of documents, so rounds move kilobytes; the pieces themselves are looked
at once to rank them and once to place them.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmart.llm.common import arrow_schema, documents, slices, with_library, written
from spanmart.llm.wordtokens import WordEncoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
RUNS = "kind int, size int, first long, n long, per int, seq long, place int"
# Kinds of run rows: unplaced pieces, gaps, placed pieces.
PIECE, GAP, PLACED = 0, 1, 2
# Runs that one range of sizes sweeps.
RANGE_RUNS = 1 << 14


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Pieces of each document's ids, ``end_id`` appended; only longer ones are cut.

    ``part`` and ``nth`` number the pieces of one length within a task.  A missing text is empty and
    gives a piece of one token; a missing doc_id stays missing; repeated rows give repeated pieces.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (piece for whole in batches for piece in slices(whole, 32 << 20)):
            ids, counts = encoder.batch(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            cuts = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            length = np.minimum(capacity, counts[doc] - piece * capacity)
            ends = np.cumsum(length)
            order = np.argsort(length, kind="stable")
            sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first, many) + seen[length[order]]
            seen[sizes] += many
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "piece": piece.astype(np.int32),
                "start": piece * capacity,
                "length": length.astype(np.int32),
                "ids_crc32": sums,
                "part": np.full(len(doc), part, np.int32),
                "nth": nth,
            }
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))
                )
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return with_library(documents(docs)).mapInArrow(run, schema)


class Sweep:
    """Best fit of runs of pieces into runs of gaps, from the longest piece to the shortest."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.waiting: list[tuple[int, int, int]] = []  # (-gap, first sequence, sequences), gaps too small so far
        self.open: list[tuple[int, int, int]] = []  # gaps that hold the piece at hand, the smallest on top
        self.placed: list[tuple] = []
        self.unplaced: list[tuple[int, int, int]] = []

    def _place(self, length: int, first: int, n: int, gap: int, seq: int, many: int) -> tuple[int, int]:
        """Put up to n pieces of a rank run into a gap run; gives the pieces and the sequences used."""
        per = gap // length
        full = min(many, n // per)
        used, at = full * per, self.capacity - gap
        if full:
            self.placed.append((PLACED, length, first, used, per, seq, at))
            if gap > per * length:
                heapq.heappush(self.waiting, (per * length - gap, seq, full))
        if full < many and used < n:
            rest = n - used
            self.placed.append((PLACED, length, first + used, rest, rest, seq + full, at))
            # Smaller than every open gap, and perhaps still large enough for the next piece.
            heapq.heappush(self.waiting, (rest * length - gap, seq + full, 1))
            used, full = n, full + 1
        return used, full

    def run(self, pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], fresh: int | None) -> int | None:
        """``pieces`` are (length, first rank, n), ``gaps`` (gap, first sequence, n); ``fresh``: the next new sequence."""
        self.waiting = [(-g, seq, n) for g, seq, n in gaps]
        heapq.heapify(self.waiting)
        for length, first, n in sorted(pieces, reverse=True):
            while n:
                while self.waiting and -self.waiting[0][0] >= length:
                    gap, seq, many = heapq.heappop(self.waiting)
                    self.open.append((-gap, seq, many))
                if self.open:
                    gap, seq, many = self.open.pop()
                    used, taken = self._place(length, first, n, gap, seq, many)
                    if taken < many:
                        self.open.append((gap, seq + taken, many - taken))
                elif fresh is not None:
                    many = -(-n // (self.capacity // length))
                    used, taken = self._place(length, first, n, self.capacity, fresh, many)
                    fresh += taken
                else:
                    self.unplaced.append((length, first, n))
                    break
                first, n = first + used, n - used
        return fresh

    def rows(self) -> list[tuple]:
        left = [*self.open, *((-g, seq, n) for g, seq, n in self.waiting)]
        return [
            *self.placed,
            *((PIECE, length, first, n, 0, 0, 0) for length, first, n in self.unplaced),
            *((GAP, g, 0, n, 0, seq, 0) for g, seq, n in left if g),
        ]


def _swept(runs: DataFrame, capacity: int, fresh: int | None) -> DataFrame:
    """Sweep the runs of each partition; rows that were placed before pass through."""
    arrow = arrow_schema(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        sweep = Sweep(capacity)
        sweep.run(
            [(size, first, n) for kind, size, first, n, *_ in rows if kind == PIECE],
            [(size, seq, n) for kind, size, _, n, _, seq, _ in rows if kind == GAP],
            fresh,
        )
        rows = [r for r in rows if r[0] == PLACED] + sweep.rows()
        if rows:
            columns = dict(zip(arrow.names, zip(*rows, strict=True), strict=True))
            yield pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()}, schema=arrow)

    return with_library(runs).mapInArrow(run, RUNS)


def _round(pieces: DataFrame, gaps: DataFrame | None, capacity: int, fresh: int, range_runs: int) -> DataFrame:
    """Place all pieces of a band: rows of placed runs and of the gaps that are left."""
    runs = pieces if gaps is None else pieces.unionByName(gaps)
    ranges = -(-runs.count() // range_runs)
    if ranges > 1:
        by_size = runs.repartitionByRange(ranges, F.col("size").desc())
        runs = written(_swept(by_size, capacity, None))
    # Bounded by the number of distinct sizes; with several ranges only what these left open.
    return written(_swept(runs.coalesce(1), capacity, fresh))


def placements(lengths: DataFrame, capacity: int, range_runs: int = RANGE_RUNS) -> list[DataFrame]:
    """Runs of placed pieces from a table (length, n) of how many pieces have each length, round by round.

    A row says that pieces first … first + n - 1 of a length lie ``per`` to a sequence, from sequence
    ``seq`` on, each sequence's first one at ``place``.
    """
    zero = F.lit(0)
    pieces = lengths.select(
        F.lit(PIECE).alias("kind"), F.col("length").cast("int").alias("size"), zero.cast("long").alias("first"),
        F.col("n").cast("long").alias("n"), zero.alias("per"), zero.cast("long").alias("seq"), zero.alias("place"),
    )
    # Lengths above 2^(b-1) and up to 2^b make band b.
    band = F.when(F.col("length") > 1, F.length(F.bin(F.col("length") - 1))).otherwise(0)
    bands = sorted((r["band"] for r in lengths.select(band.alias("band")).distinct().collect()), reverse=True)
    rounds: list[DataFrame] = []
    gaps, fresh = None, 0
    for b in bands:
        taken = pieces.filter((F.col("size") > (1 << b) // 2) & (F.col("size") <= 1 << b))
        done = _round(taken, gaps, capacity, fresh, range_runs)
        gaps = done.filter(F.col("kind") == GAP)
        rounds.append(done.filter(F.col("kind") == PLACED))
        used = F.col("seq") + F.ceil(F.col("n") / F.col("per"))
        fresh = max(fresh, rounds[-1].agg(F.max(used)).first()[0] or 0)
    return rounds


def placed(pieces: DataFrame, capacity: int = 4096, range_runs: int = RANGE_RUNS) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be a stored table as ``token_pieces`` makes it.

    The number of runs, which go to all tasks, is bounded by a few per length up to ``capacity`` and round.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts)
    lengths = written(counts.groupBy("length").agg(F.sum("n").alias("n")))
    rounds = placements(lengths, capacity, range_runs)
    schema = ", ".join(f"{n} {t}" for n, t in pieces.drop("part", "nth").dtypes) + ", sequence_id long, offset long"
    arrow = arrow_schema(schema)
    if not rounds:
        return pieces.drop("part", "nth").withColumns(
            {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}
        )
    runs = reduce(DataFrame.unionByName, rounds).orderBy("size", "first").collect()
    table = np.array([(r["size"], r["first"], r["per"], r["seq"], r["place"]) for r in runs], np.int64)
    sent = pieces.sparkSession.sparkContext.broadcast(table)

    # Ranks of a length go on from task to task.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select(
        *[c for c in pieces.columns if c not in ("part", "nth")], (F.col("before") + F.col("nth")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, per, seq, place = sent.value.T
        starts = np.searchsorted(size, np.arange(capacity + 2))
        span = int(first.max()) + 1 if len(first) else 1
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            # Rows are in order of length and first rank; one search finds the run.
            at = np.searchsorted(size * span + first, length * span + np.minimum(rank, span - 1), side="right") - 1
            assert (size[at] == length).all() and (at >= starts[length]).all()
            inside = rank - first[at]
            out = {c: batch.column(c) for c in arrow.names[:-2]}
            out["sequence_id"] = seq[at] + inside // per[at]
            out["offset"] = place[at] + inside % per[at] * length
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return with_library(ranked).mapInArrow(run, schema)


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each lies.

    Offsets in a sequence are gapless from 0.  A missing text is empty (one token, the end id), a
    missing doc_id stays missing, repeated rows are packed one by one, an empty table gives an empty
    result, and other columns are ignored.  Pieces of equal length are told apart by task and row.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, keep_ids))
    return placed(pieces, capacity)
