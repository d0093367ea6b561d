"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one
bit per failed rule; policies are versioned sets of rules, applied to the bits later, and
ablations are bitwise sums over the few distinct bit patterns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import binaries, documents, map_rows

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
NOT_FIRST = bytes(range(0x80, 0xC0))
REPEAT_WORDS = 8
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_exclaimed", "longest_word",
)


@dataclass(frozen=True)
class Rule:
    """A failed rule sets bit ``bit``; bits are never given to another rule."""

    name: str
    bit: int
    fails: Callable[[], Column]


# Bits 0 and 1 are the base rules; the others are this method's own.
RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 20),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", 2, lambda: 4 * F.col("n_symbols") > F.col("n_words")),
    Rule("copied_lines", 3, lambda: (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
    Rule("capitals", 4, lambda: (F.col("n_letters") > 0) & (10 * F.col("n_upper") > 6 * F.col("n_letters"))),
    Rule("exclaimed", 5, lambda: 2 * F.col("n_exclaimed") > F.col("n_words")),
    Rule("no_letters", 6, lambda: 4 * F.col("n_letters") < F.col("word_chars")),
    Rule("word_length", 7, lambda: F.col("word_chars") > 40 * F.col("n_words")),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "copied_lines"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    bit = {r.name: r.bit for r in RULES}
    return sum(1 << bit[name] for name in set(rules))


def repeated_words(words: list[bytes], window: int = REPEAT_WORDS) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    grams = [joined[a : b - 1] for a, b in zip(starts[:n], starts[window:], strict=True)]
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    covered = reach = 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + window - max(i, reach)
            reach = i + window
    return covered


def measured(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = text.translate(None, bytes(range(0x41)) + b"[\\]^_`{|}~\x7f" + NOT_FIRST)
    return (
        len(words),
        len(text.translate(None, SPACES + NOT_FIRST)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(letters) - len(letters.translate(None, bytes(range(0x41, 0x5B)))),
        len(letters),
        text.count(b"!!"),
        max(map(len, words), default=0),
    )


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the measurements (all long)."""

    def run(batch):
        rows = [measured(t) for t in binaries(batch.column("text"))]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
        return {"doc_id": batch.column("doc_id")} | {k: list(v) for k, v in zip(MEASURES, columns, strict=True)}

    return map_rows(documents(docs), run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of every document and ``failed_bits``, its failed rules.

    A missing text has no words; a missing doc_id stays missing; repeated rows give
    repeated rows; other columns are ignored.
    """
    return measure(docs).withColumn("failed_bits", failure_bits())


def passes(policy: str = CURRENT) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; base failures are never kept."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return ledger(docs).withColumns({"base_failed": base, "kept": ~base & passes(policy)})


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For every rule of a policy: documents it fails, fails alone, and kept without it.

    The ledger is first counted by bit pattern (a pre-aggregated shuffle of at most 2^rules
    rows per task); the rules are then compared on those counts alone.
    """
    whole = mask(POLICIES[policy])
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).count()
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])
    )
    split = patterns.select("bits", "count", each.alias("r")).select("bits", "count", "r.rule", "r.bit")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("count")).otherwise(F.lit(0).cast("long")))

    return split.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        total(F.col("bits") == 0).alias("n_kept"),
    )


def rejected_removed(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents a policy keeps, with all their columns.

    The measurements are taken beside the row in one pass, so nothing is joined or shuffled.
    """
    names = [*docs.columns]

    def run(batch):
        import pyarrow as pa

        texts = binaries(batch.column("__text"))
        rows = [measured(t) for t in texts]
        out = {f"__{i}": batch.column(f"__{i}") for i in range(len(names))}
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
        return out | {m: pa.array(list(v), pa.int64()) for m, v in zip(MEASURES, columns, strict=True)}

    schema = ", ".join(f"__{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    text = names.index("text")
    wide = plain.withColumn("__text", F.coalesce(F.col(f"__{text}").cast("string"), F.lit("")))
    found = map_rows(wide, run, schema + ", " + ", ".join(f"{m} long" for m in MEASURES))
    kept = found.withColumn("failed_bits", failure_bits()).where(passes(policy))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
