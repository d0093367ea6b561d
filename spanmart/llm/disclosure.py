"""Personal data, and information-theoretic sanitisation of the terms that give it away.

Emails, addresses, cards and phone numbers are found by pattern.  They are the protected
entities.  The corpus tells how strongly a term reveals one: from the documents that hold both,
and those that hold either, follow the conditional probability of the entity and the pointwise
mutual information.  Terms over both thresholds are generalised wherever they occur.  All counts
are of documents; that a pair stands in several different texts is asked for beside them, so
copies of one text reveal nothing by their number.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import cut, documents, written as stored
from spanmart.llm.spans import spans

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the contract's patterns: nothing follows what they hold, so they match the same.
# A match can begin at the last one's end, or where no character of its first run precedes: any
# later start in that run meets the same rest and fails with it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MIN_CONTEXTS = 3
MIN_PROBABILITY = 0.5
MIN_BITS = 6.0
TERM = r"\p{L}{3,40}"
BASE = "array<struct<start:int,kind:int,`end`:int,value:string>>"


def _possible(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a valid match meets."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": text.rlike(r"\+[0-9]"),
    }[kind]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the check sum; every second digit from the right is doubled."""
    n = F.length(value)
    numbers = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(value, i, F.lit(1)).cast("int"))
    weighed = F.transform(
        numbers, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    )
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid matches by start, then kind."""

    def of(kind: str) -> Column:
        order = KINDS.index(kind)
        found = F.filter(
            spans(text, PATTERNS[kind], _possible(kind, text)), lambda s: _valid(kind, s["value"])
        )
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
            ),
        )

    return F.sort_array(F.concat(*[of(k) for k in KINDS]))


def _entity(kind: Column, value: Column) -> Column:
    plain = F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(digits(value))
    return F.xxhash64(kind, plain)


def _terms(text: Column) -> Column:
    """The distinct terms of a text; those within an email belong to the entity itself."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0)))


def revealing(docs: DataFrame, found: DataFrame, min_contexts: int, min_probability: float, min_bits: float) -> DataFrame:
    """The terms that give a protected entity away; ``found`` has the distinct texts with entities and their copies.

    A pair's documents are at most those of its term and of its entity, so both thresholds bound what
    can pass before any pair is made: an entity must be in few enough of all documents for the
    bits, and a term in few enough beside the entity's for the probability.
    """
    n_all = docs.count()
    keyed = found.withColumn("key", F.xxhash64("text"))
    entities = keyed.select(
        "key", "copies", F.explode(F.array_distinct(F.transform("base", lambda b: _entity(b["kind"], b["value"])))).alias("entity")
    )
    common = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_texts"))
    common = stored(
        common.where((F.col("n_texts") >= min_contexts) & (F.log2(F.lit(n_all) / F.col("n_entity")) >= min_bits)).drop("n_texts")
    )
    entities = stored(entities.join(common, "entity"))
    most = common.agg(F.max("n_entity")).first()[0] or 0
    counted = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counted = counted.where(F.col("n_term").between(min_contexts, most / min_probability))
    words = (
        keyed.join(entities.select("key").distinct(), "key", "left_semi")
        .select("key", F.explode(_terms(F.col("text"))).alias("term"))
        .join(counted, "term")
    )
    near = F.col("n_entity") >= min_probability * F.col("n_term")
    pairs = (
        entities.join(words, "key")
        .where(near)
        .groupBy("entity", "term", "n_entity", "n_term")
        .agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_contexts"))
    )
    bits = F.log2(F.col("n_both") * F.lit(n_all) / (F.col("n_term") * F.col("n_entity")))
    over = pairs.where(
        (F.col("n_contexts") >= min_contexts) & (F.col("n_both") >= min_probability * F.col("n_term")) & (bits >= min_bits)
    )
    return stored(over.select("term").distinct())


def sanitised_spans(
    docs: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    min_probability: float = MIN_PROBABILITY,
    min_bits: float = MIN_BITS,
) -> DataFrame:
    """Per document: doc_id, text, base (matches), terms (places of revealing terms).

    A missing text is empty and has no spans; a missing doc_id stays missing; repeated rows
    give repeated rows; other columns are ignored.  Documents without base matches that
    share no revealing term pass by without any search for terms.
    """
    plain = documents(docs)
    with_base = plain.withColumn("base", base_spans(F.col("text")))
    # Copies of a text are looked at once and counted.
    found = cut(
        with_base.where(F.size("base") > 0).groupBy("text").agg(F.count("*").alias("copies"), F.any_value("base").alias("base"))
    )
    terms = revealing(plain, found, min_contexts, min_probability, min_bits)
    held = plain.select(F.xxhash64("text").alias("key"), F.explode(_terms(F.col("text"))).alias("term")).join(terms, "term")
    by_text = stored(held.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("found")))
    joined = with_base.withColumn("key", F.xxhash64("text")).join(by_text, "key", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("found", "|"), F.lit(r")(?!\p{L})"))
    places = F.when(F.col("found").isNotNull(), spans(F.col("text"), pattern))
    return joined.select("doc_id", "text", "base", places.alias("terms"))


def report(docs: DataFrame, **thresholds) -> DataFrame:
    """Per document: counts by kind, digest of the base spans, and all spans by start, then kind (terms last)."""
    found = sanitised_spans(docs, **thresholds)

    def count(kind: str) -> Column:
        order = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == order)).cast("long").alias(f"n_{kind}")

    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])

    def written(all_spans: Column) -> Column:
        return F.array_join(
            F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])),
            ",",
        )

    terms = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,`end`:int,value:string>>")),
        lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"), s["value"].alias("value")),
    )
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat(F.col("base"), terms))).alias("spans"),
    )


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, text) with every base match replaced by its kind, and every revealing term by ``[TERM]``."""
    found = sanitised_spans(docs, **thresholds)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    terms = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,`end`:int,value:string>>")),
        lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"), s["value"].alias("value")),
    )
    places = F.sort_array(F.concat(F.col("base"), terms))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        longer = F.struct(
            s["end"].alias("at"), F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out")
        )
        # What overlaps an earlier span is hidden with it.
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], longer).otherwise(inside)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = found.withColumn("done", F.aggregate(places, start, step))
    rest = F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))
    return done.select("doc_id", F.concat(F.col("done.out"), rest).alias("text"))
