"""Secret scans: a random forest decides which candidates are secrets.

Candidates are long unbroken strings.  Each is described by its length, the transitions
between kinds of characters, how much of it known words cover, where it lies, and the words
beside it.  A forest trained from labelled findings removes the false positives.  All of
it runs on built-in functions and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import cut, documents
from spanmart.llm.spans import spans

NAMES = r"(?i:secret|token|passw|pwd|api_?key|apikey|access_?key|private_?key|credential|auth|bearer)"
# Formats that tell a secret wherever it stands: key blocks, signed tokens, issuers' prefixes.
KNOWN = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9_/+=:,.\\\s-]*?-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]+)*"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opusr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}"
    r"|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"
)
# A value assigned to a telling name, of eight characters or more; its name is not part of it.
ASSIGNED = NAMES + r"[A-Za-z0-9_-]{0,24}[\"'`]?\s?[=:]\s?[\"'`]?"
# The cheap conditions stand first, so that few places look back for the name.
VALUE = rf"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{{8}})(?<=[=:]\s?[\"'`]?)(?<={ASSIGNED})[A-Za-z0-9_/+-]{{8,}}={{0,2}}"
# Any other long string; '=' only pads its end, so a name before '=' is not part of it.
LONG = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}={0,2}"
CANDIDATE = f"{KNOWN}|{VALUE}|{LONG}"
# Long strings of letters alone are words, not candidates.
POSSIBLE = r"[A-Za-z0-9_/+-]{16}|[=:]\s?[\"'`]?[A-Za-z0-9_/+-]{8}|-----BEGIN|eyJ|xox|SG\."
BESIDE = 48
FEATURES = [
    "n_chars", "digit_share", "upper_share", "sign_share", "hex_share", "transitions", "distinct_share",
    "word_cover", "path_like", "named", "quoted", "assigned", "known", "worded",
]
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 5, 17
THRESHOLD = 0.5
# Words of plain case and short numbers between signs: what reads as words.
WORDED = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[_/+=-]*$"
MASK = "[SECRET]"


def _share(value: Column, kind: str) -> Column:
    kept = F.length(F.regexp_replace(value, f"[^{kind}]", ""))
    return kept / F.length(value)


def candidates(docs: DataFrame, *more: str) -> DataFrame:
    """One row per candidate: doc_id, start, end, value, text before and after it, and the columns ``more``."""
    plain = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        *more,
    )
    found = plain.withColumn("c", F.explode(candidate_spans(F.col("text"))))
    return found.select(
        "doc_id",
        *more,
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.col("c.value").alias("value"),
        _before(F.col("text"), F.col("c.start")).alias("before"),
        F.substring(F.col("text"), F.col("c.end") + 1, F.lit(BESIDE)).alias("after"),
    )


def candidate_spans(text: Column) -> Column:
    """Candidates that are not letters alone."""
    found = spans(text, CANDIDATE, text.rlike(POSSIBLE))
    return F.filter(found, lambda c: c["value"].rlike("[0-9_/+=-]"))


def has_candidates(text: Column) -> Column:
    """Whether a text has any of ``candidate_spans``, found without their places."""
    every = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return text.rlike(POSSIBLE) & F.exists(every, lambda v: v.rlike("[0-9_/+=-]"))


def _before(text: Column, start: Column) -> Column:
    at = F.greatest(start - BESIDE, F.lit(0))
    return F.substring(text, at + 1, start - at)


def features(found: DataFrame) -> DataFrame:
    """The candidates with their features as doubles."""
    v = F.col("value")
    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-"
    )
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    characters = F.size(F.array_distinct(F.split(v, "")))
    # Words: runs of letters with vowels and consonants taking turns, four letters at least.
    words = F.length(F.regexp_replace(v, "(?i)(?:[b-df-hj-np-tv-z]{0,3}[aeiouy]{1,3}[b-df-hj-np-tv-z]{0,3}){2,}", ""))
    columns = {
        "n_chars": F.least(F.length(v), F.lit(200)),
        "digit_share": _share(v, "0-9"),
        "upper_share": _share(v, "A-Z"),
        "sign_share": _share(v, "_/+=-"),
        "hex_share": _share(v, "0-9a-fA-F"),
        "transitions": (runs - 1) / F.length(v),
        "distinct_share": characters / F.length(v),
        "word_cover": 1 - words / F.length(v),
        "path_like": v.contains("/") & ~v.rlike("[0-9]{3}"),
        "named": F.substring(F.col("before"), -32, 32).rlike(NAMES),
        "quoted": F.col("before").rlike("[\"'`]$"),
        "assigned": F.col("before").rlike("[=:]\\s?[\"'`]?$"),
        "known": v.rlike(f"^(?:{KNOWN})$"),
        "worded": v.rlike(WORDED),
    }
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def assigned_labels(found: DataFrame) -> DataFrame:
    """Labelled findings from how they are written, for corpora without labels of their own.

    A value that is assigned to a name such as ``token`` and does not read as words is a finding, and so
    is one of a known format wherever it stands; others are false positives.
    """
    written = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("worded") == 0)
    secret = written | (F.col("known") == 1)
    return found.withColumn("is_secret", secret.cast("double"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel:
    """Fit the forest on at most ``sample`` labelled findings, the first by hash, of each label half at most.

    The sample is the same whatever the partitioning.  Without findings of both labels the
    forest still fits and gives the one label.
    """
    order = [F.xxhash64("value", "before"), F.col("value"), F.col("before")]
    rows = labelled.select(*FEATURES, "is_secret", "value", "before").distinct()
    picked = [rows.where(F.col("is_secret") == k).orderBy(*order).limit(sample // 2) for k in (0.0, 1.0)]
    data = picked[0].unionByName(picked[1]).orderBy("is_secret", *order)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data).coalesce(1)
    forest = RandomForestClassifier(
        labelCol="is_secret", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        featureSubsetStrategy="onethird",
    )
    both = vectors.select("is_secret").distinct().count()
    if both == 0:
        raise ValueError("there are no labelled findings")
    return forest.fit(vectors.select("features", "is_secret"))


def score(found: DataFrame, forest) -> DataFrame:
    """The candidates with ``score``, the forest's share of votes for a secret."""
    from pyspark.ml.functions import vector_to_array

    model = PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), forest])
    out = model.transform(found).withColumn("__votes", vector_to_array("probability"))
    share = F.when(F.size("__votes") > 1, F.element_at("__votes", 2)).otherwise(F.lit(0.0))
    return out.withColumn("score", F.round(share, 6)).drop(
        "features", "__votes", "rawPrediction", "probability", "prediction"
    )


def fitted(found: DataFrame, sample: int = SAMPLE):
    """A forest for the candidates of a corpus, or None where it has none."""
    labelled = assigned_labels(found)
    if labelled.isEmpty():
        return None
    return train(labelled, sample)


def scan(docs: DataFrame, forest=None, sample: int = SAMPLE) -> DataFrame:
    """One row per candidate: doc_id, start, end, value_sha256, score, is_secret.

    Places are in code points.  A missing text has no candidates; a missing doc_id stays
    missing; repeated rows give repeated rows; other columns are ignored.  Without a
    ``forest`` one is trained from findings labelled by how they are written.
    """
    found = cut(features(candidates(documents(docs))))
    forest = forest or fitted(found, sample)
    scored = score(found, forest) if forest else found.withColumn("score", F.lit(0.0))
    return scored.select(
        "doc_id",
        "start",
        "end",
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        (F.col("score") >= THRESHOLD).alias("is_secret"),
    )


def masked(docs: DataFrame, forest=None, sample: int = SAMPLE) -> DataFrame:
    """The documents with every secret replaced by ``[SECRET]``; all columns and rows stay.

    Only the few texts with candidates are touched: their findings are gathered by text and
    joined back; the others pass by.  A missing text stays missing; repeated rows stay repeated.
    """
    names = docs.columns
    plain = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(names)])
    text = f"__{names.index('text')}"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    untouched = plain.where(~has_candidates(body))
    # Equal texts have equal findings, so the text's hash is the key; copies are searched once.
    with_id = cut(plain.where(has_candidates(body)).withColumn("__key", F.sha2(body, 256)))
    subject = with_id.select(F.col("__key").alias("key"), body.alias("text")).groupBy("key").agg(
        F.any_value("text").alias("text")
    )
    found = cut(features(candidates(subject.withColumn("doc_id", F.lit(0).cast("long")), "key")))
    forest = forest or fitted(found, sample)
    if forest is None:
        return docs
    secret = score(found, forest).where(F.col("score") >= THRESHOLD)
    places = secret.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("places"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, place: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, place["start"] - acc["at"])
        return F.struct(place["end"].alias("at"), F.concat(acc["out"], piece, F.lit(MASK)).alias("out"))

    rest = F.concat(
        F.col("done.out"), F.substring(F.col("text"), F.col("done.at") + 1, F.length("text") - F.col("done.at"))
    )
    mended = (
        subject.join(places, "key")
        .withColumn("done", F.aggregate("places", start, step))
        .select(F.col("key").alias("__key"), rest.alias("__masked"))
    )
    out = with_id.join(mended, "__key", "left")
    columns = [F.col(f"__{i}").alias(c) for i, c in enumerate(names)]
    columns[names.index("text")] = F.coalesce("__masked", text).alias("text")
    return out.select(*columns).unionByName(untouched.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)]))
