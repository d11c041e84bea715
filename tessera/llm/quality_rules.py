"""Quality rules: a hashed n-gram log-likelihood ratio beside plain counting rules.

Two multinomials over the same hashed n-grams are counted: one over a trusted
target (documents whose every label says quality 1), one over the raw corpus
(every document). A document's score is the mean over its n-grams of
``ln(p_target / p_raw)``; every document whose score reaches ``min_score`` and
that passes the base rules is kept. Nothing is drawn at random.

An n-gram is a word, a pair of neighbouring words, or the last three characters
of a word; the last finds markup and symbol noise glued to words that are new.

Only DataFrame functions are used. The text is read twice (counts, scores) and
not shuffled; what is shuffled are partial counts of at most ``buckets`` rows
a task. Every trusted document counts; their ids are sent to all tasks if no more
than ``MAX_SENT``. The table of ratios has ``buckets`` entries whatever the input.

Defined results
- null or empty text, or one of blanks only: no words; ``base_failed``, score 0.
- null doc_id: scored like any other row; it is never part of the target.
- repeated rows: each counts and each is returned.
- no trusted document (empty or missing labels): all ratios are 0, so the base rules alone decide.
- empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, bare, blank_parts, let, words

BUCKETS = 1 << 14
#: Trusted ids that are sent to all tasks; of more, documents are joined by a shuffle instead.
MAX_SENT = 1_000_000
MIN_SCORE = -0.22
#: Weight of the raw multinomial in the target one, so that no n-gram has probability 0.
MIX = 0.3
SYMBOLS = "#*$%&|<>"


def neighbours(items: Column, name: str, after: str) -> Column:
    """Each item with the next one, which is null at the end."""
    return F.arrays_zip(items.alias(name), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))).alias(after))


def features(h: Column, n: Column, w: Column, buckets: int) -> list[Column]:
    """The buckets, a power of two, of the n-grams that begin at the word ``w`` of hash ``h`` before a word of hash ``n``."""
    bucket = lambda x: x.bitwiseAND(F.lit(buckets - 1)).cast("int")
    return [bucket(h), bucket(F.xxhash64(h, n)), bucket(F.xxhash64(F.substring(w, -3, 3)))]


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, mix: float) -> Column:
    """ln(p_target / p_raw) by bucket, as a scalar subquery of ``buckets`` doubles."""
    good = bare(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    good = good.select("doc_id", F.lit(1).alias("trusted"))
    good = F.broadcast(good) if good.count() <= MAX_SENT else good
    grams = (
        bare(docs, "doc_id", "text")
        .join(good, "doc_id", "left")
        .select("trusted", F.inline(let(words(F.col("text")), lambda w: neighbours(w, "w", "v"))).alias("w", "v"))
        .select("trusted", "w", F.xxhash64("w").alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("n"))
        .select("trusted", F.explode(F.array(*features(F.col("h"), F.col("n"), F.col("w"), buckets))).alias("bucket"))
    )
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    one = dense.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("a"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    p_raw = lambda x: (x["raw"] + 1.0) / (F.col("n_raw") + float(buckets))
    share = lambda x: F.coalesce(F.try_divide(x["target"], F.col("n_target")), p_raw(x))
    ratio = lambda x: F.log((1 - mix) * share(x) / p_raw(x) + mix)
    return one.select(F.transform("a", ratio).alias("a")).scalar()


def repeated_words(hashes: Column) -> Column:
    """How many words, given as their hashes, stand in a 3-word window that the text holds at least twice.

    Windows are sorted as single numbers: their hash with its low bits replaced
    by the place. Neighbours are the same window if their whole hashes are.
    """

    def covered(at: Column) -> Column:  # ascending starts of such windows
        new = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    def of_windows(w: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w)))) - 1
        # variables are bound one inside the other: what a lambda returns is copied
        starts = let(
            low,
            lambda m: let(
                F.sort_array(F.transform(w, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))),
                lambda s: let(F.transform(s, lambda x: F.get(w, x.bitwiseAND(m).cast("int"))), lambda h: places(s, h, m)),
            ),
        )
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(starts, covered))

    def places(s: Column, h: Column, m: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)) | F.coalesce(F.get(h, i + 1) == x, F.lit(False))
        return F.sort_array(F.filter(F.transform(h, lambda x, i: F.when(same(x, i), F.get(s, i).bitwiseAND(m).cast("int")).otherwise(-1)), lambda p: p >= 0))

    n = F.size(hashes) - 2
    three = F.arrays_zip(*[F.slice(hashes, F.lit(k + 1), n).alias(f"h{k}") for k in range(3)])
    windows = F.transform(three, lambda x: F.xxhash64(x["h0"], x["h1"], x["h2"]))
    return F.when(n < 1, 0).otherwise(let(windows, of_windows))


def base_counts(text: Column, parts: Column, hashes: Column) -> dict[str, Column]:
    """The base columns of a text, which one blank after another cuts into ``parts``."""
    text = F.coalesce(text, F.lit(""))
    filled = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": (F.length(text) - F.size(parts) + 1).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes).cast("long"),
    }


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    buckets: int = BUCKETS,  # a power of two
    min_score: float = MIN_SCORE,
    mix: float = MIX,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep`` of every document with its counts, score and verdict."""
    lr = log_ratios(docs, labels, buckets, mix)
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"), lr.alias("ratios"))  # a subquery can't stand inside a lambda's argument

    def all_of(lr: Column, parts: Column, w: Column, h: Column) -> Column:
        each = F.arrays_zip(h.alias("h"), F.slice(h, F.lit(2), F.size(h)).alias("n"), w.alias("w"))
        step = lambda a, x: sum((F.get(lr, b) for b in features(x["h"], x["n"], x["w"], buckets)), a)
        score = F.aggregate(each, F.lit(0.0), step) / F.greatest(3 * F.size(w), F.lit(1))
        return F.struct(*[c.alias(n) for n, c in base_counts(F.col("text"), parts, h).items()], score.alias("score"))

    hashed = lambda w, body: let(F.transform(w, lambda x: F.xxhash64(x)), body)
    # variables are bound one inside the other: what a lambda returns is copied
    whole = let(F.col("ratios"), lambda lr: let(blank_parts(F.col("text")), lambda p: let(F.array_remove(p, ""), lambda w: hashed(w, lambda h: all_of(lr, p, w, h)))))
    # generated columns: a filter on them isn't pushed below, where all would be computed anew for each of its terms
    out = read.select("row", F.inline(F.array(whole)))
    out = out.select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= min_score))
