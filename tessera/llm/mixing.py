"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a hash-random key. Within each source the keys are
range-partitioned by their leading bits; the sums of the ranges and a prefix sum
over them tell in which range the source's budget ends. Only that range is
sorted and summed row by row, which gives the one document where the source is
cut. A source whose target exceeds its size first takes whole epochs; the cut
then lies in the last one. What each document gives follows from its key and
its source's cut alone, so texts are never shuffled.

Shuffled are partial sums (sources x ranges rows a task) and the narrow rows of
one range a source. The number of ranges grows with spark.sql.shuffle.partitions,
so a source with a third of all rows still sorts a small part in one task; the
result doesn't depend on that number.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and
share ``share`` times all words; a target stops at ``cap`` times its source's
words and the excess is shared anew by weight until none is above. That is the
level L with sum(least(cap, weight * L)) = total, found by one ordered pass.

Defined results
- null or empty text, or blanks only: size 0, taken 0.
- null source: a source of its own, the last. Null doc_id: ordered before others of equal key.
- rows equal in doc_id, source and size are indistinguishable: where the cut falls among them, each gives the same share, rounded down.
- an empty table, or one without words: empty result, or targets of 0.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, shards, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds _size (words), _id (a string that orders null first) and _key (hash-random hex digits)."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumns({"_size": word_count(F.col("text")), "_id": identity}).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id"))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, source_size), a row a source: the same with its target in words."""
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ordered = sources.withColumns({"weight": weight, "most": (cap * F.col("source_size")).cast("double")})
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), none.cast("double"))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none))
    place = F.row_number().over(Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()))
    ordered = ordered.withColumns({"level": level, "place": place})
    # in order of most / weight, the first source that its share doesn't fill sets the level of all after it
    fits = F.col("most") >= F.col("weight") * F.col("level")
    ordered = ordered.withColumn("level", F.min(F.when(fits, F.struct("place", "level"))).over(whole)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("level"), F.col("most")))
    return ordered.select("source", "source_size", target.alias("target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row a source: source_size, target, whole epochs, and the (key, id, size) where the last epoch ends, with what is taken there."""
    spark = rows.sparkSession
    bits = min(24, (shards(spark) - 1).bit_length())
    shard = F.shiftright(F.conv(F.substring("_key", 1, 6), 16, 10).cast("long"), 24 - bits).cast("int")
    rows = rows.select("source", "_size", "_id", "_key", shard.alias("_shard"))
    by_shard = written(rows.groupBy("source", "_shard").agg(F.sum("_size").alias("words")), "mix-shards")
    sources = targets(by_shard.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0)))
    sources = written(sources, "mix-sources")
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("_shard"))
    ends = by_shard.withColumn("end", up_to)
    at = ends.join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where("rest >= end - words and rest < end")
    at = written(at.select(F.col("source").alias("s"), F.col("_shard").alias("k"), "rest", (F.col("end") - F.col("words")).alias("before")), "mix-cut-range")
    near = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("_shard") == F.col("k"))).groupBy("source", "_key", "_id", "_size", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    done = F.sum(F.col("_size") * F.col("n")).over(Window.partitionBy("source").orderBy("_key", "_id", "_size")) + F.col("before")
    near = near.withColumn("done", done).where("rest >= done - _size * n and rest < done")
    first = F.floor((F.col("rest") - (F.col("done") - F.col("_size") * F.col("n"))) / F.col("n")).cast("long")
    cut = near.select(F.col("source").alias("s"), F.struct("_key", "_id", "_size").alias("cut"), first.alias("at_cut"))
    out = sources.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return written(out.select("source", "source_size", "target", "epochs", "cut", "at_cut"), "mix-cuts")


def taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows of sized(); none of them moves while the cuts are small enough to broadcast."""
    names = rows.columns
    cut = cut.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "epochs", "cut", "at_cut")
    place = F.struct("_key", "_id", "_size")
    last = F.when(F.col("cut").isNull(), 0).when(place < F.col("cut"), F.col("_size")).when(place == F.col("cut"), F.col("at_cut")).otherwise(0)
    out = rows.join(cut, rows["source"].eqNullSafe(cut["_s"]), "left")
    return out.select(*[rows[n] for n in names], F.col("_source_size").alias("_all"), F.col("_target"), (F.col("epochs") * F.col("_size") + last).cast("long").alias("_taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = written(sized(docs).select("doc_id", "source", "_size", "_id", "_key"), "mix-rows")
    got = taken(rows, cuts(rows))
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_all").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each whole copy taken, and the first words of a document that is cut."""
    rows = sized(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    narrow = written(rows.select("source", "_size", "_id", "_key"), "mix-rows")
    got = taken(rows, cuts(narrow)).where("_taken > 0")
    got = got.withColumn("_n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    kept = F.least(F.col("_size"), F.col("_taken") - (F.col("_n") - 1) * F.col("_size"))
    blanks = "".join(f"\\x{ord(c):02x}" for c in BLANKS)
    ends = F.split("text", f"(?<=[^{blanks}])(?=[{blanks}])", -1)  # each piece ends with a word
    text = F.when(kept == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(ends, F.lit(1), kept.cast("int")), ""))
    got = got.select(F.col("_row").withField("text", text).alias("_row"))
    if "n_chars" in docs.columns:
        got = got.select(F.col("_row").withField("n_chars", F.length("_row.text").cast("long")).alias("_row"))
    return got.select("_row.*")
