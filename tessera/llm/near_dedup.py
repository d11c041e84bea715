"""MinHash near-deduplication with tensored banding.

A document's set is the distinct 5-word shingles of its lower-cased words. Two
collections of ``m`` small sketches are made, each sketch from ``k`` minhashes.
A table of the index is a pair of one sketch from either collection, so m * m
tables of 2k minhashes each come from 2 * m * k minhashes instead of
2 * m * m * k. Two sets of similarity J meet in some table with probability
(1 - (1 - J^k)^m)^2, with the values below 0.9997 at J = 0.75, 0.99998 at 0.8.

Documents with equal sets form a class, which its least doc_id stands for, so
copies meet no pairs. Sketches that no other class has are dropped first, as a
key made of one can't be shared; most documents end there. A class's weight is
the number of classes that have its sketches: in a group of near copies, the one
they were all made from is heaviest. First the m tables of equally numbered
sketches are searched by a star: in the group of each table key the heaviest
class, the pivot, is paired with the others, so pairs grow with the members, and
copies that are like their origin but not each other still meet it. Each member
is first checked against its heaviest pivot; other pairs only where that left the
two in different components.

Then all m * m tables are formed, of the sketches that classes of different
components share. In a table key of at most ``SMALL`` classes all pairs of
different components are candidates. Larger ones have too many pairs to list;
all similar pairs of different components among their classes are found by an
exact search instead, without a cap and in one pass: a global order of shingles
is fixed, those held by fewest classes first, and sets that are similar enough
share one of their first shingles in that order, of so many that too few would
follow them otherwise. Shingles of one component join nothing and so are only
counted, which leaves few for the pages on one template: their first shingles
are their own. Every link is confirmed on full sets.

Sketches and sets are computed in Arrow batches with numpy, and sets only for
documents that share sketches; which those are goes to the tasks as a bitmap of
at most MAX_BITS bits. All steps end in tables in the shared folder. Texts never
move.

Defined results
- null or empty text, or blanks only: n_shingles 0, linked with nothing.
- fewer than 5 words: the whole sequence is the one shingle.
- null doc_id: linked with nothing; component_id null, kept true.
- repeated rows: equal ids name one document; each row is returned.
- an empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bare, forget, small_batches, written
from tessera.llm.components import components

SHINGLE = 5
SIMILARITY = 75  # percent
K = 3
M = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hashes a worker keeps, and the most bytes of one.
CACHE, CACHED_BYTES = 1 << 18, 64
#: Ids of documents to leave out that are sent to all tasks; of more, documents are joined by a shuffle instead.
MAX_SENT = 2_000_000
#: Classes with one table key whose pairs are listed.
SMALL = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split() splits at the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    factors = numbers(size, 11)
    if len(h) < size:
        short = np.uint64(len(h))
        for x in h:
            short = mixed((np.array([short]) + np.array([x])) * factors[0])[0]
        return np.array([short], dtype=np.uint64)
    n = len(h) - size + 1
    s = h[:n] * factors[0]
    for i in range(1, size):
        s = s + h[i : n + i] * factors[i]
    return np.unique(mixed(s))


def sketch(s: np.ndarray, k: int, m: int) -> np.ndarray:
    """2 * m numbers, each made of k minhashes; the first m are one collection, the others the other."""
    count = 2 * m * k
    mask, factor = numbers(count, 23)[:, None], numbers(count, 37)[:, None]
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, ((s[None, i : i + 2048] ^ mask) * factor).min(axis=1), out=low)
    parts = low.reshape(2 * m, k)
    out = np.arange(1, 2 * m + 1, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return out


def sketched(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    """doc_id, the set's 128-bit fingerprint, its size, and its sketch, of doc_id and text."""
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            prints, sizes, sketches = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), hashes)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    sketches.append(sketch(s, k, m).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([2 * m if n else 0 for n in sizes])]).astype(np.int32)
            values = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "print", "n_shingles", "sketch"],
            )


def sets_of(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id and set, of doc_id and text, for the ids whose bit is set."""
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            place = np.mod(batch.column(0).fill_null(0).to_numpy(), 8 * len(wanted))
            batch = batch.filter(pa.array((wanted[place // 8] >> (place % 8).astype(np.uint8) & 1).astype(bool)))
            found = [shingles(t.as_py(), hashes).view(np.int64) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "s"])


def shared(reps: DataFrame) -> DataFrame:
    """(rep, slot, v, n): the sketches of each class that n > 1 classes have."""
    each = reps.select("rep", F.posexplode("sketch").alias("slot", "v"))
    several = each.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(several, "v").select("rep", "slot", "v", "n")


def weights(each: DataFrame) -> DataFrame:
    """(rep, weight) of the classes that share sketches from either collection."""
    of = each.groupBy("rep").agg(F.sum("n").alias("weight"), F.min("slot").alias("x"), F.max("slot").alias("y"))
    return of.where(f"x < {M} and y >= {M}").select("rep", "weight")


def diagonal(each: DataFrame) -> DataFrame:
    """(key, rep) for the tables of equally numbered sketches."""
    one, two = F.max(F.when(F.col("slot") < M, F.col("v"))).alias("one"), F.max(F.when(F.col("slot") >= M, F.col("v"))).alias("two")
    both = each.groupBy("rep", (F.col("slot") % M).alias("k")).agg(one, two).where("one is not null and two is not null")
    return both.select(F.xxhash64("one", "two").alias("key"), "rep")


def bitmap(ids: DataFrame) -> np.ndarray:
    """The ids of a column ``id`` as set bits; of so few bits that the driver and every task can hold them, so others may share a bit."""
    bits = min(max(1 << (8 * ids.count()).bit_length(), MIN_BITS), MAX_BITS)
    place = F.pmod("id", F.lit(bits)) + 1
    blocks = ids.groupBy(F.call_function("bitmap_bucket_number", place).alias("block")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for block, b in blocks:
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(bytes(b), np.uint8)
    return out


def heaviest() -> Column:
    """An aggregate: the heaviest class, of equal ones the least."""
    return F.max(F.struct("weight", (-F.col("rep")).alias("minus")))


def pivots(keyed: DataFrame) -> DataFrame:
    """(rep, pivot, weight of the pivot) for each group's members but its heaviest, from (key, rep, weight)."""
    drawn = keyed.groupBy("key").agg(heaviest().alias("h"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    drawn = drawn.select("key", (-F.col("h.minus")).alias("pivot"), F.col("h.weight").alias("heavy"))
    return keyed.select("key", "rep").join(drawn, "key").where("rep <> pivot").select("rep", "pivot", "heavy")


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; repeated rows of a document repeat its pairs."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").where(F.size("sa") > 0)
    # a pair whose sizes differ too much can't be similar
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    both = both.where(100 * small >= similarity * large).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    # not made distinct here: that would hold all pairs of one b in one task, as no exchange would lie between it and the join
    return both.where(100 * F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be in one component."""
    of = lambda n: comps.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def in_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds c, the component of each row's rep."""
    return rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def tables(each: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rep, c) for all m * m tables, of the sketches that several components share, from (rep, slot, v)."""
    member = in_components(each, comps)
    several = member.groupBy("v").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("v")
    one, two = F.collect_set(F.when(F.col("slot") < M, F.col("v"))).alias("one"), F.collect_set(F.when(F.col("slot") >= M, F.col("v"))).alias("two")
    of = member.join(several, "v", "left_semi").groupBy("rep", "c").agg(one, two)  # m of either at most
    return of.select("rep", "c", F.explode("one").alias("x"), "two").select("rep", "c", "x", F.explode("two").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep", "c")


def candidates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components in small table keys, and the classes (rep, c) of larger ones."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key", "n")
    sized = written(keyed.join(sizes, "key"), "dedup-tables")
    small = sized.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("rep", "c")).alias("m"))
    pair = lambda x: F.transform(F.filter("m", lambda y: (y["rep"] > x["rep"]) & (y["c"] != x["c"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("m", pair))).alias("p")).select("p.a", "p.b").distinct()
    return written(pairs, "dedup-pairs"), written(sized.where(F.col("n") > SMALL).select("rep", "c").distinct(), "dedup-large")


def crossing(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): pairs of different components that hold all similar ones, of members (rep, c)."""
    every = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "c", F.size("s").alias("n"), F.xxhash64("s").alias("print"), F.explode("s").alias("v"))
    joint = every.groupBy("v").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("often")).where("x <> y").select("v", "often")
    # the shingles of a set from this one on; equal rows of a repeated document have equal ranks
    left = F.dense_rank().over(Window.partitionBy("rep", "print").orderBy(F.desc("often"), F.desc("v")))
    first = every.join(joint, "v").withColumn("left", left).where(100 * F.col("left") >= similarity * F.col("n")).select("v", "rep", "c", "n", "left")
    first = written(first, "dedup-firsts")
    names = ("rep", "c", "n", "left")
    # two sets have (100 + similarity) * common >= similarity * (sum of sizes); of the smaller one, that is at least twice its size
    small = first.where((100 + similarity) * F.col("left") >= 2 * similarity * F.col("n")).select("v", *[F.col(x).alias(f"{x}_a") for x in names])
    large = first.select("v", *[F.col(x).alias(f"{x}_b") for x in names])
    like = f"c_a <> c_b and (n_a < n_b or n_a = n_b and rep_a < rep_b) and 100 * n_a >= {similarity} * n_b"
    enough = f"{100 + similarity} * least(left_a, left_b) >= {similarity} * (n_a + n_b)"
    pairs = written(ordered(small.join(large, "v").where(f"{like} and {enough}"), "rep_a", "rep_b"), "dedup-pairs")
    forget(first)
    return pairs


def classes(docs: DataFrame, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, print, n_shingles), and (print, component) for prints of more than one document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(lambda b: sketched(b, K, M), "doc_id long, print binary, n_shingles long, sketch array<long>")
    rows = written(rows, "dedup-sketches")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    heads = written(linked.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "dedup-classes")
    reps = linked.join(heads.select("print", F.col("rep").alias("doc_id")), ["print", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "sketch")
    shared_ = written(shared(reps), "dedup-shared")
    weight = written(weights(shared_), "dedup-weights")
    wanted = spark.sparkContext.broadcast(bitmap(weight.select(F.col("rep").alias("id"))))
    sets = written(docs.mapInArrow(lambda b: sets_of(b, wanted.value), "doc_id long, s array<long>").where("doc_id is not null"), "dedup-sets")
    each = shared_.select("rep", "slot", "v").join(weight, "rep")

    star = pivots(diagonal(each).join(weight, "rep"))
    star = written(star.groupBy(F.col("rep").alias("m"), "pivot").agg(F.max("heavy").alias("heavy")), "dedup-star")
    best = star.groupBy("m").agg(F.max(F.struct("heavy", (-F.col("pivot")).alias("minus"))).alias("h"))
    first = written(ordered(best.select("m", (-F.col("h.minus")).alias("p")), "m", "p"), "dedup-pairs")
    links = written(confirmed(first, sets, similarity), "dedup-links")
    comps = components(links)
    tested = ordered(star, "m", "pivot")

    def more(pairs: DataFrame) -> None:
        nonlocal links, comps
        found = written(confirmed(pairs, sets, similarity), "dedup-links")
        if found.take(1):
            links, old = links.unionByName(found), comps
            comps = components(links)
            forget(old)

    rest = written(apart(tested.join(first, ["a", "b"], "left_anti"), comps), "dedup-pairs")
    more(rest)
    pairs, large = candidates(tables(each, comps))
    crossed = crossing(large, sets, similarity)
    last = written(pairs.unionByName(crossed).distinct().join(tested, ["a", "b"], "left_anti"), "dedup-pairs")
    more(last)
    forget(star, first, rest, pairs, large, crossed, last, shared_, weight, sets)
    head = heads.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    head = head.withColumn("component", F.coalesce("component", "rep")).where("rep <> last or component <> rep").select("print", "component")
    return rows.select("doc_id", "print", "n_shingles"), written(head, "dedup-components")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    with small_batches(docs.sparkSession):
        rows, found = classes(bare(docs, "doc_id", "text"), similarity)
    out = rows.join(found, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those that duplicate another: one of each group stays, that of the least doc_id."""
    judged = written(near_duplicates(docs, similarity), "dedup-verdicts")
    gone = written(judged.where("not kept").select("doc_id").distinct(), "dedup-gone")
    gone = F.broadcast(gone) if gone.count() <= MAX_SENT else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = written(again, "dedup-repeated")
    if again.take(1):  # repeated rows: only they move
        left = left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
