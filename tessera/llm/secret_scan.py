"""Secret scans: fixed patterns, and two character Markov models.

Base spans come from the three patterns below. The models add spans: runs of at
least ``MIN_RUN`` key characters, in what base spans leave of the text, are
scored by the log-likelihood ratio of a first-order Markov model of random
strings to one of ordinary identifiers, per transition, and those over
``threshold`` are secrets of kind ``markov``. Of a run that is not, each stretch
that is random enough is one: from where the sum of what the ratios have above
the threshold is lowest so far to its peak before it falls as low again. Both
models are counted from labelled samples (token, secret): random strings in the
usual alphabets, and identifiers and words of documents that are labelled good.
The model is a table of 128 x 128 ratios.

Only DataFrame functions are used; texts are not shuffled. Work is n log n in the
text, however many spans it has.

Defined results
- null or empty text: no spans; the hash is that of the empty string.
- null doc_id: scanned like any other. Repeated rows: each is returned.
- an empty table: empty result. No labelled documents: the models are counted from the built-in samples alone.
- lines and letters: in a keyword, A-Z and a-z are the same; elsewhere the patterns hold as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import array_of, bare, let
from tessera.llm.spans import PLACE, blanked, find, merged, replaced, scanned

#: Fixed patterns. For access and hex the least length is part of the pattern, which finds the same runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 16
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
#: Nats per transition. Between the two classes' held-out scores, nearer to the random ones.
THRESHOLD = 0.5
#: Of a stretch within a run: its least length, as random ends may not score, and the nats that its ratios have above the threshold in all.
MIN_STRETCH = 12
EXCESS = 5.0
#: Labelled documents that lend words to the model of ordinary identifiers: those of least hash, at most so many.
MAX_LABELLED = 2000
RANDOM_SAMPLES = 8000
MASK = "[SECRET]"
#: Words that identifiers are made of.
NAME_PARTS = (
    "get set is has add remove update delete create build make load save read write open close start stop run init parse format print user account "
    "name value key index count size length list map array node tree graph table row column field record file path folder image page view model "
    "controller service manager handler factory adapter client server request response message event queue stream buffer cache config option "
    "default current next previous first last min max total average number string integer boolean error exception status state type class method"
).split()


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES, seed: str = "random") -> DataFrame:
    """Random strings in base 16, 36, 62 and 64, as labelled rows (token, secret)."""
    digest = lambda tag: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(tag), "id"), 256)
    base64 = F.rtrim(F.base64(F.unhex(digest("a"))), F.lit("="))
    base62 = F.regexp_replace(F.base64(F.unhex(digest("b"))), "[+/=]", "")
    base36 = F.concat(*[F.conv(F.substring(digest("c"), 1 + 12 * i, 12), 16, 36) for i in range(4)])
    token = F.when(F.col("id") % 4 == 0, digest("d")).when(F.col("id") % 4 == 1, base36).when(F.col("id") % 4 == 2, base62).otherwise(base64)
    return spark.range(n).select(token.alias("token"), F.lit(1).alias("secret"))


def name_samples(spark: SparkSession, n: int = RANDOM_SAMPLES, seed: str = "names") -> DataFrame:
    """Identifiers in camel, snake, kebab and path spelling, as labelled rows."""
    parts = F.split(F.lit(" ".join(NAME_PARTS)), " ")
    part = lambda i: F.element_at(parts, (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(len(NAME_PARTS))) + 1).cast("int"))
    three = [part(i) for i in range(4)]
    camel = F.concat(three[0], *[F.initcap(x) for x in three[1:]])
    upper = F.upper(F.concat_ws("_", *three[:3]))
    numbered = F.concat(F.concat_ws("_", *three[:3]), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(100)).cast("string"))
    token = F.when(F.col("id") % 5 == 0, camel).when(F.col("id") % 5 == 1, F.concat_ws("_", *three)).when(F.col("id") % 5 == 2, F.concat_ws("-", *three)).when(F.col("id") % 5 == 3, upper)
    token = F.coalesce(token, F.when(F.col("id") % 2 == 0, numbered).otherwise(F.concat_ws("/", *three)))
    return spark.range(n).select(token.alias("token"), F.lit(0).alias("secret"))


def word_samples(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Runs of 6 to 15 letters in documents labelled good, as written and in capitals, as labelled rows; no pattern matches so short a run of letters."""
    good = bare(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    found = bare(docs, "doc_id", "text").join(F.broadcast(good), "doc_id")
    found = found.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{6,15}\b"), F.lit(0))).alias("token"))
    return found.select(F.explode(F.array("token", F.upper("token"))).alias("token"), F.lit(0).alias("secret"))


def transitions(token: Column) -> Column:
    """128 * code of a character + code of the next, for each pair of neighbours; other than ASCII counts as code 0."""
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(0)
    codes = lambda chars: F.transform(chars, code)
    pairs = lambda c: F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.get(c, i) * 128 + x)
    return let(let(F.split(token, ""), codes), pairs)


def train(samples: DataFrame) -> Column:
    """The ratio of each transition's probability given the first character, in nats, as a scalar subquery of 16,384 doubles."""
    pairs = samples.where("token is not null").select("secret", F.explode(transitions(F.col("token"))).alias("t"))
    secret, plain = F.count(F.when(F.col("secret") == 1, 1)), F.count(F.when(F.col("secret") == 0, 1))
    counts = pairs.groupBy("t").agg(secret.alias("s"), plain.alias("p")).withColumn("a", F.floor(F.col("t") / 128))
    totals = counts.groupBy("a").agg(F.sum("s").alias("sa"), F.sum("p").alias("pa"))
    # 67 key characters can follow; half a pseudo-count for each
    ratio = F.log((F.col("s") + 0.5) / (F.col("sa") + 33.5)) - F.log((F.col("p") + 0.5) / (F.col("pa") + 33.5))
    return array_of(counts.join(totals, "a").select(F.col("t").cast("long").alias("t"), ratio.alias("r")), 128 * 128, "t", "r")


def model(docs: DataFrame, labels: DataFrame) -> Column:
    spark = docs.sparkSession
    return train(random_samples(spark).unionByName(name_samples(spark)).unionByName(word_samples(docs, labels)))


def ratios_of(token: Column, ratios: Column) -> Column:
    return let(F.struct(transitions(token).alias("t"), ratios.alias("r")), lambda s: F.transform(s["t"], lambda x: F.get(s["r"], x)))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))


def score(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of random to ordinary over a token's transitions."""
    return let(ratios_of(token, ratios), mean)


def stretches(values: Column, threshold: float) -> Column:
    """(start, end) within a run of the random stretches, from the ratios of its transitions."""

    def most(v: Column) -> Column:
        """The greatest rise of the sum."""
        step = lambda a, x: F.struct(F.greatest(a["sum"] + x - threshold, F.lit(0.0)).alias("sum"), F.greatest(a["best"], a["sum"] + x - threshold).alias("best"))
        return F.aggregate(v, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")), step, lambda a: a["best"])

    def of(sums: Column) -> Column:
        placed = F.transform(sums, lambda x, i: F.struct(x.alias("low"), i.alias("at")))

        def with_lows(lows: Column) -> Column:  # where the sum was lowest so far: stretches begin there
            peaks = F.transform(sums, lambda x, i: F.struct(F.get(lows, i).alias("low"), x.alias("high"), i.alias("at")))
            later = lambda a, b: F.when((a["low"]["at"] == b["low"]["at"]) & (a["high"] >= b["high"]), a).otherwise(b)
            return let(scanned(peaks, later), last)

        def last(peaks: Column) -> Column:
            ended = F.filter(peaks, lambda x, i: F.coalesce(F.get(peaks, i + 1)["low"]["at"] != x["low"]["at"], F.lit(True)))
            fine = F.filter(ended, lambda x: (x["high"] - x["low"]["low"] >= EXCESS) & (x["at"] - x["low"]["at"] >= MIN_STRETCH - 1))
            # the sum at i stands before the transition from character i to the next
            return F.transform(fine, lambda x: F.struct(x["low"]["at"].alias("start"), (x["at"] + 1).alias("end")))

        return let(scanned(placed, lambda a, b: F.least(a, F.struct(b["low"].alias("low"), b["at"].alias("at")))), with_lows)

    sums = lambda v: let(scanned(F.concat(F.array(F.lit(0.0)), F.transform(v, lambda x: x - threshold)), lambda a, b: a + b), of)
    return F.when(most(values) >= EXCESS, sums(values)).otherwise(F.array()).cast(PLACE)


def random_places(run: Column, ratios: Column, threshold: float) -> Column:
    """(start, end) in the text of what is random in a run: all of it, or stretches."""
    place = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def of(v: Column) -> Column:
        parts = F.transform(stretches(v, threshold), lambda x: place(run["start"] + x["start"], run["start"] + x["end"]))
        return F.when(mean(v) > threshold, F.array(place(run["start"], run["end"]))).otherwise(parts)

    return let(ratios_of(run["hit"], ratios), of)


def all_spans(text: Column, ratios: Column, threshold: float) -> Column:
    """start, kind (index into KINDS) and end of every span, in that order."""
    text = F.coalesce(text, F.lit(""))
    of_kind = lambda found, k: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    assign = F.filter(find(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= MIN_ASSIGN)
    base = F.sort_array(F.concat(of_kind(assign, 0), of_kind(find(text, ACCESS), 1), of_kind(find(text, HEX), 2)))

    def with_markov(s: Column) -> Column:
        # base spans are cut out, so that runs end there
        rest = F.when(F.size(s["base"]) > 0, blanked(text, merged(s["base"]))).otherwise(text)
        random = let(rest, lambda t: F.flatten(F.transform(find(t, RUN), lambda x: random_places(x, s["r"], threshold))))
        return F.sort_array(F.concat(s["base"], of_kind(random, 3)))

    return let(F.struct(base.alias("base"), ratios.alias("r")), with_markov)


def with_spans(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, its text, and its spans: an array of (start, kind, end)."""
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), model(docs, labels).alias("ratios"))
    return read.select("row", "text", all_spans(F.col("text"), F.col("ratios"), threshold).alias("spans"))


def scan(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans of every document."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    out = with_spans(bare(docs, "doc_id", "text"), labels, threshold).select("row.doc_id", "spans")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[of(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of(3).alias("n_markov"),
    )


def redacted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with every span replaced by a mask, and n_chars, if there, counted anew."""
    out = with_spans(docs, labels, threshold)
    masks = F.transform(merged(F.col("spans")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(MASK).alias("new")))
    found = F.size("spans") > 0
    new = F.col("row").withField("text", F.when(found, replaced(F.col("text"), masks)).otherwise(F.col("text")))
    out = out.select("spans", new.alias("row"))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.when(F.size("spans") > 0, F.length("row.text").cast("long")).otherwise(F.col("row.n_chars"))))
    return out.select("row.*")
