"""Quality classifier by importance resampling over hashed n-gram generative models.

A document's weight is the ratio of its probability under the target model to that under the raw
model: a mixture, over documents, of the target and of the kinds of text that labels reject. Each
part is a multinomial over hashed n-grams of three families (words and signs; beginnings of words,
which generalise over inflected and compounded forms; pairs of neighbouring tokens) and repeats of
a token, fitted on a bounded labelled sample. The mixture's shares are fitted on the raw text: all
documents, by expectation and maximisation. Buckets whose rates don't differ beyond chance and by
a telling factor share one ratio, so the noise of rare n-grams and the sample's mix of languages
don't add up over long texts.

The documents kept are a Gumbel top-k sample of all documents: the log weight plus a Gumbel variate
of the document's id. k is the number of documents that are likelier target than not. So a clear
document is kept, a clear reject goes, and doubtful ones are drawn, likelier ones first. The k-th
key is found by counting keys in ever finer bins, exactly; ties at the cut fall by document id,
then draw equal rows alike.

Bounds: at most ``LABELLED`` labels of each kind (those of the smallest hash) fit the parts, in
2 ** ``BITS`` buckets of each family; both are fixed sizes that do not grow with the data.
Everything else covers all documents.

Defined cases: null, empty or sign-free text: no n-grams, weight zero (log weight -inf), never
kept; a document labelled twice counts as rejected if any label says so; labels without document
or with nulls don't count; no labels of a kind: its model is absent; no target labels: all
weights are one and every document with n-grams is kept; equal rows each keep their row; an empty
table gives no rows; columns of the input keep their values."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.llm.components import written
from lectio.llm.words import U64, WORD_SIGN_CLASS, Tokens, mix, slices, spread

BITS = 18
LABELLED = 20_000
#: Beginnings of words have so many bytes.
EDGE_BYTES = 5
#: Standard deviations and pseudo-counts below which a bucket tells nothing.
CHANCE, PSEUDO = 3.0, 0.5
#: The least factor, as a log, between rates that tell: below it lie the differences that a
#: sample's mix of languages and subjects makes.
TELLING = 1.0
#: The bucket of tokens equal to the token before, after those of the single tokens.
REPEAT = 1 << BITS
#: Where the beginnings of words and the pairs of neighbouring tokens start.
EDGES, PAIRS = REPEAT + 1, REPEAT + 1 + (1 << BITS)
SIZE = PAIRS + (1 << BITS)
FAMILIES = (slice(0, EDGES), slice(EDGES, PAIRS), slice(PAIRS, SIZE))
#: Rounds that fit the mixture's shares; no share falls below the least.
ROUNDS, LEAST_SHARE = 8, 1e-6
SLICE_BYTES = 2 << 20
SEED = 11


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of all n-grams: words and signs in the first 2 ** BITS buckets,
    repeats of a token in the next one, then beginnings of words, then pairs of neighbouring
    tokens, which no repeat counts among."""
    tokens = Tokens(texts, WORD_SIGN_CLASS)
    of = spread(tokens.first)
    words = (tokens.hash >> U64(64 - BITS)).astype(np.int64)
    long = np.flatnonzero(tokens.end - tokens.start > EDGE_BYTES)
    edge = np.zeros(len(long), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(EDGE_BYTES):
            edge = edge * U64(257) + tokens.data[tokens.start[long] + k].astype(np.uint64)
    edges = (mix(edge, 21) >> U64(64 - BITS)).astype(np.int64) + EDGES
    beside = of[1:] == of[:-1]
    same = words[1:] == words[:-1]
    again = np.flatnonzero(beside & same) + 1
    next_ = np.flatnonzero(beside & ~same) + 1
    with np.errstate(over="ignore"):
        pair = mix(tokens.hash[next_ - 1] * U64(257) + tokens.hash[next_], 22)
    pairs = (pair >> U64(64 - BITS)).astype(np.int64) + PAIRS
    return np.concatenate([words, edges, np.full(len(again), REPEAT), pairs]), np.concatenate([of, of[long], of[again], of[next_]])


def sample_labels(labels: DataFrame, bound: int = LABELLED) -> dict[int, np.ndarray]:
    """Ascending document ids of each kind: 0 target, 1 poor quality, 2 else toxic; ``bound`` of each
    at most, those of the smallest hash, so a rerun takes the same."""
    kinds = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    kinds = kinds.select("id", F.when(F.col("q") <= 0, 1).when(F.col("t") > 0, 2).when(F.col("q") > 0, 0).alias("kind")).filter("kind is not null")
    out = {}
    for kind in range(3):
        rows = kinds.filter(F.col("kind") == kind).select("id").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(bound).toArrow()
        out[kind] = np.sort(rows.column("id").to_numpy())
    return out


def _counter(sample: dict[int, np.ndarray]):
    """Per task: n-gram counts of the sampled documents of each kind."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(SIZE, np.int64) for _ in range(3)]
        holders = [np.zeros(SIZE, np.int64) for _ in range(3)]
        documents = [0, 0, 0]
        for batch in batches:
            ids = batch.column("id").fill_null(-1).to_numpy(zero_copy_only=False)
            kind = np.full(len(ids), -1)
            for k, known in sample.items():
                if len(known):
                    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                    kind[(known[at] == ids) & np.array(batch.column("id").is_valid())] = k
            for k in range(3):
                mine = batch.filter(pa.array(kind == k))
                documents[k] += mine.num_rows
                for piece in slices(mine, "text", SLICE_BYTES):
                    buckets, of = features(piece.column("text"))
                    totals[k] += np.bincount(buckets, minlength=SIZE)
                    holders[k] += np.bincount(np.unique(of * SIZE + buckets) % SIZE, minlength=SIZE)
        rows = [(k, -1, documents[k], documents[k]) for k in range(3)]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], ["kind", "bucket", "n", "df"])
        for k, total in enumerate(totals):
            some = np.flatnonzero(total)
            for at in range(0, len(some), 1 << 16):
                b = some[at: at + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(b), k, np.int64)), pa.array(b.astype(np.int64)), pa.array(total[b]), pa.array(holders[k][b])], ["kind", "bucket", "n", "df"])

    return count


class Model:
    """Log ratios of the target to each rejected kind by bucket, and the kinds' shares of the raw
    text: at first those of the labels."""

    def __init__(self, counts: list[np.ndarray], holders: list[np.ndarray], documents: list[int]):
        self.kinds = [k for k in (1, 2) if documents[k]] if documents[0] else []
        total = max(1, sum(documents[k] for k in (0, *self.kinds)))
        self.share = {k: documents[k] / total for k in (0, *self.kinds)}
        self.ratio = {k: np.concatenate([_ratio(counts[0][f], counts[k][f], _told(holders[0][f], holders[k][f], documents[0], documents[k])) for f in FAMILIES]).astype(np.float32) for k in self.kinds}

    @classmethod
    def of(cls, parts: dict) -> Model:
        """From the plain parts that are broadcast: a worker unpickles no class of this package."""
        model = cls.__new__(cls)
        model.__dict__.update(parts)
        return model

    def deltas(self, buckets: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Row per text: log p(text | target) - log p(text | kind) of each kind."""
        return np.stack([np.bincount(of, weights=self.ratio[k][buckets], minlength=n) for k in self.kinds], 1) if self.kinds else np.zeros((n, 0))

    def log_weight(self, deltas: Column) -> Column:
        """log p(text | target) - log p(text | raw), from the texts' deltas."""
        if not self.kinds:
            return F.lit(0.0)
        terms = [F.lit(math.log(self.share[0])), *(F.lit(math.log(self.share[k])) - deltas[i] for i, k in enumerate(self.kinds))]
        most = F.greatest(*terms)
        return -(most + F.log(sum((F.exp(t - most) for t in terms), F.lit(0.0))))

    def fit_shares(self, scored: DataFrame, rounds: int = ROUNDS) -> None:
        """The kinds' shares of the raw text: each round takes the mean, over all texts with n-grams,
        of the chance that a text is of the kind."""
        for _ in range(rounds if self.kinds else 0):
            weight = self.log_weight(F.col("deltas"))
            of_kind = [F.avg(F.exp(weight + math.log(self.share[k]) - F.col("deltas")[i])) for i, k in enumerate(self.kinds)]
            found = scored.filter("n_grams > 0").agg(F.avg(F.exp(weight + math.log(self.share[0]))), *of_kind).first()
            if found[0] is None:
                return
            # Rounded, so that the order of sums doesn't show in a rerun.
            self.share = {k: max(LEAST_SHARE, round(x, 9)) for k, x in zip((0, *self.kinds), found)}


def _told(target: np.ndarray, other: np.ndarray, nt: int, no: int) -> np.ndarray:
    """Buckets that a share of texts holds which differs beyond chance, by a variance-stabilised
    difference; texts are counted, not n-grams, because n-grams come in bursts."""
    expected = no * (target + other) / (nt + no)
    told = np.abs(2 * (np.sqrt(other + 0.375) - np.sqrt(expected + 0.375)) / math.sqrt(nt / (nt + no))) >= CHANCE
    if len(told) > REPEAT:
        told[REPEAT] = True  # most texts hold some repeats; their rate tells
    return told


def _ratio(target: np.ndarray, other: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Per bucket log of the target's rate over the other's; all buckets that don't tell share
    the ratio of their whole mass."""
    nt, no = target.sum() + 1, other.sum() + 1
    ratio = np.log((target + PSEUDO) / nt) - np.log((other + PSEUDO) / no)
    told = told & (np.abs(ratio) >= TELLING)
    rest = math.log((target[~told].sum() + PSEUDO) / nt) - math.log((other[~told].sum() + PSEUDO) / no)
    return np.where(told, ratio, rest)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The models, from the labelled sample. The counts that reach the driver are of fixed size:
    SIZE rows at most."""
    sample = sample_labels(labels)
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    wanted = rows.mapInArrow(_counter(sample), "kind long, bucket long, n long, df long")
    only = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    table = wanted.groupBy("bucket").agg(*(only(k, c) for k in range(3) for c in ("n", "df"))).toArrow()
    bucket = table.column("bucket").to_numpy()
    real = bucket >= 0
    docs = [int(table.column(f"n{k}").to_numpy()[~real].sum()) for k in range(3)]
    counts, holders = ([np.zeros(SIZE, np.int64) for _ in range(3)] for _ in range(2))
    for k in range(3):
        counts[k][bucket[real]] = table.column(f"n{k}").to_numpy()[real]
        holders[k][bucket[real]] = table.column(f"df{k}").to_numpy()[real]
    return Model(counts, holders, docs)


def weigh(rows: DataFrame, model: Model, text: str, n_grams: str, deltas: str) -> DataFrame:
    """``rows`` and two columns, made inside the scan."""
    held = rows.sparkSession.sparkContext.broadcast(model.__dict__)  # fixed size: two float arrays of SIZE

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, SLICE_BYTES):
                n = piece.num_rows
                buckets, of = features(piece.column(text))
                found = Model.of(held.value).deltas(buckets, of, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.record_batch([*piece.columns, pa.array(np.bincount(of, minlength=n).astype(np.int64)), lists], [*piece.schema.names, n_grams, deltas])

    schema = T.StructType([*rows.schema.fields, T.StructField(n_grams, T.LongType()), T.StructField(deltas, T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(add, schema)


def sampling_key(id_: Column, n_grams: Column, log_weight: Column) -> Column:
    """The log weight plus a Gumbel variate of the id; null without n-grams."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), id_), 11).cast("double") + 0.5) / float(1 << 53)
    return F.when(n_grams > 0, log_weight - F.log(-F.log(u)))


def score(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n_grams, log_weight, gumbel): gumbel is the sampling key. Fits the model's shares."""
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = written(weigh(rows, model, "text", "n_grams", "deltas").drop("text"), "quality")
    model.fit_shares(out)
    weight = F.when(F.col("n_grams") > 0, model.log_weight(F.col("deltas"))).otherwise(F.lit(-math.inf))
    out = out.select("id", "n_grams", weight.alias("log_weight"))
    return out.withColumn("gumbel", sampling_key(F.col("id"), F.col("n_grams"), F.col("log_weight")))


def gumbel_cut(scored: DataFrame, k: int) -> tuple[float, int]:
    """(cut, last): the rows of the top k are those with gumbel > cut, and those equal to the cut
    with id <= last. Keys are counted in bins that narrow about the k-th; a few hundred counts
    a round reach the driver."""
    keys = scored.filter("gumbel is not null")
    span = keys.agg(F.min("gumbel").alias("lo"), F.max("gumbel").alias("hi"), F.count("*").alias("n")).first()
    if k <= 0 or not span["n"]:
        return math.inf, -1
    if k >= span["n"]:
        return -math.inf, -1
    lo, hi, above = span["lo"], span["hi"], 0
    while lo < hi:
        step = (hi - lo) / 512
        inside = keys.filter((F.col("gumbel") >= lo) & (F.col("gumbel") <= hi))
        edge = F.least(F.lit(511), F.floor((F.col("gumbel") - lo) / step)) if step > 0 else F.lit(0)
        bins = inside.groupBy(edge.alias("bin")).agg(F.count("*").alias("n"), F.min("gumbel").alias("lo"), F.max("gumbel").alias("hi")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b["n"] >= k:
                if (b["lo"], b["hi"]) == (lo, hi) and len(bins) == 1 and step <= math.ulp(lo):
                    lo = hi = b["lo"]
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
    # Rows at the cut have one key; those of the smallest ids fill the sample.
    tied = keys.filter(F.col("gumbel") == lo).select("id").orderBy(F.col("id").asc_nulls_last()).limit(max(1, k - above)).agg(F.max("id").alias("last")).first()
    return lo, tied["last"] if tied["last"] is not None else -1


def _sampled(documents: DataFrame, labels: DataFrame, text: str, key: str) -> tuple[Model, DataFrame, float, int]:
    model = fit(documents, labels, text, key)
    scored = score(documents, model, text, key)
    likely = F.col("log_weight") >= (math.log(0.5 / model.share[0]) if model.kinds else 0.0)
    k = scored.filter((F.col("n_grams") > 0) & likely).count()
    return model, scored, *gumbel_cut(scored, k)


def _drawn(gumbel: Column, id_: Column, cut: float, last: int) -> Column:
    return F.coalesce((gumbel > cut) | ((gumbel == cut) & (id_ <= last)), F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n_grams, log_weight, gumbel, kept) per row of ``documents``."""
    _, scored, cut, last = _sampled(documents, labels, text, key)
    return scored.withColumn("kept", _drawn(F.col("gumbel"), F.col("id"), cut, last))


def keep_good(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns. Texts are weighed again in
    the scan that filters them, which costs less than to shuffle them for a join."""
    model, _, cut, last = _sampled(documents, labels, text, key)
    n_grams, deltas = (next(x for x in (name + "_" * i for i in range(1, 99)) if x not in documents.columns) for name in ("n_grams", "deltas"))
    rows = weigh(documents, model, text, n_grams, deltas)
    id_ = F.col(key).cast("long")
    return rows.filter(_drawn(sampling_key(id_, F.col(n_grams), model.log_weight(F.col(deltas))), id_, cut, last)).select(*documents.columns)


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts: doc_id, n_grams, log_weight, gumbel, kept."""
    rows = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.withColumnRenamed("id", "doc_id")
