"""LM scoring by subword lattice likelihood.

The model is a unigram model over the pieces of an existing vocabulary (never trained here). The
vocabulary's scores rank its pieces; a Zipf law over the ranks is the prior, and the counts of
pieces in the training documents make it a distribution. A text's probability is marginal: the
sum over all segmentations of every word into pieces, by a forward recursion in log space.
Pieces don't cross words, so a text's log probability is the sum over its words, and each
distinct word's lattice is computed once. Characters outside the vocabulary are spelt in bytes.

The words of all texts are counted (combined inside tasks, then by a grouping), so what is
gathered grows with the corpus. Words at or above a count, of which at most ``HELD`` exist, are
looked up in an array that is broadcast (its size is fixed); all other words are joined. Both
give the same numbers, so the bound is only about speed.

Beside it stands the base model: add-one word unigrams.

Defined cases: null text: empty, one token (the end); null id: a training document; equal rows
each keep their row and each count in training; no training document: counts of zero; an empty
table gives no rows; other columns are ignored. Words are told apart by a 64-bit hash."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.components import written
from lectio.llm.words import U64, Tokens, slices, spread

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The most words in the broadcast array: 20 bytes each.
HELD = 1 << 20
#: Pseudo-counts that the prior is worth.
PRIOR = 32_000.0
SLICE_BYTES = 1 << 20
#: Words that a task combines before it sends them on.
COMBINED = 250_000


def read_vocabulary(path: str) -> tuple[bytes, list[str], np.ndarray, np.ndarray]:
    """(model file, pieces, prior, whether a piece is a byte) of a vocabulary file."""
    import sentencepiece

    with open(path, "rb") as file:
        proto = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    usable = np.array([not (model.is_control(i) or model.is_unknown(i)) for i in range(n)])
    rank = np.empty(n)
    rank[np.lexsort((np.arange(n), -scores))] = np.arange(n)
    prior = np.where(usable, 1 / (rank + 2.7), 0)
    return proto, pieces, prior / prior.sum(), np.array([model.is_byte(i) for i in range(n)])


class Lattice:
    """Marginal log10 probability of words; ``logs`` has log10 of each piece's probability."""

    def __init__(self, pieces: list[str], logs: np.ndarray, byte: np.ndarray):
        self.piece = {p: float(x) for p, x, b in zip(pieces, logs, byte) if not b and math.isfinite(x)}
        self.byte = {int(p[3:5], 16): float(x) for p, x, b in zip(pieces, logs, byte) if b}
        self.longest = max(map(len, self.piece), default=1)

    def spell(self, sign: str) -> float:
        return sum(self.byte.get(b, -9.0) for b in sign.encode("utf-8", "replace"))

    def log10(self, word: str) -> float:
        text = "▁" + word
        n, longest, get = len(text), self.longest, self.piece.get
        forward = [0.0] + [0.0] * n
        for end in range(1, n + 1):
            arcs = []
            for begin in range(max(0, end - longest), end):
                p = get(text[begin:end])
                if p is not None:
                    arcs.append(forward[begin] + p)
            if text[end - 1] not in self.piece:
                arcs.append(forward[end - 1] + self.spell(text[end - 1]))
            if len(arcs) == 1:
                forward[end] = arcs[0]
            else:
                top = max(arcs)
                forward[end] = top + math.log10(sum(10 ** (x - top) for x in arcs))
        return forward[n]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, word, trained, n): occurrences of each word in training texts and in all."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        hashes, trained, n = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2))
        words = pa.concat_arrays([x[3] for x in held])
        order = np.argsort(hashes, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        held[:] = [(hashes[order][start], np.add.reduceat(trained[order], start), np.add.reduceat(n[order], start), words.take(pa.array(order[start])))]
        return held[0]

    def batches_of(row: tuple) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(row[0]), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(row[0][cut].view(np.int64)), row[3][cut], pa.array(row[1][cut]), pa.array(row[2][cut])], ["hash", "word", "trained", "n"])

    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            tokens = Tokens(piece.column("text"))
            if not len(tokens.hash):
                continue
            train = piece.column("train").to_numpy(zero_copy_only=False).astype(np.int64)[spread(tokens.first)]
            order = np.argsort(tokens.hash, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], tokens.hash[order][1:] != tokens.hash[order][:-1]]))
            n = np.diff(np.append(start, len(order)))
            one = order[start]
            begin, end = tokens.start[one], tokens.end[one]
            offsets = np.concatenate([[0], np.cumsum(end - begin)])
            places = np.arange(offsets[-1]) - np.repeat(offsets[:-1], end - begin) + np.repeat(begin, end - begin)
            words = pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(tokens.data[places])]).cast(pa.string())
            held.append((tokens.hash[one], np.add.reduceat(train[order], start), n.astype(np.int64), words))
            size += len(one)
            if size > 2 * COMBINED:
                row = flush()
                size = len(row[0])
                if size > COMBINED:
                    yield from batches_of(row)
                    held.clear()
                    size = 0
    if held:
        yield from batches_of(flush())


def _count_pieces(proto: bytes, n_pieces: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        total = np.zeros(n_pieces, np.int64)
        for batch in batches:
            ids = model.encode(batch.column("word").to_pylist(), num_threads=1)
            times = batch.column("trained").to_numpy()
            if ids:
                total += np.bincount(np.concatenate([np.array(x, np.int64) for x in ids]), weights=np.repeat(times, [len(x) for x in ids]), minlength=n_pieces).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(total[some])], ["piece", "n"])

    return count


def _weigh_words(pieces: list[str], logs: np.ndarray, byte: np.ndarray):
    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logs, byte)
        for batch in batches:
            scores = [lattice.log10(w) for w in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("hash"), batch.column("trained"), batch.column("n"), pa.array(scores, pa.float64())], ["hash", "trained", "n", "lattice"])

    return weigh


SCORED = "doc_id long, held_out boolean, n_words long, known long, base double, lattice double, rest array<struct<hash:long,times:long>>"


def score_texts(documents: DataFrame, vocabulary: str = VOCABULARY, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark: SparkSession = documents.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))

    counted = docs.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count_words, "hash long, word string, trained long, n long")
    words = written(counted.groupBy("hash").agg(F.min("word").alias("word"), F.sum("trained").alias("trained"), F.sum("n").alias("n")), "lattice-words")
    ends = docs.filter(~F.col("held_out")).count()
    sums = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count_if(F.col("trained") > 0).alias("v")).first()
    train_tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)

    proto, pieces, prior, byte = read_vocabulary(vocabulary)
    # One count a piece: the vocabulary bounds what the driver gets.
    found = words.filter("trained > 0").select("word", "trained").mapInArrow(_count_pieces(proto, len(pieces)), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(pieces))
    counts[found.column("piece").to_numpy()] = found.column("n").to_numpy()
    counts[prior == 0] = 0
    total = counts.sum() + PRIOR + ends + 1
    with np.errstate(divide="ignore"):
        logs = np.log10((counts + PRIOR * prior) / total)
    end_log = math.log10((ends + 1) / total)
    weighed = written(words.mapInArrow(_weigh_words(pieces, logs, byte), "hash long, trained long, n long, lattice double"), "lattice-weights")

    # The lowest count at which the words fit the array.
    top = 1 << 20
    steps = weighed.groupBy(F.least(F.col("n"), F.lit(4096)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, sum_words = top, 0
    for s in steps:
        sum_words += s["words"]
        if sum_words > held:
            break
        least = s["n"]
    frequent = weighed.filter(F.col("n") >= least).select("hash", F.log10(F.col("trained") + 1.0).cast("double").alias("base"), (F.col("trained") > 0).alias("known"), "lattice").toArrow()
    columns = [frequent.column(c).to_numpy() for c in ("hash", "base", "lattice", "known")]
    del frequent
    columns[0] = columns[0].view(np.uint64)
    order = np.argsort(columns[0])
    table = spark.sparkContext.broadcast(tuple(c[order] for c in columns))
    del columns

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, lattice, known = table.value
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("times", pa.int64())]))
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                n = piece.num_rows
                tokens = Tokens(piece.column("text"))
                of = spread(tokens.first)
                order = np.argsort(tokens.hash)
                ranked, of = tokens.hash[order], of[order]
                at = np.minimum(np.searchsorted(hashes, ranked), max(len(hashes) - 1, 0))
                hit = hashes[at] == ranked if len(hashes) else np.zeros(len(ranked), bool)
                at, own = at[hit], of[hit]
                key = np.lexsort((ranked[~hit], of[~hit]))
                rest, rest_of = ranked[~hit][key], of[~hit][key]
                fresh = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1])])) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(rest)))
                offsets = np.searchsorted(rest_of[fresh], np.arange(n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rest[fresh].view(np.int64)), pa.array(times.astype(np.int64))], ["hash", "times"])
                yield pa.record_batch([
                    piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(tokens.first).astype(np.int64)),
                    pa.array(np.bincount(own, weights=known[at], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(own, weights=base[at], minlength=n)), pa.array(np.bincount(own, weights=lattice[at], minlength=n)),
                    pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(kind),
                ], ["doc_id", "held_out", "n_words", "known", "base", "lattice", "rest"])

    rows = docs.mapInArrow(score, SCORED).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "lattice-scores")
    single = rows.filter("size(rest) > 0").select("row", F.explode("rest").alias("r")).select("row", "r.*")
    rare = single.join(weighed.filter(F.col("n") < least).select("hash", "trained", F.col("lattice").alias("log")), "hash")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("trained") + 1.0)).alias("more_base"),
        F.sum(F.col("times") * F.col("log")).alias("more_lattice"),
    )
    zero = F.lit(0.0)
    out = rows.drop("rest").join(rare, "row", "left")
    tokens = F.col("n_words") + 1
    return out.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + math.log10(ends + 1) - tokens * math.log10(train_tokens + distinct + 1)).alias("base_score"),
        (F.col("lattice") + F.coalesce("more_lattice", zero) + end_log).alias("score"),
    )


def op8_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, whole texts."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
