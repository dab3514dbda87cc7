"""J7's persisted index: character n-grams of the passages with the places that hold them.

``postings(gram, ords, bucket)``: which of a run of at most ``RUN`` passages contain a gram of up
to ``GRAM`` characters (the empty gram is in every text). A run is what a task reads together, so no
list grows beyond it however common the gram, and lists are whole before anything is shuffled.
``counts(gram, n, bucket)``: in how many passages a gram is. Both are laid out by a hash of the
gram; a lookup reads the folders of the grams it wants only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

GRAM = 3                  # characters of the longest gram
RUN = 4096                # passages of a list
RUN_CHARS = 1 << 20       # characters that a task splits at once
BUCKETS = 64              # folders of a table
TEXTS_PER_TASK = 1 << 14
BROADCAST_BYTES = 32 << 20  # bytes of looked-up keywords or grams that are broadcast

POSTINGS = "gram string, ords array<long>, bucket int"
COUNTS = "gram string, n long, bucket int"


@dataclass
class GramIndex:
    postings: DataFrame
    counts: DataFrame


def bucket(gram: str | Column = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def windows(text: Column) -> Column:
    """The ``GRAM`` characters from each place on (fewer at the end), as code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1))


def _spelled(codes: np.ndarray, size: int) -> list[str]:
    """Rows of ``size`` code points as strings."""
    if not size or not len(codes):
        return [""] * len(codes)
    # All rows are decoded as one string and cut: no Python object for each character.
    whole = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le")
    return [whole[i:i + size] for i in range(0, len(whole), size)]


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.r_[True, sorted_[1:] != sorted_[:-1]]] if len(sorted_) else sorted_


def _lists(ords: list[int], texts: list[str]):
    """(gram, ords) of a run of texts as an Arrow batch, or None if the run has to be halved. A gram
    and its text's place make one number, with the run's characters numbered densely, so distinct
    pairs are a plain sort."""
    import pyarrow as pa
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ids = np.asarray(ords, np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    pieces = [(lo, min(lo + RUN_CHARS, total)) for lo in range(0, total, RUN_CHARS)]

    def codes_of(lo: int, hi: int) -> np.ndarray:
        """Code points of a piece of the joined texts, and of what its last windows reach."""
        first, final = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi - 1, side="right"))
        begin = int(ends[first] - sizes[first])
        # A last window may reach into texts after the piece's last one; it ends at its own text's end.
        joined = "".join(texts[first:final + 1])[lo - begin:hi - begin + GRAM - 1]
        return np.frombuffer(joined.encode("utf-32-le"), np.uint32)

    used = np.zeros(0x110000, bool)
    for lo, hi in pieces:
        used[codes_of(lo, hi)] = True
    alphabet = np.flatnonzero(used).astype(np.uint32)
    dense = np.zeros(0x110000, np.int64)
    dense[alphabet] = np.arange(1, len(alphabet) + 1)      # zero is no character
    bits, room = len(alphabet).bit_length(), max(0, len(texts) - 1).bit_length()
    if GRAM * bits + room > 63:                             # too many characters; one text always fits
        return None
    met = []        # sorted numbers (window, text), distinct within a piece
    for lo, hi in pieces:
        codes = dense[codes_of(lo, hi)]
        text = np.searchsorted(ends, np.arange(lo, lo + len(codes)), side="right")
        window = codes << (bits * (GRAM - 1))
        for k in range(1, GRAM):
            together = text[k:] == text[:-k]
            window[:-k] |= np.where(together, codes[k:] << (bits * (GRAM - 1 - k)), 0)
        met.append(_distinct(np.sort(((window << room) | text)[:hi - lo])))
    pairs = _distinct(np.sort(np.concatenate(met))) if len(met) > 1 else (met[0] if met else np.zeros(0, np.int64))
    mask, digit = (1 << room) - 1, (1 << bits) - 1
    grams, offsets, places = [""] if len(texts) else [], [0, len(texts)] if len(texts) else [0], [np.arange(len(texts))]
    held = len(texts)
    ends_at = [np.asarray(offsets, np.int64)]
    # Shorter grams are the beginnings of the windows; the empty one is in every text.
    for size in range(GRAM, 0, -1):
        low = room + bits * (GRAM - size)
        if size < GRAM:
            pairs = _distinct(np.sort((pairs >> low << low) | (pairs & mask)))
        own = pairs[(pairs >> low) & digit != 0]            # windows cut at a text's end are shorter
        gram = own >> room
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(own) else np.zeros(0, np.int64)
        heads = own[starts]
        shown = np.stack([alphabet[((heads >> (room + bits * (GRAM - 1 - k))) & digit) - 1] for k in range(size)], axis=1) if len(heads) else np.zeros((0, size), np.uint32)
        grams += _spelled(shown, size)
        places.append(own & mask)
        held += len(own)
        ends_at.append(np.r_[starts[1:], len(own)][:len(starts)] + (held - len(own)))
    offsets = np.concatenate(ends_at).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[np.concatenate(places)]))
    return pa.record_batch([pa.array(grams, pa.string()), lists], ["gram", "ords"])


def _fitting(ords: list[int], texts: list[str]):
    made = _lists(ords, texts)
    if made is not None:
        yield made
        return
    half = len(texts) // 2
    yield from _fitting(ords[:half], texts[:half])
    yield from _fitting(ords[half:], texts[half:])


def _split(batches):
    for batch in batches:
        ords, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and end - at < RUN and (end == at or chars + len(texts[end]) <= RUN_CHARS):
                chars += len(texts[end])
                end += 1
            yield from _fitting(ords[at:end], texts[at:end])
            at = end


def write_gram_index(passages: DataFrame, path: str | None = None, id_col: str = "ord", text_col: str = "text") -> GramIndex:
    """Builds and writes the index: one pass over the texts; a task writes its own lists, unshuffled."""
    spark = passages.sparkSession
    path = path or scratch_path(spark, "grams")
    texts = passages.select(F.col(id_col).cast("long").alias("ord"), F.col(text_col).alias("text")).filter("text is not null and ord is not null")
    # Small partitions are put together, so files follow the texts.
    tasks = max(spark.sparkContext.defaultParallelism, texts.count() // TEXTS_PER_TASK + 1)
    lists = texts.coalesce(tasks).mapInArrow(_split, "gram string, ords array<long>").withColumn("bucket", bucket())
    lists.sortWithinPartitions("bucket", "gram").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    (_read(spark, f"{path}/postings", POSTINGS).groupBy("bucket", "gram").agg(F.sum(F.size("ords")).cast("long").alias("n"))
     .repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts"))
    return read_gram_index(spark, path)


def read_gram_index(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(_read(spark, f"{path}/postings", POSTINGS), _read(spark, f"{path}/counts", COUNTS))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def rarest(index: GramIndex, keywords: DataFrame) -> DataFrame:
    """(kid, keyword, gram, n): each distinct keyword that can be in a passage, with its rarest gram
    and in how many passages that is. Grams go with the keywords' numbers, not with the keywords."""
    spark = keywords.sparkSession

    def written(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        frame.write.parquet(path)
        return _read(spark, path, frame.schema)

    kw = keywords.filter(F.col("keyword").isNotNull()).select("keyword").distinct()
    kw = written(kw.select(F.monotonically_increasing_id().alias("kid"), "keyword"), "keywords")
    whole = windows(F.col("keyword"))
    own = F.when(F.char_length("keyword") <= GRAM, F.array("keyword")).otherwise(
        F.array_distinct(F.filter(whole, lambda w: F.char_length(w) == GRAM)))
    grams = written(kw.select("kid", F.explode(own).alias("gram")), "keyword-grams")
    known = grams.join(_counts(index, grams), "gram", "left")
    least = known.groupBy("kid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("r"))
    return written(kw.join(least.filter("r.n > 0"), "kid").select("kid", "keyword", F.col("r.gram").alias("gram"), F.col("r.n").alias("n")), "keyword-rarest")


def _folders(grams: DataFrame) -> Column:
    """The folders that hold a wanted gram: at most BUCKETS numbers, as a partition filter."""
    return F.col("bucket").isin([r[0] for r in grams.select(bucket()).distinct().collect()])


def _counts(index: GramIndex, grams: DataFrame) -> DataFrame:
    return index.counts.filter(_folders(grams)).select("gram", "n")


def listed(index: GramIndex, least: DataFrame) -> DataFrame:
    """(keyword, ord, exact): the passages that hold the gram of each keyword of ``rarest``."""
    lists = index.postings.filter(_folders(least)).select("gram", "ords")
    least = least.select("keyword", "gram")
    # Lists meet the keywords where they are read; of keywords beyond that size, only the lists of
    # wanted grams are shuffled.
    size = lambda rows, c: rows.agg(F.coalesce(F.sum(F.octet_length(c) + 64), F.lit(0))).first()[0]
    if size(least, "keyword") <= BROADCAST_BYTES:
        least = F.broadcast(least)
    elif size(grams := least.select("gram").distinct(), "gram") <= BROADCAST_BYTES:
        lists = lists.join(F.broadcast(grams), "gram", "left_semi")
    found = lists.join(least, "gram")
    return found.select("keyword", F.explode("ords").alias("ord"), (F.char_length("keyword") <= GRAM).alias("exact"))


def candidates(index: GramIndex, keywords: DataFrame) -> DataFrame:
    """(keyword, ord, exact): the passages that hold each keyword's rarest gram; for a keyword of
    at most ``GRAM`` characters that gram is the keyword and the hits are ``exact``."""
    return listed(index, rarest(index, keywords))
