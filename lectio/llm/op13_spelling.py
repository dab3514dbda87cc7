"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols, so many words share a reduced word. The full one-edit
neighbourhood of every reduced word of the vocabulary (all deletions, replacements and insertions
of one symbol) is generated and joined with the reduced vocabulary: an edit of a word edits its
reduced word at most once, so near words have equal or neighbouring reduced words. What meets is
verified on the original strings.

Reduced words are named by 64-bit polynomial hashes, from which the hashes of all neighbours
follow by a few array operations; a clash of hashes costs a comparison, never a result. Of the two
directions in which a pair of reduced words is generated, that towards the greater hash is kept, so
half the neighbourhood is shuffled and each pair met once.

A word's form is its near word of the largest count, if that is ``RATIO`` times its own; forms are
followed to the last one, the root, by pointer doubling (a chain's counts grow by ``RATIO`` at each
step, which bounds it).

Defined cases: null or empty text: no words; null doc_id: hashed as an empty string; equal rows
each count; very long runs are words like others (their neighbours are made in pieces); ties of
count go to the smallest word in code-point order; an empty table gives no rows; other columns are
ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.components import written
from lectio.llm.words import mix

# The letters of a run, the fewest code points and occurrences of a word, how often
# a run loses a letter, and how much commoner a form is.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TYPO, RATIO = 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Symbols of the reduced alphabet: more of them, more neighbours; fewer, more words to verify.
SYMBOLS = 8
#: Neighbours that a task makes at once.
PIECE = 1 << 18

U64 = np.uint64
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 2**64)


def plain_lower(word: Column) -> Column:
    """Lower case of A-Z alone; words without other letters take the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n) of all whole texts, planted deletions included. Runs below ``LEAST_LETTERS`` can't
    give a word, so they are never made; equal words are counted within each task before the shuffle."""
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.select("id", plain_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    place = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(TYPO)) == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def symbols(codes: np.ndarray) -> np.ndarray:
    """The symbol of every code point: a hash, so that no alphabet is presumed."""
    return ((codes.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(40)) % U64(SYMBOLS)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins."""
    joined = "".join(words.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) for w in words.to_pylist()), np.int64, len(words))
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reduced word of every word, as bytes, and its hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            codes, first = _codes(part.column("word"))
            reduced = symbols(codes)
            sizes = np.diff(first)
            up = _powers(BASE, int(sizes.max(initial=0)))
            with np.errstate(over="ignore"):
                term = (reduced + U64(1)) * up[np.arange(len(codes)) - np.repeat(first[:-1], sizes)]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
                key = mix(total[first[1:]] - total[first[:-1]], 1)
            raw = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(reduced.astype(np.uint8).tobytes())])
            yield pa.record_batch([part.column("word"), part.column("n"), pa.array(key.view(np.int64)), raw], ["word", "n", "key", "reduced"])


def neighbours(reduced: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all distinct one-symbol deletions, replacements and insertions of reduced
    words of one length (rows of symbols), in pieces of bounded size."""
    n, size = reduced.shape
    up, inverse = _powers(BASE, size + 1), U64(INVERSE)
    with np.errstate(over="ignore"):
        value = reduced.astype(np.uint64) + U64(1)
        term = value * up[:size]
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]
        wide = max(1, PIECE // max(1, n))
        for a in range(0, size + 1, wide):
            places = np.arange(a, min(size + 1, a + wide))
            inner = places[places < size]
            own, after = value[:, inner], whole - before[:, inner] - term[:, inner]
            # A deletion within a run of equal symbols is that of its first one.
            fresh = np.ones(own.shape, bool)
            fresh[:, inner > 0] = value[:, inner[inner > 0]] != value[:, inner[inner > 0] - 1]
            row, column = np.nonzero(fresh)
            yield row, mix((before[:, inner] + after * inverse)[row, column], 1)
            for c in range(1, SYMBOLS + 1):
                row, column = np.nonzero(own != U64(c))
                yield row, mix((whole + (U64(c) - own) * up[inner])[row, column], 1)
                # An insertion before an equal symbol is the one after it.
                fresh = np.ones((n, len(places)), bool)
                fresh[:, : len(inner)] = own != U64(c)
                row, column = np.nonzero(fresh)
                rest = whole - before[:, places]
                yield row, mix((before[:, places] + U64(c) * up[places] + rest * U64(BASE))[row, column], 1)


def _generated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, near): each reduced word's own hash, and its neighbours' hashes that are greater."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = part.column("key").to_numpy()
            raw = part.column("reduced").to_pylist()
            sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                for a in range(0, len(rows), step := max(1, PIECE // size)):
                    mine = rows[a: a + step]
                    reduced = np.frombuffer(b"".join(raw[i] for i in mine), np.uint8).reshape(len(mine), size)
                    own = keys[mine]
                    yield pa.record_batch([pa.array(own), pa.array(own)], ["key", "near"])
                    for row, near in neighbours(reduced):
                        near = near.view(np.int64)
                        keep = near > own[row]
                        yield pa.record_batch([pa.array(own[row[keep]]), pa.array(near[keep])], ["key", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all pairs of different words one edit apart, each way."""
    named = written(words.select("word", "n").mapInArrow(_named, "word string, n long, key long, reduced binary"), "spelling-words")
    reduced = named.groupBy("key", "reduced").agg(F.count("*").alias("words"))
    known = named.select(F.col("key").alias("near")).distinct()
    met = reduced.mapInArrow(_generated, "key long, near long").join(known, "near").distinct()
    # Same reduced word: each pair once, by the order of the words.
    left = met.join(named.select("key", F.col("word").alias("a"), F.col("n").alias("n_a")), "key")
    right = named.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right, "near").filter((F.col("key") != F.col("near")) | (F.col("a") < F.col("b")))
    pairs = pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
    pairs = written(pairs, "spelling-pairs")
    back = pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    return pairs.union(back).toDF("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles: forms followed to the last."""
    hops = written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        up = hops.select(F.col("word").alias("root"), F.col("root").alias("above"))
        if hops.join(up, "root", "left_semi").isEmpty():
            return hops
        hops = written(hops.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root")), "spelling-forms")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(documents), "spelling-vocabulary")
    # The commonest near word, the smallest of equals: the least of (-count, word).
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    table = words.join(best, "word", "left")
    common = -F.col("best.less") >= RATIO * F.col("n")
    table = written(table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).cast("long").alias("form_n")), "spelling-best")
    last = roots(table.filter("form is not null"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the words of all documents."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# CRC-32 by its table (built from the polynomial), over the bytes of ASCII and Latin-1 letters.
ORACLE = r"""
with recursive bits as (
  select i, i as c, 0 as k from (select unnest(range(256))::bigint as i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as materialized (select list(c order by i) as t from bits where k = 8),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) as run
  from documents),
counted as (select id, run, count(*) as n from runs group by all),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(id || ':' || run, ''),
           lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as h
  from counted, crc),
typed as (
  select case when h % 31 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed),
w as materialized (select word, cast(sum(n) as bigint) as n from typed where length(word) >= 7 group by word having sum(n) >= 2),
d as materialized (select word, n, i, word[1:i] || word[i + 2:] as cut from (select word, n, unnest(range(length(word))) as i from w)),
p as (
  select a.word, b.word as other, b.n as m from d a join d b on a.cut = b.cut and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union
  select a.word, b.word, b.n from d a join w b on a.cut = b.word
  union
  select b.word, a.word, a.n from d a join w b on a.cut = b.word),
best as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from p group by word),
f as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * w.n then other end as form, case when m >= 10 * w.n then m end as form_n
  from w left join best b on b.word = w.word),
up as (
  select word, word as root, form as next from f
  union all
  select up.word, f.word, f.form from up join f on f.word = up.next)
select f.word, f.form, up.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from f join up on up.word = f.word and up.next is null
"""
