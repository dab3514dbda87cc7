"""Benchmark decontamination by a BM25 inverted index of the test items and block-max WAND.

Test items are split into question and answer (the last sentence) and indexed once: a posting is an item with the
term's BM25 weight, as a share of the item's threshold (a part of its score against itself). So
one limit, 1, holds for all items. Every passage of every training text (windows of twice the
longest item, half overlapping, so that an item lies whole in one) is a query. The bound of a
passage is the sum of its terms' greatest weights; if that reaches 1, bounds are taken for each
block of items from the block maxima; only postings of blocks that reach 1 are summed. All items
at or above 1 are retrieved, with no cut to a number. A retrieved item counts as a leak if the
passage holds enough of both the question's and the answer's word n-grams. An item of fewer than
``LEAST_WORDS`` words is a leak if the passage holds its whole word sequence. In scripts that
write no spaces between words each character counts as a word.

The index is built on the driver in shards of at most ``SHARD_WORDS`` words, each broadcast (a
fixed bound); a benchmark of more shards takes one pass over the texts for each.

Defined cases: null text: no passages; items without words are no evidence; equal items are leaks of their own each; null ids stay null; equal
rows each count; no items: no leaks; an empty table gives no rows; columns of the input keep
their values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.words import U64, WORD_SIGN_CLASS, Tokens, mix, slices, spread

#: BM25's constants; the share of an item's own score that retrieves it.
K1, B, THRESHOLD = 1.2, 0.75, 0.6
#: Items of one block of the index.
BLOCK = 16
#: Word n-grams, and the share of the question's and of the answer's that a leak holds.
GRAM, OVERLAP = 3, 0.6
#: Items of fewer words must be held word for word.
LEAST_WORDS = 8
SHARD_WORDS = 1 << 20
SLICE_BYTES = 1 << 20
#: Bounds and scores that are held at once.
CELLS = 1 << 20

#: Words as in the index: signs between words don't count.
_WORD_ONLY = np.where(WORD_SIGN_CLASS == 1, 1, 0).astype(np.uint8)

#: Signs and spaces beyond ASCII: Latin-1 signs, general punctuation, currency, arrows to dingbats.
_SIGNS = r"[\x{A0}-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}\x{D7}\x{F7}\x{1680}\x{2000}-\x{206F}\x{20A0}-\x{20CF}\x{2190}-\x{27BF}\x{2E00}-\x{2E5D}\x{FEFF}]"
#: Characters of scripts that write no spaces between words (with the marks that may follow), and their signs.
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]\p{M}*"
_WIDE_SIGNS = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"


def words_of(texts: pa.Array) -> Tokens:
    """Words in lower case (of all scripts), without the signs between them; characters of scripts
    without spaces are words of their own."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    # Texts without such a character, which are most, are not rewritten.
    held = pc.fill_null(pc.match_substring_regex(low, f"{_UNSPACED}|{_WIDE_SIGNS}|{_SIGNS}"), False)
    if pc.any(held).as_py():
        split = pc.replace_substring_regex(pc.replace_substring_regex(low, f"{_WIDE_SIGNS}|{_SIGNS}", " "), f"({_UNSPACED})", r" \1 ")
        low = pc.if_else(held, split, low)
    return Tokens(low, _WORD_ONLY)


def last_sentence(text: str) -> str:
    """The last sentence or line, which answers the rest."""
    return next((x for x in reversed(re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n+", text.strip())) if x.strip()), "")


def grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the word n-grams of one sequence."""
    out = hashes[: max(len(hashes) - GRAM + 1, 0)].copy()
    with np.errstate(over="ignore"):
        for k in range(1, GRAM):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[k: k + len(out)]
    return mix(out, 8)


def holds(words: np.ndarray, sequence: np.ndarray) -> bool:
    """Whether ``sequence`` stands in ``words`` without a gap."""
    n = len(words) - len(sequence) + 1
    return n > 0 and bool(np.logical_and.reduce([words[k: k + n] == w for k, w in enumerate(sequence)]).any())


def _expand(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, row numbers) of the runs ``first[r]:first[r + 1]`` of all rows, one after another."""
    size = first[rows + 1] - first[rows]
    of = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[rows][of], of


class Index:
    """Postings by term, with item and block bounds."""

    def __init__(self, ids: list, texts: list[str]):
        tokens = words_of(pa.array(texts, pa.string()))
        length = np.diff(tokens.first)
        keep = np.flatnonzero(length > 0)
        self.ids = [ids[i] for i in keep]
        self.longest = int(length[keep].max()) if len(keep) else 1
        item = np.full(len(texts), -1)
        item[keep] = np.arange(len(keep))
        of = item[spread(tokens.first)]
        pair, times = np.unique(np.stack([tokens.hash[of >= 0], of[of >= 0].astype(np.uint64)]), axis=1, return_counts=True)
        terms, at, df = np.unique(pair[0], return_inverse=True, return_counts=True)
        self.terms = terms
        posting_item = pair[1].astype(np.int64)
        n = max(1, len(keep))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length[keep] / max(1.0, length[keep].mean() if len(keep) else 1.0))
        raw = idf[at] * times * (K1 + 1) / (times + norm[posting_item]) if len(pair[0]) else np.zeros(0)
        self.own = np.bincount(posting_item, weights=raw, minlength=len(keep))
        self.weight = raw / (THRESHOLD * self.own[posting_item]) if len(raw) else raw
        self.first = np.searchsorted(at, np.arange(len(terms) + 1))
        self.item = posting_item
        self.bound = np.maximum.reduceat(self.weight, self.first[:-1]) if len(terms) else np.zeros(0)
        # Block maxima, by term and block, as postings of their own.
        key = at * (n // BLOCK + 1) + posting_item // BLOCK
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block_max = np.maximum.reduceat(self.weight, start) if len(key) else np.zeros(0)
        self.block = key[start] % (n // BLOCK + 1) if len(key) else np.zeros(0, np.int64)
        self.block_first = np.searchsorted(at[start] if len(key) else at, np.arange(len(terms) + 1))
        self.blocks = n // BLOCK + 1
        # The answer is the last sentence if both halves hold an n-gram, else the last quarter.
        answers = np.diff(words_of(pa.array([last_sentence(texts[i]) for i in keep], pa.string())).first)
        whole = length[keep]
        answers = np.where((answers >= GRAM) & (whole - answers >= GRAM), answers, np.maximum(GRAM, whole // 4))
        answers = np.minimum(answers, whole)
        cuts = list(zip(tokens.first[keep].tolist(), (tokens.first[keep + 1] - answers).tolist(), tokens.first[keep + 1].tolist()))
        self.short = {i: tokens.hash[a:c] for i, (a, _, c) in enumerate(cuts) if c - a < LEAST_WORDS}
        self.grams = [[grams(tokens.hash[a:b]) for a, b, _ in cuts], [grams(tokens.hash[b:c]) for _, b, c in cuts]]

    @classmethod
    def of(cls, parts: dict) -> Index:
        """From the plain parts that are broadcast: a worker unpickles no class of this package."""
        index = cls.__new__(cls)
        index.__dict__.update(parts)
        return index

    def retrieve(self, window: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, share of the threshold) at or above 1 for windows 0..n-1, given their
        distinct terms, ordered by window."""
        at, of = _expand(self.block_first, term)
        key = window[of] * self.blocks + self.block[at]
        open_block = np.bincount(key, weights=self.block_max[at], minlength=n * self.blocks) >= 1 - 1e-9
        live = open_block.reshape(n, self.blocks).any(1)
        out: list[tuple] = []
        step = max(1, CELLS // len(self.ids))
        chosen = np.flatnonzero(live)
        first = np.searchsorted(window, np.arange(n + 1))
        for begin in range(0, len(chosen), step):
            some = chosen[begin: begin + step]
            pair, local = _expand(first, some)
            at, of = _expand(self.first, term[pair])
            item, here = self.item[at], local[of]
            inside = open_block[some[here] * self.blocks + item // BLOCK]
            score = np.bincount(here[inside] * len(self.ids) + item[inside], weights=self.weight[at[inside]], minlength=len(some) * len(self.ids))
            hit = np.flatnonzero(score >= 1 - 1e-9)
            out.append((some[hit // len(self.ids)], hit % len(self.ids), score[hit]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, item, BM25 score, question overlap, answer overlap, first word) of all leaks."""
        if not self.ids:
            return
        tokens = words_of(texts)
        at = np.minimum(np.searchsorted(self.terms, tokens.hash), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == tokens.hash)
        count = np.diff(tokens.first)
        stride = self.longest
        last = np.maximum(-(-count // stride) - 2, 0)  # windows 0..last of a text; window k begins at k strides
        base = np.cumsum(last + 1) - (last + 1)
        of = spread(tokens.first)[known]
        part = (known - tokens.first[of]) // stride
        window = np.concatenate([base[of] + np.minimum(part, last[of]), base[of] + np.maximum(np.minimum(part - 1, last[of]), 0)])
        pair = np.unique((window << 32) | np.concatenate([at[known]] * 2))
        window, term = pair >> 32, pair & 0xFFFFFFFF
        bound = np.bincount(window, weights=self.bound[term], minlength=int(base[-1] + last[-1] + 1) if len(count) else 0)
        starts = np.searchsorted(window, np.arange(len(bound) + 1))
        live = np.flatnonzero(bound >= 1 - 1e-9)
        step = max(1, CELLS // self.blocks)
        for at in range(0, len(live), step):
            some = live[at: at + step]
            pair, local = _expand(starts, some)
            for w, i, s in zip(*self.retrieve(local, term[pair], len(some))):
                text = int(np.searchsorted(base, some[w], side="right") - 1)
                begin = (some[w] - base[text]) * stride
                here = tokens.hash[tokens.first[text] + begin: min(tokens.first[text] + begin + 2 * stride, tokens.first[text + 1])]
                if i in self.short:
                    overlap = [float(holds(here, self.short[i]))] * 2
                else:
                    here = grams(here)
                    overlap = [float(np.isin(g[i], here).mean()) for g in self.grams]
                if min(overlap) >= OVERLAP:
                    yield text, int(i), float(s * THRESHOLD * self.own[i]), overlap[0], overlap[1], int(begin)


def shards(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes over the items, in shards of at most ``SHARD_WORDS`` words (a longer item alone)."""
    rows = benchmark.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    # Characters bound the words of any script.
    rows = rows.withColumn("words", F.char_length("text") / 2 + 1).orderBy(F.col("id").asc_nulls_first(), "text")
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in rows.toLocalIterator():  # a shard at a time
        if texts and size + r["words"] > SHARD_WORDS:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += r["words"]
    if texts:
        yield Index(ids, texts)


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def find_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per leaked (doc_id, item_id): the best passage's score, overlaps and first word."""
    spark: SparkSession = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for index in shards(benchmark):
        held = spark.sparkContext.broadcast(index.__dict__)

        def search(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index.of(held.value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            for batch in batches:
                for piece in slices(batch, "text", SLICE_BYTES):
                    found = list(index.search(piece.column("text")))
                    if found:
                        ids = piece.column("doc_id").to_pylist()
                        columns = zip(*((ids[t], index.ids[i], s, q, a, b) for t, i, s, q, a, b in found))
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        out = out.unionByName(rows.mapInArrow(search, LEAKS))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("back"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", (-F.col("best.back")).alias("first_word"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that leak no item; a filter inside the scan, without a shuffle."""
    spark: SparkSession = documents.sparkSession
    out = documents
    for index in shards(benchmark):
        held = spark.sparkContext.broadcast(index.__dict__)

        def clean(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index.of(held.value)
            for batch in batches:
                for piece in slices(batch, text, SLICE_BYTES):
                    leaked = {t for t, *_ in index.search(piece.column(text).cast(pa.string()))}
                    yield piece.filter(pa.array([i not in leaked for i in range(piece.num_rows)], pa.bool_())) if leaked else piece

        out = out.mapInArrow(clean, out.schema)
    return out


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, against all items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
