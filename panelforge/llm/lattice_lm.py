"""LM scoring by subword lattice likelihood.

The vocabulary is that of an existing subword tokenizer.  The one such file at hand is of the
merge kind, whose scores are merge ranks and no probabilities (its piece number k has score -k);
so a piece's log probability is its smoothed share among the pieces that the tokenizer gives for
the training texts, which is what a unigram vocabulary's scores stand for.  A word's
probability is the sum over all its segmentations, by forward recursion in log space; words
(with the vocabulary's word-begin mark) are independent, so a text's log10 probability is the
sum over its words, plus that of the end.

Words are counted on the map side, so a word that every text has is a few rows per task.  The
lattice runs once per distinct word of the corpus.  Scores come back to the texts on two ways:
those of at most ``HEAD`` most frequent words (a fixed bound) are broadcast; rarer words are
joined on the word, where none is hot.

Defined results: a null or empty text is its end alone; rows with equal ids are scored each; a
null id counts as the empty text for the training rule, so it is held out; an empty table gives
no rows; with no training text at all every piece is equally likely; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_batches, tokenizer_bytes, written

HEAD = 1 << 16
BINS = 16  # of the histogram of counts, for each doubling
FLUSH = 150_000
ADD = 0.1
MARK = "▁"
LN10 = log(10)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words(text: bytes) -> list[bytes]:
    """A-Z lowered; bytes.split cuts at exactly the ASCII white space."""
    return text.lower().split()


class Vocabulary:
    """Pieces of a tokenizer with their base-e log probabilities."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = sp.get_piece_size()
        self.piece = {sp.id_to_piece(i): i for i in range(self.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte = [0] * 256
        for i in range(self.n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.longest = max(map(len, self.piece))
        self.end = sp.eos_id()

    def counts(self, by_word: list[tuple[str, int]]) -> np.ndarray:
        """Pieces of some words, each counted as often as the word."""
        out = np.zeros(self.n, np.int64)
        for ids, (_, c) in zip(self.sp.encode([w for w, _ in by_word], num_threads=1), by_word, strict=True):
            for i in ids:
                out[i] += c
        return out

    def fit(self, counts: np.ndarray) -> Vocabulary:
        p = np.log((counts + ADD) / (counts.sum() + ADD * self.n))
        self.log_p = p.tolist()
        self.by_piece = {s: self.log_p[i] for s, i in self.piece.items()}
        self.by_byte = [self.log_p[i] for i in self.byte]
        return self

    def word_log10(self, word: str) -> float:
        """Forward recursion: ``a[j]`` is the log of the sum over all segmentations of the first j
        characters.  A character may also stand as its bytes."""
        s = MARK + word
        get, longest, by_byte = self.by_piece.get, self.longest, self.by_byte
        a = [0.0]
        for j in range(1, len(s) + 1):
            terms = [a[j - 1] + sum(by_byte[b] for b in s[j - 1].encode())]
            for i in range(max(0, j - longest), j):
                p = get(s[i:j])
                if p is not None:
                    terms.append(a[i] + p)
            top = max(terms)
            a.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        return a[-1] / LN10


@lru_cache(2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training texts), n (in all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        rest: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(train.keys() | rest.keys())
            c = [train.get(k, 0) for k in keys]
            n = [x + rest.get(k, 0) for k, x in zip(keys, c, strict=True)]
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for b in blocks(batches, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t:
                    (rest if held_out(i) else train).update(words(t))
            if len(train) + len(rest) > FLUSH:
                yield out()
        if train or rest:
            yield out()

    return map_batches(docs, run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def least_count(scored: DataFrame, head: int) -> float:
    """A count that at most ``head`` words reach, from a histogram of a few hundred bins."""
    bins = scored.groupBy(F.floor(F.log2(F.col("n").cast("double")) * BINS).alias("bin")).agg(F.count("*").alias("words")).collect()
    total = 0
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r.words
        if total > head:
            return 2 ** ((r.bin + 1) / BINS) - 1e-9
    return 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    content = tokenizer_bytes(model, "piece_bpe_32k.model")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = written(count_words(d), "words")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(content)
        total = np.zeros(v.n, np.int64)
        for b in batches:
            rows = [(w, c) for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True) if c]
            total += v.counts(rows)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "c"])

    in_training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    ends = d.select("doc_id").agg(F.sum(in_training.cast("long"))).first()[0] or 0
    sums = counted.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n_train, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    v = Vocabulary(content)
    counts = np.zeros(v.n, np.int64)
    for r in map_batches(counted.select("word", "c"), pieces, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect():  # at most one row a piece
        counts[r.piece] = r.c
    counts[v.end] = ends
    below = log10(n_train + ADD * (distinct + 1))
    end_base = log10(ends + ADD) - below
    end_score = v.fit(counts).log_p[v.end] / LN10

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(content).fit(counts)
        for b in batches:
            c = b.column("c").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), pa.array([x > 0 for x in c]), pa.array([log10(x + ADD) - below for x in c], pa.float64()), pa.array([v.word_log10(w) for w in b.column("word").to_pylist()], pa.float64()), b.column("n")],
                ["word", "known", "base", "score", "n"],
            )

    scored = written(map_batches(counted, lattice, "word string, known boolean, base double, score double, n long"), "word-scores")
    top = scored.where(F.col("n") >= least_count(scored, head)).collect()  # at most ``head`` rows
    known = spark.sparkContext.broadcast({r.word.encode(): (int(r.known), r.base, r.score) for r in top})
    names = ["doc_id", "key", "word", "times", "n_tokens", "n_known", "base", "score"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document one row with the sums over its frequent words, under a key that is no
        word; and a row for each distinct rarer word."""
        get = known.value.get
        for b in blocks(batches, "text", 1 << 20):
            ids, key, word, times, n_tok, n_known, base, total = ([] for _ in range(8))
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                w = words(t or b"")
                tag = zlib.crc32(t or b"") << 31 | len(t or b"") & 0x7FFFFFFF
                found = list(map(get, w))
                hit = [x for x in found if x is not None]
                ids.append(i)
                key.append(tag)
                word.append(f" {i} {tag}")
                times.append(1)
                n_tok.append(len(w) + 1)
                n_known.append(sum([x[0] for x in hit]) + (ends > 0))
                base.append(sum([x[1] for x in hit]) + end_base)
                total.append(sum([x[2] for x in hit]) + end_score)
                if len(hit) < len(w):
                    rare = Counter([x for x, y in zip(w, found, strict=True) if y is None])
                    m = len(rare)
                    ids += [i] * m
                    key += [tag] * m
                    word += [x.decode() for x in rare]
                    times += rare.values()
                    for c in (n_tok, n_known, base, total):
                        c += [None] * m
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, key, word, times, n_tok, n_known, base, total), kinds, strict=True)], names)

    rows = map_batches(d, texts, "doc_id long, key long, word string, times long, n_tokens long, n_known long, base double, score double")
    tail = scored.select("word", F.col("known").cast("long").alias("w_known"), F.col("base").alias("w_base"), F.col("score").alias("w_score"))
    j = rows.join(tail, "word", "left")
    whole = F.col("n_tokens").isNotNull()
    out = j.groupBy("doc_id", "key").agg(
        F.count(F.when(whole, 1)).alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.col("times") * F.col("w_known"))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("times") * F.col("w_base"))).alias("base_score"),
        F.sum(F.coalesce("score", F.col("times") * F.col("w_score"))).alias("score"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    out = out.select("*", each)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = lambda c: (F.col(c) / F.col("copies")).alias(c)  # noqa: E731  rows with equal id and text
    return out.select("doc_id", (crc % 10 == 0).alias("held_out"), "n_tokens", share("n_known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), share("base_score"), share("score"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lattice_lm": op5_lattice_lm}
