"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

In a merge-type encoding every prefix of a text has one last token: the piece, among the
vocabulary matches that end there, whose neighbour to the left (the last token of the shorter
prefix) stays apart from it when the two are encoded together.  The matches come from an
Aho-Corasick automaton, the pair tests are kept in a table, and the ids are read off backwards.
Pieces never reach over a space that follows another character, so a text is worked on in units
of spaces and the characters after them; each distinct unit is encoded once per worker.

Defined results: null and empty texts are the end id alone and decode to the empty text;
repeated rows give a row each; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_batches, tokenizer_bytes

SPACE = "▁"
PAIRS = 1_500_000


class Units(dict):
    """unit -> (ids, ids as text), in two generations: what was not used lately is forgotten.
    ``tail`` may split a new unit into a shorter one and the value of what follows it."""

    def __init__(self, make: Callable, tail: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.tail, self.limit = make, tail, limit
        self.old: dict = {}

    def __missing__(self, unit: str) -> tuple:
        v = self.old.get(unit)
        if v is None:
            t = self.tail(unit)
            if t is None:
                v = self.make(unit)
            else:
                core = self[t[0]]
                v = (core[0] + t[1][0], f"{core[1]} {t[1][1]}")
        self[unit] = v
        return v

    def each(self, units: list[str]) -> list[tuple]:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return [self[u] for u in units]


class MergePrefixEncoder:
    """Encodes text like the library does with the model whose file's content is given."""

    UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.id_of: dict[str, int] = {}
        special = set()
        self.bytes_at = [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(p[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                special.add(i)
            else:
                self.id_of[p] = i
        self.rank = {p: -sp.get_score(i) for p, i in self.id_of.items()}
        self.end = sp.eos_id()
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.pairs = 0
        self.last: dict[str, tuple] = {}
        self.known = Units(self.unit_ids, self.tail)
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) == 1 or self.merged(p) == [p]:  # pieces that no merges reach are never tokens
                self.automaton.add_word(p, (p, len(p), {}))
        self.automaton.make_automaton()

    def merged(self, s: str) -> list[str]:
        """Merging by its definition, for the short strings of pair tests: the best-ranked
        neighbours first, the leftmost of equals."""
        parts, rank = list(s), self.rank.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, piece: str, lefts: dict[str, bool]) -> bool:
        """Whether the two stay apart when encoded together; kept in the piece's own table."""
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 0
            for _, _, table in self.automaton.values():
                table.clear()
        v = lefts[left] = self.merged(left + piece) == [left, piece]
        return v

    def tokens(self, unit: str) -> list[str]:
        """Last token of each prefix, then the tokens from the end backwards."""
        n = len(unit)
        last: list[str | None] = [None] * n
        apart, at = self.apart, 0
        for end, (p, length, lefts) in self.automaton.iter(unit):
            if last[end] is not None:
                continue
            while at < end:  # characters that no piece ends at
                if last[at] is None:
                    last[at] = unit[at]
                at += 1
            i = end - length
            if i < 0:
                last[end] = p
            else:
                v = lefts.get(last[i])
                if v or (v is None and apart(last[i], p, lefts)):
                    last[end] = p
        out, j = [], n - 1
        while j >= 0:
            t = last[j] or unit[j]
            out.append(t)
            j -= len(t)
        out.reverse()
        return out

    def part_ids(self, part: str) -> tuple[tuple[int, ...], str]:
        ids: list[int] = []
        for t in self.tokens(part):
            i = self.id_of.get(t)
            ids += [i] if i is not None else [self.bytes_at[b] for b in t.encode()]
        return tuple(ids), " ".join(map(str, ids))

    def unit_ids(self, unit: str) -> tuple[tuple[int, ...], str]:
        """Ids of a unit, and the same as text; a line feed is in no piece."""
        if "\n" not in unit or "\n" in self.id_of:
            return self.part_ids(unit)
        v = [self.part_ids(x) for x in re.findall("\n|[^\n]+", unit)]
        return tuple(chain.from_iterable([x[0] for x in v])), " ".join([x[1] for x in v])

    def tail(self, unit: str) -> tuple[str, tuple] | None:
        """Two characters that stand together in no piece are in different tokens: there the last
        character may be taken off."""
        if len(unit) < 2 or unit[-1].isalnum() or unit[-2:] in self.inside:
            return None
        c = unit[-1]
        v = self.last.get(c)
        if v is None:
            v = self.last[c] = self.part_ids(c)
        return unit[:-1], v

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return self.UNIT.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + p for p in text.split(" ")]

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids with the end id, and the same as decimal text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], str]]:
        out = []
        for t in texts:
            parts = self.known.each(self.split(t))
            ids = list(chain.from_iterable([p[0] for p in parts]))
            ids.append(self.end)
            out.append((ids, " ".join([p[1] for p in parts] + [str(self.end)])))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(2)
def encoder(model: bytes) -> MergePrefixEncoder:
    """Kept by the worker process, so that its later tasks know the units of the earlier."""
    return MergePrefixEncoder(model)


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; with ``with_ids`` also the ids and the decoded text."""
    content = tokenizer_bytes(model, "piece_bpe_32k.model")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content)
        for b in blocks(batches, "text"):
            n, sha, dec, all_ids, decoded = [], [], [], [], []
            for ids, s in enc.encode_all([t or "" for t in b.column("text").to_pylist()]):
                d = enc.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(s.encode()).hexdigest())
                dec.append(hashlib.sha256(d.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    decoded.append(d)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.string())]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def op9_merge_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_merge_prefix": op9_merge_prefix}
