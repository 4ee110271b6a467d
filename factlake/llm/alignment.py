"""Alignment of two tokenizers' tokens over the bytes of each text.

Bit i of a tokenizer's bitset is set if one of its tokens ends with byte i. The
AND of two bitsets has the shared cuts; counting bits up to a cut (a directory of
counts per 64 bits, plus a popcount inside the word) gives how many tokens of
either side end there, so each cut maps to token ranges on both sides: a group
ends at each cut, and the last tokens of its sides are linked.

Both tokenizers always cut before a blank that stands between two other
characters: texts are taken apart there, all pieces that a task has not met
before are aligned together in two packed bitsets, and what they give is kept.

How often a pair of ids is linked in all texts is counted over all rows, partly
inside tasks, then shuffled by pair. A table of at most ``MOST_PAIRS`` pairs is
sent to the tasks that judge the links of texts; a larger one is joined.

Edge cases: a text that is null, empty, or does not come back from the bytes of
either side's tokens (as with U+2581) has no tokens: zeros and an empty digest;
strings of special tokens are plain text; repeated rows count as often as they
occur, whatever their ids; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm.common import staged, text_batches

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a task remembers, twice at most, and the longest one; pieces encoded in one row.
CACHE_PIECES, CACHE_CHARS, JOINED = 150_000, 64, 200
#: Characters of texts taken apart at a time, links counted at a time.
SOME_CHARS, SOME_LINKS = 1_000_000, 500_000
#: Pairs sent to tasks: 25 bytes each.
MOST_PAIRS = 2_000_000

_ODD = re.compile(r"\s\s|^\s|\s\Z")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def pieces_of(text: str) -> list[str]:
    """A text cut at the blanks between two characters that are no white space."""
    return _BETWEEN.split(text) if _ODD.search(text) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bitset:
    """Token ends over bytes, packed in words of 64 bits, with counts before each word."""

    def __init__(self, ends: np.ndarray, size: int) -> None:
        bits = np.zeros(-(-max(size, 1) // 64) * 64, np.uint8)
        bits[ends - 1] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set up to each of the positions, included."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def cuts(a: Bitset, b: Bitset) -> np.ndarray:
    """Positions at which both have a token's end."""
    shared = a.words & b.words
    return np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))


class Aligner(dict):
    """By piece, for a blank and the piece: (tokens of A, of B, groups as text with a closing semicolon, ids linked); None if its bytes do not come back.

    Pieces met lately are in the mapping; those of the time before in ``old``.
    """

    def __init__(self, a: str, b: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        self.old: dict[str, tuple | None] = {}
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        stands, vocabulary = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(stands[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces of this vocabulary reach over blanks")
        self.long_a, self.long_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # how an id is written inside a group's side, and at the end of it
        many_a, many_b = len(self.bytes_a), len(self.bytes_b)
        self.written = [f"{i}{mark}" for many, marks in ((many_a, ",|"), (many_b, ",;")) for mark in marks for i in range(many)]
        self.last_a, self.from_b, self.last_b = many_a, 2 * many_a, 2 * many_a + many_b

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides for pieces in a row, each after a blank."""
        rows = [" ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        left = self.a.encode_batch_fast([" " + x for x in rows], add_special_tokens=False)
        right = self.b.encode(rows, num_threads=1)
        return np.concatenate([e.ids for e in left]).astype(np.int64), np.concatenate(right).astype(np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Align pieces, all in one pair of bitsets. Those with white space at an end are taken on their own."""
        plain = [p for p in pieces if not (p[:1].isspace() or p[-1:].isspace())]
        if plain:
            self._learn(plain)
        if len(plain) < len(pieces):
            for p in pieces:
                if p not in self:
                    self._learn([p])

    def _learn(self, pieces: list[str]) -> None:
        own = [f" {p}".encode() for p in pieces]
        ids_a, ids_b = self.tokens(pieces)
        whole = b"".join(own)
        if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != whole:
            if len(pieces) == 1:
                self[pieces[0]] = None
            else:
                for half in (pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :]):
                    self._learn(half)
            return
        a, b = Bitset(np.cumsum(self.long_a[ids_a]), len(whole)), Bitset(np.cumsum(self.long_b[ids_b]), len(whole))
        at = cuts(a, b)
        rank_a, rank_b = a.rank(at), b.rank(at)
        links = np.stack([ids_a[rank_a - 1], ids_b[rank_b - 1]], axis=1).astype(np.int32)
        # a group is its ids of A, then those of B: places of all in one row
        group_a, group_b = (np.searchsorted(rank, np.arange(len(ids)), side="right") for rank, ids in ((rank_a, ids_a), (rank_b, ids_b)))
        row = np.empty(len(ids_a) + len(ids_b), np.int64)
        row[np.arange(len(ids_a)) + np.concatenate([[0], rank_b])[group_a]] = ids_a
        row[np.arange(len(ids_b)) + rank_a[group_b]] = ids_b + self.from_b
        row[rank_a - 1 + np.concatenate([[0], rank_b[:-1]])] += self.last_a
        row[rank_b - 1 + rank_a] += self.last_b - self.from_b
        text = list(map(self.written.__getitem__, row.tolist()))
        # a piece ends at a cut: its groups are those up to there
        last = np.searchsorted(at, np.cumsum(list(map(len, own))))
        n_a, n_b = (np.diff(np.concatenate([[0], rank[last - 1]])).tolist() for rank in (rank_a, rank_b))
        done = 0
        for p, x, y, first, end in zip(pieces, n_a, n_b, [0, *last.tolist()], last.tolist(), strict=False):
            self[p] = (x, y, "".join(text[done : done + x + y]), links[first:end].tobytes())
            done += x + y

    def texts(self, texts: list[str]) -> Iterator[list[tuple] | None]:
        """What the pieces of each text give; None for a text without tokens."""
        cut = [pieces_of(t) if t and "▁" not in t else [] for t in texts]
        needed = set().union(*cut)
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        missing = [p for p in needed if p not in self]
        old = self.old
        self.update((p, old[p]) for p in missing if p in old)
        missing = [p for p in missing if p not in old]
        if missing:
            self.learn(missing)
        for own in cut:
            found = list(map(self.__getitem__, own))
            yield found if found and None not in found else None
        for p in missing:
            if len(p) > CACHE_CHARS:
                del self[p]


_loaded: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    """One per worker process and pair of files, kept for its next tasks."""
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(a, b)
    return _loaded[a, b]


def _some(texts: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= SOME_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def align(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, groups_sha256, link_a, link_b) of each text, and its ``groups`` as text on request.

    ``link_a`` and ``link_b`` are the linked ids in order of the bytes.
    """
    a, b = public_tokenizers.path(side_a), public_tokenizers.path(side_b)
    schema = "doc_id long, n_a long, n_b long, groups_sha256 string, link_a array<int>, link_b array<int>" + ", groups string" * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        for batch in batches:
            doc_ids, done = batch.column(0), 0
            for texts in _some(batch.column(1)):
                n_a, n_b, digests, all_groups, links, ends = [], [], [], [], [], [0]
                for found in aligner.texts(texts):
                    own = list(zip(*found, strict=True)) if found else [(), (), (), ()]
                    groups = "".join(own[2])[:-1]
                    n_a.append(sum(own[0]))
                    n_b.append(sum(own[1]))
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if found else "")
                    if with_groups:
                        all_groups.append(groups)
                    links.append(b"".join(own[3]))
                    ends.append(ends[-1] + len(links[-1]) // 8)
                offsets, pairs = pa.array(ends, pa.int32()), np.frombuffer(b"".join(links), np.int32).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(pairs[:, i]))) for i in (0, 1)]
                cols = [doc_ids.slice(done, len(texts)), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(digests, pa.string()), *lists]
                names = ["doc_id", "n_a", "n_b", "groups_sha256", "link_a", "link_b"]
                if with_groups:
                    cols, names = [*cols, pa.array(all_groups, pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                done += len(texts)

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _codes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """One number for each pair of ids."""
    return a.to_numpy().astype(np.int64) << 32 | b.to_numpy().astype(np.int64)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n): how often each pair of ids is linked in all rows of ``links``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            cols = [(codes >> 32).astype(np.int32), codes.astype(np.int32), n.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n"])

        held, size = [], 0
        for batch in batches:
            held.append(_codes(batch.column(0).flatten(), batch.column(1).flatten()))
            size += len(held[-1])
            if size >= SOME_LINKS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return links.select("link_a", "link_b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _looked_up(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum, from a pair table sent to the tasks."""
    table = pairs.select("a", "b", "n", "best").toArrow()
    codes = _codes(table.column("a"), table.column("b"))
    order = np.argsort(codes)
    sent = rows.sparkSession.sparkContext.broadcast((codes[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order].astype(bool)))
    keep = ["doc_id", "n_a", "n_b", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = sent.value
        for batch in batches:
            lists = batch.column(4)
            own, back = np.unique(_codes(lists.flatten(), batch.column(5).flatten()), return_inverse=True)
            at = np.searchsorted(codes, own)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.concatenate([[0], np.cumsum(x[at][back], dtype=np.int64)]) for x in (best, n)]
            out = [np.diff(ends).astype(np.int64), *(np.diff(s[ends]) for s in sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, out)], names=[*keep, "n_links", "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return rows.select(*keep, "link_a", "link_b").mapInArrow(run, schema)


def _joined(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a shuffled join with a pair table of any size."""
    each = rows.select("row", F.explode(F.arrays_zip("link_a", "link_b")).alias("x")).select("row", F.col("x.link_a").alias("a"), F.col("x.link_b").alias("b"))
    each = each.groupBy("row", "a", "b").agg(F.count("*").alias("times")).join(pairs, ["a", "b"])
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    wide = rows.select("row", "doc_id", "n_a", "n_b", "groups_sha256", F.size("link_a").cast("long").alias("n_links"))
    return wide.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).drop("row")


def align_documents(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    rows = staged(align(docs, side_a, side_b).withColumn("row", F.monotonically_increasing_id()), "links")
    pairs = staged(pair_counts(rows), "pair-counts")
    # a row for each id of side B at most
    top = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("__top")))
    judged = pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("__top")).alias("best"))
    found = _looked_up(rows, judged) if pairs.count() <= most_pairs else _joined(rows, judged)
    # a group ends with its one link
    return found.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
