"""Best-fit packing of tokenised documents into sequences of fixed length.

Texts become token ids and one end id; documents over the capacity are cut
into full pieces and a rest. Packing is bulk-synchronous best fit:

1. Pieces are range-sorted by length over all tasks and ranked inside their
   length; gaps (the free ends of sequences) are a table, each gap with a rank
   inside its size. Both have at most ``capacity`` sizes, so the counts by size
   are small, however many rows there are.
2. A superstep takes the lengths from the longest left down to half of it. A
   sweep over the counts finds for each length its successors: the tightest
   gaps that hold it, each taking as many equal pieces as fit. A gap is given
   away once in a superstep.
3. All tasks then resolve the bids at the same time, by rank alone: the i-th gap
   of a size serves the pieces from rank first + i * take on. No row moves.
4. Gaps given away shrink and get the next ranks of their new size. New
   sequences are opened when the gaps cannot hold what is left by a lower
   bound, and the next superstep begins. There are some ten to twenty.
5. Placements meet the ranked pieces by (length, rank).

Edge cases: null and empty texts are one piece, the end id alone; equal rows
are packed as often as they occur; an empty table gives no rows; other columns
are ignored; special tokens in a text get their own ids, as by the tokenizer.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm.common import ranked, staged, text_batches

CAPACITY, END_ID = 2048, 0
#: New sequences written by one task.
OPENED_PER_TASK = 1_000_000
#: Words that each of two generations remembers the ids of, and the longest one.
CACHE_WORDS, CACHE_CHARS = 100_000, 64
#: Bytes of texts cut into words at a time.
SOME_BYTES = 1 << 20

#: Latin-1 letters, and marks of which a run is one pre-token.
_LETTERS = "".join(c for c in map(chr, range(256)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
_MARKS = ".,!?;:|#$%&*"


class WordIds:
    """Ids, as bytes of little-endian uint32, of texts.

    The tokenizer never joins across white space, so a text's ids are those of
    its words in a row; Arrow cuts and counts the words. Letters in lower case
    and marks behind them skip its normaliser and splitter, which would leave
    them as they are; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and on
        own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        byte_char = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.mapped = {c: "".join(byte_char[b] for b in chr(c).encode()) for c in range(256)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, word: str, plain: bool) -> bytes:
        if plain:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.mapped))]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, words: pa.Array, plain: pa.Array) -> pa.Array:
        """Ids of words, which are met again in the young generation."""
        words, plain = (x.to_numpy(False).tolist() for x in (words, plain))
        out = list(map(self.young.get, words))
        for i, word in enumerate(words):
            if out[i] is not None:
                continue
            ids = self.old.get(word)
            out[i] = ids = self._encoded(word, plain[i]) if ids is None else ids
            if len(word) <= CACHE_CHARS:
                if len(self.young) >= CACHE_WORDS:
                    self.young, self.old = {}, self.young
                self.young[word] = ids
        return pa.array(out, pa.large_binary())

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of different words: those of the letters, then those of the marks."""
        marks = pc.utf8_ltrim(words, _LETTERS)
        plain = pc.equal(pc.utf8_rtrim(marks, _MARKS), "")
        marks = pc.if_else(plain, marks, "").dictionary_encode()
        # other words hold more than letters, so no two kinds are equal
        stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, _MARKS)), words).dictionary_encode()
        letters = pc.equal(pc.utf8_ltrim(stems.dictionary, _LETTERS), "")
        first = self._known(stems.dictionary, letters).take(stems.indices)
        then = pa.array([self._encoded(m, True) for m in marks.dictionary.to_pylist()], pa.large_binary())
        return pc.binary_join_element_wise(first, then.take(marks.indices), pa.scalar(b"", pa.large_binary()))

    def of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow array, some ``SOME_BYTES`` of texts at a time."""
        texts = texts.fill_null("")
        parts = np.cumsum(pc.binary_length(texts).to_numpy(False), dtype=np.int64) // SOME_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            lists = pc.ascii_split_whitespace(texts[lo:hi])
            words = lists.flatten().dictionary_encode()
            ids = self._of_words(words.dictionary).take(words.indices)
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(False), dtype=np.int64)])
            ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(False), dtype=np.int64)])].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            for start, end in zip(ends, ends[1:], strict=False):
                yield bytes(data[start:end])

    def ids(self, text: str) -> bytes:
        return next(self.of_texts(pa.array([text], pa.string())))


_loaded: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One table per worker process and file, kept for its next tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def token_pieces(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the pieces of each document.

    ``ids`` is an array of ints, left out on request.
    """
    path = public_tokenizers.path(tokenizer)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(b.column(0).to_pylist(), words.of_texts(b.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for col, x in zip(cols, row, strict=False):
                        col.append(x)
                    if with_ids:
                        cols[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(cols[: 5 + with_ids], kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Flow:
    """Gaps of ranks [lo, hi) of one size take ``take`` pieces of ``length`` each, from rank ``first``
    on, and become gaps of size ``left`` from rank ``base`` on. ``take`` 0 leaves them as they are."""

    gap: int
    lo: int
    hi: int
    length: int
    first: int
    take: int
    left: int
    base: int


def sweep(lengths: dict[int, int], placed: dict[int, int], gaps: dict[int, int]) -> tuple[list[Flow], dict[int, int]]:
    """The flows of one superstep, and the gaps after it.

    ``lengths`` counts all pieces by length and ``placed`` those that have a place, ``gaps`` the
    gaps by size. Lengths go downwards; each sweeps the gaps from its successor upwards.
    """
    left = {n: lengths[n] - placed.get(n, 0) for n in lengths}
    todo = sorted((n for n in left if left[n]), reverse=True)
    sizes, used = sorted(g for g in gaps if gaps[g]), dict.fromkeys(gaps, 0)
    bids: list[tuple[int, int, int, int, int, int]] = []
    for n in todo:
        if 2 * n < todo[0]:
            break
        while left[n]:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                break
            g = sizes[i]
            take = min(g // n, left[n])
            many = min(gaps[g] - used[g], left[n] // take)
            bids.append((g, used[g], used[g] + many, n, lengths[n] - left[n], take))
            used[g] += many
            left[n] -= many * take
            if used[g] == gaps[g]:
                sizes.pop(i)
    after = {g: gaps[g] - used[g] for g in gaps}
    flows = [Flow(g, used[g], gaps[g], 0, 0, 0, g, 0) for g in gaps if after[g]]
    for g, lo, hi, n, first, take in bids:
        rest = g - n * take
        flows.append(Flow(g, lo, hi, n, first, take, rest, after.get(rest, 0)))
        after[rest] = after.get(rest, 0) + hi - lo
        placed[n] = first + (hi - lo) * take
    return flows, {g: k for g, k in after.items() if g and k}


def to_open(lengths: dict[int, int], placed: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many sequences any packing of the rest must open, by room and by what fits no gap."""
    left = {n: k - placed.get(n, 0) for n, k in lengths.items() if k > placed.get(n, 0)}
    room = sum(n * k for n, k in left.items()) - sum(g * k for g, k in gaps.items())
    largest = max(gaps, default=0)
    over = {n: k for n, k in left.items() if n > largest}
    alone = sum(k for n, k in over.items() if 2 * n > capacity)
    return max(0, -(-room // capacity), -(-sum(n * k for n, k in over.items()) // capacity), alone)


def _superstep(gaps: DataFrame, flows: list[Flow], capacity: int) -> DataFrame:
    """Each gap (sequence_id, gap, rank) after the flows, with what it took (length, first, take, offset)."""
    flows = sorted(flows, key=lambda f: (f.gap, f.lo))
    table = np.array([(f.gap, f.lo, f.length, f.first, f.take, f.left, f.base) for f in flows], np.int64).T
    names = ["sequence_id", "gap", "rank", "length", "first", "take", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, lo, length, first, take, left, base = table
        key = gap << 48 | lo  # ranks stay far below 2 ** 48
        for b in batches:
            own, rank = (b.column(i).to_numpy() for i in (1, 2))
            at = np.searchsorted(key, own << 48 | rank, side="right") - 1
            i = rank - lo[at]
            rows = (b.column(0), left[at], base[at] + i, length[at], first[at] + i * take[at], take[at], capacity - own)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=names)

    return gaps.select(*names[:3]).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = staged(pieces.select(*names), "pieces").withColumn("__row", F.monotonically_increasing_id())
    # at most ``capacity`` rows
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    opened, placed, gaps = 0, {}, {}
    table = spark.range(0).select(F.col("id").alias("sequence_id"), F.col("id").alias("gap"), F.col("id").alias("rank"))
    log = []
    while sum(placed.values()) < sum(lengths.values()):
        fresh = to_open(lengths, placed, gaps, capacity)
        if fresh:
            known = gaps.get(capacity, 0)
            new = spark.range(opened, opened + fresh, 1, 1 + fresh // OPENED_PER_TASK)
            new = new.select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"), (F.col("id") - opened + known).alias("rank"))
            table = table.unionByName(new) if gaps else new
            gaps[capacity] = known + fresh
            opened += fresh
        flows, gaps = sweep(lengths, placed, gaps)
        step = staged(_superstep(table, flows, capacity), "superstep")
        log.append(step.where("take > 0").select("sequence_id", "offset", "length", "first", "take"))
        table = step.where("gap > 0").select("sequence_id", "gap", "rank")
    if not log:
        return pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ordered = ranked(pieces, [F.desc("length"), F.col("__row")], "__rank")
    # ranks start anew in each length
    longer = dict(zip(sorted(lengths, reverse=True), np.cumsum([0, *(lengths[n] for n in sorted(lengths, reverse=True))]).tolist(), strict=False))
    starts = spark.createDataFrame(list(longer.items()), "length long, __start long")
    ordered = ordered.join(F.broadcast(starts), "length").withColumn("__rank", F.col("__rank") - F.col("__start"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("k")
    places = reduce(DataFrame.unionByName, log).select("sequence_id", "offset", "length", "first", each)
    places = places.select(
        "sequence_id", (F.col("offset") + F.col("k") * F.col("length")).alias("offset"), "length", (F.col("first") + F.col("k")).alias("__rank")
    )
    return ordered.join(places, ["length", "__rank"]).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(token_pieces(docs, tokenizer, capacity, with_ids=False), capacity)


def sequences(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves.

    A sequence has at most ``capacity`` pieces, so its group is small.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity), "tokens")
    # repeated rows have equal pieces: any one of them stands for the others
    ids = pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "ids_crc32", "ids")
    placed = pack(pieces, capacity)
    on = [placed[c].eqNullSafe(ids[c]) for c in ("doc_id", "piece", "ids_crc32")]
    parts = placed.join(ids, on).select("sequence_id", "offset", "ids")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
