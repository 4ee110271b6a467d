"""Token counts of every prefix, by dynamic programming over a BPE vocabulary.

A piece sequence is the encoding of a text exactly if each piece, and each two
neighbours, are encoded as themselves. So the last piece of a prefix is the one
piece that ends there, encodes as itself, and stands well after the last piece
of what is before it; its count is one more than there. This takes one look back
over at most the longest piece per character, and gives the exact count of
*every* prefix.

No piece of the vocabulary holds a blank after another character, so texts are
cut before such blanks into words with their leading blanks, whose counts add up.
Tasks remember the steps of words they have met.

``prefix_table`` keeps the counts: one signed byte a character, the step from
the count of the prefix before, in blocks of ``BLOCK`` characters with the count
at their start. ``tokens_of_prefixes`` and ``longest_prefixes`` answer truncation
and budget questions from one block, without encoding again.

Edge cases: null texts are empty, an empty text has no token; control strings
such as ``</s>`` in a text are ordinary text; characters outside the vocabulary
count as their bytes; equal rows are counted each; empty tables give no rows;
other columns are ignored. A vocabulary in which pieces hold inner blanks, or a
normaliser that changes characters, is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import text_batches

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Characters in a row of the prefix table.
BLOCK = 1 << 16
#: Words that a task remembers the steps of, and the longest one.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Neighbours that a task remembers.
CACHE_PAIRS = 2_000_000
#: Characters of texts cut into words at a time.
SOME_CHARS = 2_000_000

BLANK = "▁"
#: A character that is in no vocabulary, which keeps what follows apart from the leading blank.
APART = "\ue000"
#: Marks that may end a word.
MARKS = ".,!?;:#&$%*|\n"
_BLANKS = re.compile(" *[^ ]+| +")
#: Characters that a normaliser would touch.
_PROBES = ["a", "  a  b ", "ﬁ", "Ａ", " x", "a\tb\nc", "é", "가"]


def _pieces(text: str) -> list[str]:
    """A text cut before each blank that follows another character; the blank itself is left out.
    The vocabulary's sign for a blank is one."""
    if not text:
        return []
    text = text.replace(BLANK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [p[1:] for p in _BLANKS.findall(" " + text)]
    return text.split(" ")


class Prefixes(dict):
    """Steps, as signed bytes, of pieces of text: the count at each character of a blank and the piece, less the one before it."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        for probe in _PROBES:
            if model.decode(model.encode(probe)) != probe:
                raise ValueError("the normaliser of this vocabulary changes texts")
        special = {i for i in range(len(names)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        plain = [i for i in range(len(names)) if i not in special]
        if any(BLANK in names[i].lstrip(BLANK) for i in plain) or any(APART in names[i] for i in plain):
            raise ValueError("pieces of this vocabulary reach over blanks")
        # pieces that merges never reach are not met in any encoding
        alone = model.encode([APART + names[i] for i in plain])
        head = model.encode(APART)
        self.head = len(head)
        self.pieces = {names[i]: i for i, ids in zip(plain, alone, strict=True) if ids == [*head, i]}
        self.names = names
        # every ending of a piece: the piece that it is, or -1
        self.ended = {name[i:]: -1 for name in self.pieces for i in range(1, len(name))} | self.pieces
        self.neighbours: dict[int, bool] = {}
        # marks that no piece holds after a letter begin a word of their own
        after = {b for name in self.pieces for a, b in zip(name, name[1:], strict=False) if a.isalpha()}
        marks = "".join(re.escape(c) for c in MARKS if c not in after)
        self.words = re.compile(f"{BLANK}*[^\\W\\d_]+(?=[{marks}])|{BLANK}*[^{BLANK}]+?(?<=[^\\W\\d_])(?=[{marks}])|{BLANK}*[^{BLANK}]+|{BLANK}+" if marks else f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def stand(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are next to each other."""
        known = self.model.encode(APART + self.names[left] + self.names[right])[self.head :] == [left, right]
        if len(self.neighbours) >= CACHE_PAIRS:
            self.neighbours.clear()
        self.neighbours[left << 32 | right] = known
        return known

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The steps of words. In sorted order a word begins as the one before it did, and shares its states."""
        out = {}
        ended, known = self.ended, self.neighbours
        before, counts, last = "", [0], [-1]  # last piece of each prefix; -1: nothing that a piece could merge with
        for word in sorted(words):
            same = len(commonprefix((before, word)))
            del counts[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                start = end - 1
                while start >= 0:
                    piece = ended.get(word[start:end])
                    if piece is None:
                        start = -1
                        break
                    if piece >= 0:
                        left = last[start]
                        stands = left < 0 or known.get(left << 32 | piece)
                        if stands or stands is None and self.stand(left, piece):
                            break
                    start -= 1
                if start < 0:  # a character outside the vocabulary is its bytes, and merges with nothing
                    counts.append(counts[-1] + len(word[end - 1].encode()))
                    last.append(-1)
                else:
                    counts.append(counts[start] + 1)
                    last.append(piece)
            out[word] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])
            before = word
        return out

    def steps(self, texts: list[str]) -> list[bytes]:
        """The steps of texts: one a character. The blank put before a text belongs to its first character."""
        pieces = [_pieces(t) for t in texts]
        needed = set().union(*pieces)
        missing = [p for p in needed if p not in self]
        if len(self) + len(missing) > CACHE_WORDS:
            self.clear()
            missing = list(needed)
        words = [self.words.findall(BLANK + p.replace(" ", BLANK)) for p in missing]
        found = self.learn(set().union(*words))
        self.update((p, b"".join([found[w] for w in own])) for p, own in zip(missing, words, strict=True))
        out = []
        for own in pieces:
            steps = b"".join(map(self.__getitem__, own))
            first = np.frombuffer(steps[:2], np.int8).sum(dtype=np.int8)
            out.append(first.tobytes() + steps[2:] if own else b"")
        for p in missing:
            if len(p) > CACHE_CHARS:
                del self[p]
        return out

    def batches(self, texts: pa.Array) -> Iterator[bytes]:
        """The steps of each text of an Arrow array, some ``SOME_CHARS`` characters of texts at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size >= SOME_CHARS:
                yield from self.steps(held)
                held, size = [], 0
        yield from self.steps(held)


_loaded: dict[str, Prefixes] = {}


def _prefixes(path: str) -> Prefixes:
    """One table per worker process and file, kept for its next tasks."""
    if path not in _loaded:
        _loaded[path] = Prefixes(path)
    return _loaded[path]


def _total(steps: bytes) -> int:
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): the count of the last prefix of each text."""
    path = public_tokenizers.path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _prefixes(path)
        for b in batches:
            n = pa.array(map(_total, prefixes.batches(b.column(2))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = text_batches(docs).select(F.col("doc_id").cast("long"), size, "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, block, start, before, n_chars, steps) of each text: from character ``start`` on, after which
    ``before`` tokens are counted, one step a character. An empty text has one empty block."""
    path = public_tokenizers.path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _prefixes(path)
        for b in batches:
            rows = []
            for doc_id, steps in zip(b.column(0).to_pylist(), prefixes.batches(b.column(1)), strict=True):
                before = 0
                for block, start in enumerate(range(0, max(1, len(steps)), BLOCK)):
                    part = steps[start : start + BLOCK]
                    rows.append((doc_id, block, start, before, len(part), part))
                    before += _total(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "block", "start", "before", "n_chars", "steps"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, block int, start long, before long, n_chars int, steps binary")


def _answer(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, asked, chars, tokens) from blocks with the column ``asked``: the count of that many characters,
    or the longest prefix of the block within that many tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, tokens = [], []
            for asked, start, before, steps in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                counts = before + np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])
                if kind == "prefix":
                    at = min(asked - start, len(steps))
                else:
                    within = np.nonzero(counts <= asked)[0]
                    at = int(within[-1]) if len(within) else None
                chars.append(None if at is None else start + at)
                tokens.append(None if at is None else int(counts[at]))
            cols = [b.column(0), b.column(1), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "asked", "chars", "tokens"])

    return text_batches(rows).select("doc_id", "asked", "start", "before", "steps").mapInArrow(run, "doc_id long, asked long, chars long, tokens long")


def tokens_of_prefixes(table: DataFrame, chars: int | Column) -> DataFrame:
    """(doc_id, asked, chars, tokens): what the first ``chars`` characters of each text count; the whole text if it
    is shorter. Reads the one block that holds the prefix's end."""
    asked = F.greatest(F.lit(chars) if isinstance(chars, int) else chars, F.lit(0)).cast("long")
    last = F.col("n_chars") < BLOCK  # ends the text, unless a full block does
    here = (asked >= F.col("start")) & ((asked < F.col("start") + BLOCK) | last)
    rows = table.withColumn("asked", asked).where(here)
    found = _answer(rows, "prefix")
    # a text of whole blocks ends in a full one: longer prefixes are answered by its last block
    full = table.withColumn("asked", asked).where((F.col("n_chars") == BLOCK) & (asked >= F.col("start") + BLOCK))
    ends = _answer(full, "prefix").groupBy("doc_id", "asked").agg(F.max_by("tokens", "chars").alias("tokens"), F.max("chars").alias("chars"))
    ends = ends.join(found.select("doc_id"), "doc_id", "left_anti").select("doc_id", "asked", "chars", "tokens")
    return found.unionByName(ends)


def longest_prefixes(table: DataFrame, budget: int | Column) -> DataFrame:
    """(doc_id, asked, chars, tokens): the longest prefix of each text that counts at most ``budget`` tokens.

    A later block may hold a prefix only if the count at its start is near the budget:
    a prefix that is longer by one character counts at most the longest piece less.
    """
    asked = F.greatest(F.lit(budget) if isinstance(budget, int) else budget, F.lit(0)).cast("long")
    rows = table.withColumn("asked", asked).where(F.col("before") <= asked + 4 * 127)
    found = _answer(rows, "budget").where("chars IS NOT NULL")
    return found.groupBy("doc_id", "asked").agg(F.max("chars").alias("chars"), F.max_by("tokens", "chars").alias("tokens"))
