"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` code points. Every passage is
encoded from its characters and words; a layer h = tanh(W x + b) embeds it, and
a gate a = w . (tanh(V h) * sigmoid(U h)), soft-maxed over the bag, weighs it.
The document's score is the logistic of its weighted mean embedding. Only
document labels are known, so the gate learns which passages tell.

Training runs on the driver over a bounded sample of labelled rows: the first by
a hash, at most ``SAMPLE`` documents with ``PASSAGES`` passages in all, each
document with every passage; a document of over a twentieth of ``PASSAGES`` is
not sampled. Scoring reads every passage of every document in tasks, a block of
``BLOCK`` code points at a time; words and pairs of letters end with a passage.

Edge cases: a null or empty text is one empty passage; without labels of both
classes every score is the share of label 1, or 1/2 without labels; equal texts
get equal scores; other columns are ignored, and ``keep_good`` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import hash_unit, hashed_sample, staged, text_batches

PASSAGE, SAMPLE, PASSAGES = 600, 6000, 60_000
HIDDEN, GATE, EPOCHS, RATE, BATCH = 24, 12, 14, 0.01, 64
BINS = 32
#: Scores from here on are predicted 1.
THRESHOLD = 0.3
#: Code points encoded at once, a multiple of ``PASSAGE``.
BLOCK = 399_600

_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _SYMBOL, _STOP, _MARK = range(1, 9)


def _class_table() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = (
            _LINE if ch == "\n" else _BLANK if ch.isspace() else _UPPER if ch.isupper() else _LOWER if ch.isalpha()
            else _DIGIT if ch.isdigit() else _SYMBOL if ch in "#*$%&|<>" else _STOP if ch in ".!?" else _MARK
        )
    return table


_CLASSES = _class_table()
N_FEATURES = 16 + BINS


def _segments(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Groups of (text, part) of up to ``BLOCK`` code points; only a text that is longer is cut, between passages."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        for a in range(0, max(1, len(text)), BLOCK):
            part = text[a : a + BLOCK]
            if group and size + len(part) > BLOCK:
                yield group
                group, size = [], 0
            group.append((i, part))
            size += len(part)
    if group:
        yield group


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages per text), in the order of the texts."""
    out, n_bags, n_words = [], np.zeros(len(texts), np.int64), np.zeros(len(texts))
    seen: dict[int, list[np.ndarray]] = {}  # words and pairs of the text that the last group ended in
    for group in _segments(texts):
        owner = np.array([i for i, _ in group])
        last = owner[-1]
        features, bags, words, keys = _encode([part for _, part in group], seen.get(owner[0]))
        np.add.at(n_bags, owner, bags)
        np.add.at(n_words, np.repeat(owner, bags), words)
        seen = {last: keys}
        out.append(features)
    if not out:
        return np.zeros((0, N_FEATURES), np.float32), n_bags
    x = np.concatenate(out)
    x[:, 13] = np.log1p(np.repeat(n_words, n_bags))
    return x, n_bags


def _encode(parts: list[str], before: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(features, passages per part, words per passage, hashes of the last part's words and pairs).

    ``before`` holds the hashes of what stood earlier in the text of the first part.
    """
    cps = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in parts]
    size = np.array([len(c) for c in cps], np.int64)
    n_bags = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(n_bags) - n_bags
    n = int(n_bags.sum())
    c = np.concatenate([*cps, np.zeros(0, np.uint32)]).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), size)
    local = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    bag = first[part] + local // PASSAGE
    kind = np.where(c < len(_CLASSES), _CLASSES[np.minimum(c, len(_CLASSES) - 1)], _LOWER)
    share = np.bincount(bag * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float64)
    chars = np.maximum(1, share.sum(axis=1))

    out = np.zeros((n, N_FEATURES), np.float32)
    solid = (kind != _BLANK) & (kind != _LINE)
    inside = np.zeros(len(c), bool)  # solid, and so is the one before in the same passage
    inside[1:] = solid[1:] & solid[:-1] & (bag[1:] == bag[:-1])
    starts = np.nonzero(solid & ~inside)[0]
    words = np.bincount(bag[starts], minlength=n)
    keys = [np.zeros(0, np.uint64)] * 2
    if len(starts):
        # a hash of each word, and whether it, or the pair with the next, stood before in the text
        at = np.arange(starts[0], len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c))))
        power = (at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = np.where(solid[starts[0] :], (c[starts[0] :].astype(np.uint64) + np.uint64(77)) * power, np.uint64(0))
        word = np.add.reduceat(mixed, starts - starts[0]) * np.uint64(0xC2B2AE3D27D4EB4F)
        same = np.append(bag[starts[1:]] == bag[starts[:-1]], False)
        pair = word ^ np.where(same, np.append(word[1:], np.uint64(0)) * np.uint64(3), np.uint64(0))
        owner = part[starts]
        for j, key in enumerate((word, pair)):
            mine = np.nonzero(owner == len(parts) - 1)[0]
            salted = key + owner.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
            new = np.zeros(len(key), bool)
            new[np.unique(salted, return_index=True)[1]] = True
            if before is not None:
                new &= ~((owner == 0) & np.isin(key, before[j]))
            out[:, 9 + j] = np.bincount(bag[starts], weights=~new, minlength=n) / np.maximum(1, words)
            keys[j] = np.unique(key[mine])
    if before is not None and len(parts) == 1:
        keys = [np.union1d(a, b) for a, b in zip(keys, before, strict=True)]
    out[:, :9] = share / chars[:, None]
    inked = chars - share[:, _BLANK] - share[:, _LINE]
    out[:, 11] = np.minimum(20, inked / np.maximum(1, words)) / 5
    out[:, 12] = np.log1p(words)
    out[:, 14] = words == 0
    out[:, 15] = np.log1p(share[:, _STOP])
    if len(c):
        low = np.where((c >= 65) & (c <= 90), c + 32, c)
        both = (low[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low[1:].astype(np.uint64)) * np.uint64(
            0xD6E8FEB86659FD93
        )
        bins = (both >> np.uint64(59)).astype(np.int64)
        same = bag[1:] == bag[:-1]
        got = np.bincount((bag[:-1] * BINS + bins)[same], minlength=n * BINS).reshape(n, BINS)
        out[:, 16:] = np.sqrt(got / chars[:, None])
    return out, n_bags, words, keys


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` code points, or of one longer text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


class Attention:
    """The network; ``params`` are numpy arrays, so it ships to tasks as it is."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.params: list[np.ndarray] = []

    def _forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple:
        w, b, v, u, g, o, o0 = self.params
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ g
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, s, a, z, 1 / (1 + np.exp(-(z @ o + o0[0])))

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.params:
            return np.full(len(counts), self.prior)
        starts = np.cumsum(counts) - counts
        x = (x - self.mean) / self.scale
        return self._forward(x.astype(np.float64), starts, counts)[-1]

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 5) -> Attention:
        """Adam on the mean log loss, over batches of documents."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = ((x - self.mean) / self.scale).astype(np.float64)
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        d = x.shape[1]
        self.params = [
            draw(d, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN),
            np.array([np.log(self.prior / (1 - self.prior))]),
        ]
        first, second, step = [0.0] * 7, [0.0] * 7, 0
        start = np.cumsum(counts) - counts
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                docs = order[k : k + BATCH]
                rows = np.concatenate([np.arange(start[i], start[i] + counts[i]) for i in docs])
                grads = self._gradients(x[rows], counts[docs], y[docs])
                step += 1
                for i, gr in enumerate(grads):
                    gr = gr + 1e-4 * self.params[i]
                    first[i] = 0.9 * first[i] + 0.1 * gr
                    second[i] = 0.999 * second[i] + 0.001 * gr * gr
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    self.params[i] = self.params[i] - RATE * move
        return self

    def _gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, g, o, o0 = self.params
        starts = np.cumsum(counts) - counts
        h, t, s, a, z, p = self._forward(x, starts, counts)
        err = (p - y) / len(y)
        dz = np.repeat(err[:, None] * o, counts, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dts = de[:, None] * g
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ v.T + ds @ u.T
        dx = dh * (1 - h * h)
        return [x.T @ dx, dx.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ err, np.array([err.sum()])]


def fold(k: int) -> Column:
    """crc32 of the document's id, as text, modulo k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def train(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Attention:
    """Fit on the labelled documents that ``learn_from`` allows."""
    known = labels.where(F.col("quality").isNotNull()).where(learn_from)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = staged(hashed_sample(known, SAMPLE, "doc_id").select(F.col("doc_id").alias("__id"), "quality"), "picked")
    # at most SAMPLE ids, of each of which every different text counts once
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    bags_of = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / PASSAGE))
    sized = rows.select("__id", F.xxhash64("text").alias("__h"), bags_of.alias("bags")).where(F.col("bags") <= PASSAGES // 20)
    few = sized.distinct().orderBy(hash_unit("__id", "__h"), "__id").limit(SAMPLE).withColumn("u", hash_unit("__id", "__h"))
    upto = Window.orderBy("u", "__id").rowsBetween(Window.unboundedPreceding, 0)  # over SAMPLE narrow rows
    few = few.withColumn("upto", F.sum("bags").over(upto)).where(F.col("upto") <= PASSAGES).select("__id", "__h")
    few = staged(few, "few").join(picked, "__id").withColumnRenamed("__id", "__few")
    rows = text_batches(docs).select("doc_id", "text").join(F.broadcast(few), (F.col("doc_id") == F.col("__few")) & (F.xxhash64("text") == F.col("__h")))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i, j in _groups(texts):
                x, counts = encode(texts[i:j])
                out += [bag.tobytes() for bag in np.split(x, np.cumsum(counts)[:-1])]
            arrays = [b.column(0), pa.array(out, pa.binary()), b.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "x", "y"])

    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("double").alias("y"))
    got = rows.mapInArrow(bags, "doc_id long, x binary, y double").dropDuplicates(["doc_id", "x"]).toPandas()
    got = got.sort_values(["doc_id", "x"])
    y = got["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return Attention(float(y.mean()) if len(y) else 0.5)
    x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    return Attention(float(y.mean())).fit(np.concatenate(x), np.array([len(b) for b in x]), y)


def _score_texts(model: Attention, texts: list[str | None]) -> np.ndarray:
    out = [model.score(*encode(texts[i:j])) for i, j in _groups(texts)]
    return np.concatenate([np.zeros(0), *out])


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """(doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(_score_texts(model, b.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["doc_id", "score"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; a fifth of the ids is held out."""
    held = F.coalesce(fold(5) == 0, F.lit(False))
    out = score(docs, train(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted 1, with all their columns.

    Null and empty texts are scored as one empty passage, null and repeated ids row
    by row; without labels every score is 1/2 and all stay; an empty table stays empty.
    """
    model = train(docs, labels, ~F.coalesce(fold(5) == 0, F.lit(False)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_score_texts(model, b.column(at).to_pylist()) >= THRESHOLD))

    return text_batches(docs).mapInArrow(run, docs.schema)
