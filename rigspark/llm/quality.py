"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import texts_of

#: A filter spans 8 bytes and is applied at every second byte; a chunk is 256 such places (518
#: bytes), and chunks overlap by 32 of them.
SPAN, STRIDE, CHUNK, STEP = 8, 2, 256, 224
DEPTH, FILTERS, HIDDEN = 8, 32, 16
#: The labelled rows that training uses: at most so many of each class, and of these, in the order of
#: a hash of the id, as many as have so many bytes of text together.  Each is read whole.
TRAIN_DOCS, TRAIN_BYTES = 1500, 64 << 20


def chunk_starts(places: int) -> np.ndarray:
    """Where the chunks of a text begin: at equal steps, the last one at the text's end."""
    if places <= CHUNK:
        return np.zeros(1, np.int64)
    return np.unique(np.r_[np.arange(0, places - CHUNK, STEP), places - CHUNK])


def chunk_runs(places: int) -> list[np.ndarray]:
    """The chunks of a text in runs of 64, which bounds what is held of a long one."""
    starts = chunk_starts(places)
    return [starts[at : at + 64] for at in range(0, len(starts), 64)]


def byte_pairs(data: np.ndarray) -> np.ndarray:
    """Pairs of bytes at even places; a text shorter than a filter is filled up with zeros."""
    n = max(len(data), SPAN)
    out = np.zeros(n + n % 2, np.uint8)
    out[: len(data)] = data
    return out[0::2].astype(np.int32) * 256 + out[1::2]


@dataclass
class QualityModel:
    """Byte vectors, filters and the two layers that turn pooled responses into a probability."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fresh(seed: int) -> QualityModel:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return QualityModel(draw(0.5, 256, DEPTH), draw(0.25, SPAN, DEPTH, FILTERS), np.zeros(FILTERS, np.float32), draw(0.2, 3 * FILTERS + 1, HIDDEN), np.zeros(HIDDEN, np.float32), draw(0.3, HIDDEN), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pair_table(self) -> np.ndarray:
        """Responses of all filters to each pair of bytes at each of the four places in a filter."""
        one = np.einsum("bd,kdf->kbf", self.embed, self.filters)
        table = one[0::2, :, None, :] + one[1::2, None, :, :]
        return np.ascontiguousarray(table.transpose(1, 2, 0, 3).reshape(1 << 16, SPAN // 2 * FILTERS))

    def responses(self, pairs: np.ndarray, table: np.ndarray) -> np.ndarray:
        got, f = table[pairs], FILTERS
        m = len(pairs) - SPAN // 2 + 1
        out = got[:m, :f].copy()
        for j in range(1, SPAN // 2):
            out += got[j : j + m, j * f : (j + 1) * f]
        return out

    def pooled(self, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, int]:
        """Mean, least and largest of the chunks' pooled responses; long texts go in pieces."""
        pairs = byte_pairs(data)
        places = len(pairs) - SPAN // 2 + 1
        runs, tops = chunk_runs(places), []
        for part in runs:
            first, last = int(part[0]), min(int(part[-1]) + CHUNK, places)
            got = self.responses(pairs[first : last + SPAN // 2 - 1], table)
            got = np.concatenate([got, np.full((1, FILTERS), -np.inf, np.float32)])
            bounds = np.minimum(np.stack([part, part + CHUNK], 1).ravel() - first, len(got) - 1)
            tops.append(np.maximum.reduceat(got, bounds, axis=0)[::2])
        act = np.tanh(np.concatenate(tops) + self.bias)
        return np.concatenate([act.mean(0), act.min(0), act.max(0), [np.log2(min(places, CHUNK)) / 8]]).astype(np.float32), sum(map(len, runs))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 6, steps: int = 300, batch: int = 96, rate: float = 4e-3) -> QualityModel:
    """Fit by Adam on all chunks of labelled documents; both classes are drawn equally often."""
    rng, model = np.random.default_rng(seed), QualityModel.fresh(seed)
    pairs = [byte_pairs(np.frombuffer(t, np.uint8)) for t in texts]
    pools = [np.flatnonzero(labels == k) for k in (0, 1)]
    first, second = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()]
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(p, batch // 2) for p in pools])
        y, table = labels[docs].astype(np.float32), model.pair_table()
        tops, where, owner = [], [], []
        for i, d in enumerate(docs):
            p = pairs[d]
            flat = np.stack([p // 256, p % 256], 1).ravel().astype(np.uint8)
            for starts in chunk_runs(len(p) - SPAN // 2 + 1):
                low, high = int(starts[0]), int(starts[-1]) + CHUNK
                got = model.responses(p[low : high + SPAN // 2 - 1], table)
                for s in starts - low:
                    at = got[s : s + CHUNK].argmax(0)
                    tops.append(got[s + at, np.arange(FILTERS)])
                    where.append(flat[((low + s + at)[:, None] * STRIDE) + np.arange(SPAN)])
                    owner.append(i)
        sizes = np.array([np.log2(min(len(pairs[d]) - SPAN // 2 + 1, CHUNK)) / 8 for d in docs], np.float32)
        act, owner = np.tanh(np.array(tops) + model.bias), np.array(owner)
        begin = np.searchsorted(owner, np.arange(len(docs)))
        count = np.bincount(owner, minlength=len(docs))[:, None].astype(np.float32)
        low, high = np.minimum.reduceat(act, begin), np.maximum.reduceat(act, begin)
        x = np.concatenate([np.add.reduceat(act, begin) / count, low, high, sizes[:, None]], 1)
        hidden = np.tanh(x @ model.w1 + model.b1)
        z = hidden @ model.w2 + model.b2[0]
        dz = (1 / (1 + np.exp(-z)) - y) / len(docs)
        dh = dz[:, None] * model.w2 * (1 - hidden**2)
        dx = dh @ model.w1.T
        f = FILTERS
        da = dx[owner, :f] / count[owner] + dx[owner, f : 2 * f] * (act == low[owner]) + dx[owner, 2 * f : 3 * f] * (act == high[owner])
        da *= 1 - act**2
        bytes_at = np.array(where)
        de, df = np.zeros_like(model.embed), np.zeros_like(model.filters)
        for k in range(SPAN):
            index = (bytes_at[:, :, k].astype(np.int64) * f + np.arange(f)).ravel()
            ds = np.bincount(index, da.ravel(), 256 * f).reshape(256, f).astype(np.float32)
            de += ds @ model.filters[k].T
            df[k] = model.embed.T @ ds
        grads = [de, df, da.sum(0), x.T @ dh + 1e-4 * model.w1, dh.sum(0), hidden.T @ dz, dz.sum(keepdims=True)]
        for p, g, m, v in zip(model.params(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: the id's CRC-32, as text, leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 6) -> QualityModel | None:
    """Learn from at most ``TRAIN_DOCS`` labelled documents of each class, chosen by a hash of the id.

    They are read whole; their texts come to the driver, ``TRAIN_BYTES`` at most, so a document
    that would go beyond this is not among those learnt from.  Held-out rows, null ids and labels
    other than 0 and 1 are left out, as are empty texts; of repeated ids one row counts.  Without
    documents of both classes there is no model (None).  Other columns are not looked at.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    order, picked = (F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")), None
    for k in (0, 1):
        part = own.where(F.col("label") == k).orderBy(*order).limit(TRAIN_DOCS)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("length(text) > 0")
    picked = F.broadcast(picked.groupBy("doc_id").agg(F.min("label").alias("label")))
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(picked, "doc_id").groupBy("doc_id", "label").agg(F.max("bytes").alias("bytes"))
    within = sizes.withColumn("sum", F.sum("bytes").over(Window.orderBy(*order))).where(F.col("sum") <= TRAIN_BYTES).select("doc_id", "label")
    got = rows.join(F.broadcast(within), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("r")).collect()
    got = sorted(got, key=lambda r: r.doc_id)
    y = np.array([r.r.label for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return train([r.r.text.encode() for r in got], y, seed)


def _scores(batch: pa.RecordBatch, column: str, model: QualityModel | None, table: np.ndarray | None) -> np.ndarray:
    if model is None:
        return np.full(len(batch), 0.5)
    x = np.zeros((len(batch), 3 * FILTERS + 1), np.float32)
    for first, data, offsets in texts_of(batch.column(batch.schema.get_field_index(column))):
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            x[first + i] = model.pooled(data[a:b], table)[0]
    return model.probability(x)


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: the probability of label 1, over the bytes of every whole text.

    Null and empty texts are scored as one chunk of zero bytes.  Without a model all score 0.5.
    Each input row has its own result, whatever its id; equal texts score alike.  An empty table
    gives an empty result; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.pair_table() if model else None
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(_scores(batch, "text", model, table))})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns, whatever their names.

    Rows are judged as in :func:`score_quality`, each by itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.pair_table() if model else None
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, names[at], model, table) >= threshold))

    # mapInArrow takes a dot in a name for a field's: columns go by their places.
    held, at = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns.index(text_col)
    names = held.columns
    return held.mapInArrow(run, held.schema).toDF(*docs.columns)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, with whether its label was held out and the decision at 0.5."""
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
