"""Toxicity by subword bags: embeddings of hashed character n-grams, averaged, under a linear softmax.

The bag is the n-grams of `SEGMENT` words in a row, with marks at word ends, so that a spelling never seen before still
meets vectors of its parts. Embeddings and softmax are trained together in numpy on a bounded sample of labelled texts:
first each segment learns its text's label; then a toxic text is its most toxic segment, and all segments of clean texts
are clean, so that one bad word in a long text isn't averaged away. A text scores as its highest segment.

Scoring needs one number a bucket, the embedding times the difference of the softmax's two rows, since averaging is
linear: 2**BITS floats, the same for any corpus, go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, cut

BITS, DIMENSIONS, SEGMENT, SHORTEST, LONGEST = 17, 12, 6, 3, 6
#: Labelled texts of a class that the fit may use, and the bytes of the longest of them.
SAMPLE, SAMPLE_BYTES, EPOCHS = 1200, 4096, 40
#: Bytes of text whose n-grams the fit makes and sums at a time.
FIT_BYTES = 1 << 17
THRESHOLD = 0.3

_draw = np.random.Generator(np.random.PCG64(11))
BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTORS = _draw.integers(0, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLAIN = np.full(256, 32, np.uint8)  # letters, digits and bytes of other alphabets; the rest parts words
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    PLAIN[_b] = _b
PLAIN[65:91] = np.arange(97, 123)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams in order of segment; where each segment begins there; the text of each segment."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    b = PLAIN[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    cuts = np.cumsum([1, *(len(r) + 1 for r in raw)])
    gap = b == 32
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, int), np.empty(0, int)
    first = np.searchsorted(starts, cuts)  # of each text, its first word
    text = np.repeat(np.arange(len(raw)), np.diff(first))
    nth = np.arange(len(starts)) - first[text]
    segment = np.cumsum(np.concatenate([[True], (nth[1:] % SEGMENT == 0)])) - 1
    at = np.cumsum(~gap & np.concatenate([[True], gap[:-1]])) - 1  # word that a byte is in, or comes after
    at = np.where(gap, at + 1, at)  # a gap goes with the next word: n-grams may begin with it
    rolled = BYTE[b] * FACTORS[0]
    buckets, owners = [], []
    inner = np.zeros(len(b), bool)  # a gap strictly inside
    for n in range(2, LONGEST + 1):
        size = len(b) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] + BYTE[b[n - 1 :]] * FACTORS[n - 1]
        if n > 2:
            inner = inner[:size] | gap[n - 2 : n - 2 + size]
        if n < SHORTEST:
            continue
        good = np.flatnonzero(~inner[:size])
        h = rolled[good]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(segment[at[good]])
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, int)
    of = np.empty(segment[-1] + 1, int)
    of[segment] = text
    return bucket, begins, of[owner[begins]]


def slices(texts: list[str], most: int = FIT_BYTES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """grams() of runs of whole texts of about `most` bytes, with 32-bit numbers, so that little is held beside the buckets."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text.encode("utf-8", "surrogatepass"))
        if size >= most or i == len(texts) - 1:
            bucket, begins, of = grams(texts[start : i + 1])
            if len(bucket):
                out.append((bucket, begins.astype(np.int32), (of + start).astype(np.int32)))
            start, size = i + 1, 0
    return out


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias). Both classes must occur, else all is 0 with a bias that says never or always.

    Each epoch sums the gradient over slices of whole texts. Held are 4 bytes an n-gram and the work of one slice: under
    300 MB for 2 * SAMPLE texts of SAMPLE_BYTES bytes.
    """
    y = np.asarray(toxic, float)
    parts = slices(texts) if len(y) and y.min() != y.max() else []
    if not parts:
        return np.zeros(1 << BITS, np.float32), (20.0 if len(y) and y.min() == 1 else -20.0)
    used = np.flatnonzero(sum(np.bincount(bucket, minlength=1 << BITS) for bucket, _, _ in parts))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    for bucket, _, _ in parts:
        bucket[:] = place[bucket]
    segments = [sum(int((y[of] == c).sum()) for _, _, of in parts) for c in (0, 1)]
    known = [sum(int((y[np.unique(of)] == c).sum()) for _, _, of in parts) for c in (0, 1)]
    draw = np.random.Generator(np.random.PCG64(3))
    embed = draw.normal(0, 0.1, (len(used), DIMENSIONS))
    soft = draw.normal(0, 0.5, (2, DIMENSIONS))
    bias = np.zeros(2)
    seen = [np.full_like(x, 1e-8) for x in (embed, soft, bias)]
    for epoch in range(epochs):
        value, each, pushed = embed @ (soft[1] - soft[0]), np.zeros(len(used)), 0.0
        for bucket, begins, of in parts:
            label, size = y[of], np.diff(np.append(begins, len(bucket)))
            logit = np.add.reduceat(value[bucket], begins) / size + bias[1] - bias[0]
            weight = np.where(label == 1, 0.5 / max(1, segments[1]), 0.5 / max(1, segments[0]))
            if epoch >= epochs // 4:  # from now on a toxic text stands by its highest segment
                heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                best = logit >= np.repeat(np.maximum.reduceat(logit, heads), np.diff(np.append(heads, len(of))))
                weight = np.where(label == 1, 0.0, weight * 0.5)
                weight[best & (label == 1)] = 0.5 / max(1, known[1])
                weight[best & (label == 0)] += 1.0 / max(1, known[0])
            slope = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
            each += np.bincount(bucket, np.repeat(slope / size, size), len(used))
            pushed += slope.sum()
        pull = each @ embed
        grads = each[:, None] * (soft[1] - soft[0])[None, :] + 1e-7 * embed, np.stack([-pull, pull]) + 1e-6 * soft, np.array([-pushed, pushed])
        for x, g, s in zip((embed, soft, bias), grads, seen, strict=True):
            s += g * g
            x -= 0.3 * g / np.sqrt(s)
    out = np.zeros(1 << BITS, np.float32)
    out[used] = embed @ (soft[1] - soft[0])
    return out, float(bias[1] - bias[0])


def scores(texts: list[str | None], value: np.ndarray, bias: float) -> np.ndarray:
    """The highest segment's chance of being toxic; 0 for a text without words."""
    out = np.zeros(len(texts))
    bucket, begins, of = grams(texts)
    if len(begins):
        size = np.diff(np.append(begins, len(bucket)))
        logit = np.add.reduceat(value[bucket].astype(float), begins) / size + bias
        np.maximum.at(out, of, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return out


def held_out(doc_id: str = "doc_id"):
    """False for a null doc_id, which no label can name."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Fit on at most `sample` labelled documents of each class, of at most sample_bytes bytes, none held out.

    Which ones is decided by a hash of doc_id, among those that are short enough. Rows with a null id or label teach
    nothing; of several labels of an id the highest counts, and of several texts the least.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.octet_length("text") <= sample_bytes)
    able = short.select("doc_id").join(known.where("toxic in (0, 1)"), "doc_id").select("doc_id", "toxic", F.xxhash64("doc_id", F.lit("toxicity")).alias("_draw")).distinct()
    able = cut(able)  # ids alone
    drawn = [able.where(F.col("toxic") == y).orderBy("_draw", "doc_id").limit(sample).select("doc_id", "toxic") for y in (0, 1)]  # each task keeps `sample` rows
    chosen = drawn[0].union(drawn[1])  # 2 * sample ids: safe to broadcast
    rows = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: (r.toxic, r.doc_id))
    return fit([r.text for r in found], [int(r.toxic) for r in found])


def score(docs: DataFrame, value: np.ndarray, bias: float) -> DataFrame:
    """doc_id, row (the whole input row) and toxic_score, over whole texts; null text counts as empty and scores 0.

    A text of any length is scored whole, segment by segment, in one task, whose arrays of n-grams are several times its size.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((value, bias))  # as large for any corpus
    out = docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text")
    schema = StructType([*out.drop("text").schema.fields, StructField("toxic_score", DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, "text", 1 << 20):
            got = scores(batch.column("text").to_pylist(), *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(got, pa.float64())], names=["doc_id", "row", "toxic_score"])

    return out.mapInArrow(run, schema)
