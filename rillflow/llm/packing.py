"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

A corpus of any size has at most `size` different piece lengths. The driver therefore sees one count per length and
runs best fit over counts: all pieces of a length go at once into the fullest bins that still take them. The result is
a plan of slots (length, ranks from..to, first sequence, offset). Each piece gets a rank within its length and takes
the slot that its (length, rank) points to, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, cut, partitions

SIZE, END_ID = 1024, 2
#: Bytes from here on begin characters past U+027F. Those texts go to `tokenizers`; the others to `tiktoken`, which
#: has the same vocabulary and splitting rule, gives the same ids for them and takes a quarter of the time.
FIRST_RARE_BYTE = 0xCA


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids of texts under the byte-level vocabulary of a tokenizer file.

    With escape, a special token's content in a text is read as plain text; without, as that token, as `tokenizers` does
    by default. Texts that hold the content of a token which is to be found go to `tokenizers`, whatever their bytes.
    """

    def __init__(self, path: str, escape: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = escape
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        added = self.exact.get_added_tokens_decoder().values()
        special = {t.content for t in added}
        self.found = [t.content for t in added if not (escape and t.special)]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        # fixed value: the vocabulary's public splitting pattern
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        raw = text.encode()
        if (raw.isascii() or max(raw) < FIRST_RARE_BYTE) and not any(t in text for t in self.found):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False, escape: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).

    A document is its ids and end_id; null text counts as empty. Longer ones than size are cut so that only the
    first piece is shorter than size. Repeated rows are packed as often as they occur. Other columns are ignored.
    escape is that of Ids. A text of any length is tokenized whole in one task, which holds its ids, and gives a row a piece.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encode, last, last_ids = Ids(tokenizer or default_tokenizer(), escape), None, None  # the default is found where the task runs
        for batch in chunks(batches, "text"):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text != last or last_ids is None:
                    last, last_ids = text, np.array([*encode(text or ""), end_id], dtype="<u4")
                ids, at, k = last_ids, 0, 0
                stop = (len(ids) - 1) % size + 1
                while at < len(ids):
                    raw = ids[at:stop].tobytes()
                    for column, value in zip(out, (doc_id, k, at, stop - at, zlib.crc32(raw), raw), strict=True):
                        column.append(value)
                    at, stop, k = stop, stop + size, k + 1
            types = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)][: 5 + keep_ids], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts by length. Rows: length, first rank, number of ranks, first sequence, offset.

    Bins of equal fill are one group (first sequence, number). Equal pieces fill a bin before the next is begun, as
    best fit does. The rows depend on the lengths and counts that occur, not on how many pieces there are.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in groups if r >= length), default=0)
            each = (room or size) // length
            if room:
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            else:
                room, first = size, sequences
                n = max(1, left // each)
                sequences += n
            used = min(n, left // each)
            if used < n:  # the rest of the group stays; a bin that is filled in part is used up alone
                part = left - used * each
                used, each, rest = (used, each, n - used) if used else (1, part, n - 1)
                if rest:
                    groups.setdefault(room, []).append((first + used, rest))
            for j in range(each):
                slots.append((length, rank, used, first, size - room + j * length))
                rank += used
            left -= used * each
            if room - each * length:
                groups.setdefault(room - each * length, []).append((first, used))
    return slots


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to piece rows. rows is read three times: cut its lineage first.

    The rank within a length has two steps, so that a length that most pieces share isn't ranked in one task:
    rows are dealt by hash into small buckets of a length, ranked there, and moved up by the buckets before.
    """
    spark = rows.sparkSession
    total = rows.count()
    buckets = max(1, min(1 << 20, total // 2000 + partitions(spark)))
    order = ["doc_id", "piece", "ids_crc32"]
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("_n")).collect()}  # a row per length: at most `size`
    slots = spark.createDataFrame(plan(counts, size), "length long, _rank0 long, _ranks long, _first long, offset long")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(base, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_own"))
    # the plan has a few rows per length, whatever the corpus: safe to broadcast
    met = ranked.join(F.broadcast(slots), "length").where("_rank >= _rank0 and _rank < _rank0 + _ranks")
    return met.select(*rows.columns, (F.col("_first") + F.col("_rank") - F.col("_rank0")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False, escape: bool = True) -> DataFrame:
    """pieces() and pack(): a row per piece with its place. An empty table gives no rows."""
    return pack(cut(pieces(docs, size, end_id, tokenizer, keep_ids, escape)), size)
