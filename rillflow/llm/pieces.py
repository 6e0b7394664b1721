"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position its output links name every piece that ends there, longest first, and
each relaxes the best score of the position: best[end] = max(best[end - length] + score). The longest piece wins ties.
A character that no single-character piece covers costs the least score less 10 and becomes its UTF-8 bytes' pieces, or
the unknown piece in a model without them. Pieces never reach across the start of a run of space marks (checked when
the model is read), so a text is the sequence of its marked words, and a word met before is taken from a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import chunks

MARK, UNKNOWN_PENALTY = "▁", 10.0
CACHE_WORDS, CACHE_CHARS = 300_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.odd = self.control | self.of_byte.keys()
        self.unknown = sp.unk_id()
        self.least = min(sp.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.single = {self.text[i] for i in plain if len(self.text[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.text[i], (len(self.text[i]), sp.get_score(i), i))
        self.automaton.make_automaton()
        across = any(re.search(f"[^{MARK}]{MARK}", self.text[i]) for i in plain)
        self.words = (lambda t: [t]) if across else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation of a text whose spaces are marks already."""
        n, low = len(text), float("-inf")
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        done = 0  # positions up to here are settled

        def settle(upto: int) -> None:  # characters without a piece of their own
            nonlocal done
            while done < upto:
                if text[done] not in self.single and best[done] + self.least > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + self.least, (1, 0.0, -1)
                done += 1

        every = self.single.issuperset(text)  # then each position is reached by a match, and nothing is left to settle
        for end, found in self.automaton.iter(text):
            if not every and done < end:
                settle(end)
            value = best[end + 1 - found[0]] + found[1]
            if value > best[end + 1]:
                best[end + 1], back[end + 1] = value, found
        if not every:
            settle(n)
        out, at = [], n
        while at:
            size, _, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in reversed(raw)] if self.byte else [self.unknown]
            at -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """A space is put first and spaces become marks; nothing else is changed. An empty text has no pieces."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for word in self.words(MARK + text.replace(" ", MARK)):
            ids = cache.get(word)
            if ids is None:
                ids = self.viterbi(word)
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text: bytes of byte pieces, control pieces left out, marks as spaces, without the first space."""
        of_byte, text, control = self.of_byte, self.text, self.control
        if self.odd.isdisjoint(ids):
            out = "".join(map(text.__getitem__, ids))
        else:
            raw = b"".join(bytes((of_byte[i],)) if i in of_byte else b"" if i in control else text[i].encode() for i in ids)
            out = raw.decode("utf-8", "replace")
        return out.replace(MARK, " ").removeprefix(" ")


_open: dict[str, Pieces] = {}


def opened(path: str) -> Pieces:
    """One automaton and cache per worker process."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, text_sha256 and decoded_sha256 (of the ids decoded again): a row per row of docs.

    Null text counts as empty: no pieces. The two digests differ only where a text has the space mark itself, which
    decodes to a space. Repeated rows give repeated results. A text of any length is encoded whole, word by word, in one task
    that holds it and its ids; ids of over 500 million pieces don't fit a value.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, ids array<int>, text_sha256 string, decoded_sha256 string"

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        pieces = opened(model or default_model())  # the default is found where the task runs
        for batch in chunks(batches, "text", 1 << 20):
            ids, plain, again = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = pieces.encode(text)
                ids.append(np.array(own, np.int32))
                plain.append(sha256(text.encode()).hexdigest())
                again.append(sha256(pieces.decode(own).encode()).hexdigest())
            sizes = np.array([len(x) for x in ids])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(plain), pa.array(again)], names=["doc_id", "n_pieces", "ids", "text_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows and a column text made from their ids; null ids give null."""
    schema = StructType([*rows.drop("text").schema.fields, StructField("text", StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = opened(model or default_model())  # the default is found where the task runs
        for batch in batches:
            text = pa.array([None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])

    return rows.drop("text").mapInArrow(run, schema)
