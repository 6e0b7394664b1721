"""Chat formatting: each assistant turn becomes an example with all turns before it as context, and only its reply trained.

A conversation is formatted once, turn by turn, as pieces; the pieces in order are its text. expanded() explodes each
assistant piece into the piece and an example: a row of its own that names the pieces of its context (from, until, and their
characters), its reply, and what of the example's text is trained. Context is kept by reference, so rows and characters grow with
the turns. read_back() follows the example rows: it takes the trained text from an example's mask, and checks that the
context it names is whole and that a turn ends behind the reply. rendered() writes examples out in full, one after the
other; those characters grow with the square of a conversation's turns.

Inside texts a backslash stands before a backslash or a "<" that begins a control string, so control strings mark turns only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES

# fixed values: the template's control strings
OPEN, MIDDLE, CLOSE = "<turn ", "> ", "</turn>\n"


def escape(text):
    """Reversible: every backslash and every "<" of a text gets a backslash before it."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, ord, piece, start (code points before it), reply (the piece's code points that are trained: from, to; null for
    others) and example (0, 1, ... for assistant turns, else null): a row per turn.

    Turns go by `turn`, then role and text (repeated rows stay); a null conv_id is a conversation of its own, a null role or
    text is empty. Only the role "assistant" is trained.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(">"), F.lit("\\>")), F.lit(MIDDLE))
    rows = turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "body", F.lit(CLOSE))
    trained = F.col("role") == "assistant"
    at = F.coalesce(F.sum(F.length(piece).cast("long")).over(before), F.lit(0))
    reply = F.when(trained, F.struct(F.length("head").alias("from"), (F.length("head") + F.length("body")).alias("to")))
    return rows.select(
        "conv_id", (F.row_number().over(order) - 1).alias("ord"), piece.alias("piece"), at.alias("start"), reply.alias("reply"),
        F.when(trained, F.coalesce(F.sum(trained.cast("int")).over(before), F.lit(0)).cast("long")).alias("example"),
    )


def expanded(rows: DataFrame) -> DataFrame:
    """conv_id, ord, piece, example: each row of examples() as a piece (example is null), and each assistant's one exploded into an
    example besides (piece is null).

    example: n (0, 1, ... in the conversation), context (from, until: the ords of its pieces; chars: their code points), reply (the
    ord of its last piece) and trained (from, to: code points of the example's text).
    """
    own = F.struct(
        F.col("example").alias("n"), F.struct(F.lit(0).alias("from"), F.col("ord").alias("until"), F.col("start").alias("chars")).alias("context"), F.col("ord").alias("reply"),
        F.struct((F.col("start") + F.col("reply")["from"]).alias("from"), (F.col("start") + F.col("reply")["to"]).alias("to")).alias("trained"),
    )
    kind = rows.select(own.alias("e")).schema["e"].dataType
    piece = F.struct(F.col("piece").alias("piece"), F.lit(None).cast(kind).alias("example"))
    both = F.array(piece, F.struct(F.lit(None).cast("string").alias("piece"), own.alias("example")))
    each = rows.select("conv_id", "ord", F.explode(F.when(F.col("example").isNull(), F.array(piece)).otherwise(both)).alias("_r"))
    return each.select("conv_id", "ord", "_r.piece", "_r.example")


def dealt(rows: DataFrame) -> DataFrame:
    """expanded() rows of examples(), a conversation in one partition and in order, each example behind its reply."""
    return expanded(rows).repartition("conv_id").sortWithinPartitions("conv_id", "ord", F.col("example").isNotNull())


def built(batches: Iterator) -> Iterator[tuple]:
    """(conv_id, example, text, from, to) of dealt rows, for each example: all pieces up to its own, and the part that is trained."""
    conv, text, first = None, "", True
    for batch in batches:
        for own, piece, example in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "example")), strict=True):
            if first or own != conv:
                conv, text, first = own, "", False
            if example is None:
                text += piece
            else:
                yield conv, example["n"], text, example["trained"]["from"], example["trained"]["to"]


def rendered(rows: DataFrame) -> DataFrame:
    """conv_id, example, text and trained (from, to in text): examples in full. This grows with the square of the turns."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, example long, text string, trained struct<`from`:long,`to`:long>"

    def run(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa

        head = next(batches, None)
        if head is None:
            return
        types = (head.schema.field("conv_id").type, pa.int64(), pa.string(), pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "example", "text", "trained"])
        out, size = [], 0
        for conv, example, text, since, to in built(itertools.chain([head], batches)):
            out.append((conv, example, text, {"from": since, "to": to}))
            size += len(text)
            if size >= CHUNK_BYTES:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    return dealt(rows).mapInArrow(run, schema)


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, read from formatted text alone.

    Turns are read from their pieces, and what is trained from each row of an example by its mask, whose place counts from the
    conversation's beginning. Rows are dealt by conversation, sorted there and hashed as they pass: a digest of a whole
    conversation needs its turns in order in one task, which holds one batch of them, whatever their number. A text of any
    length is one value: a piece and its text are held beside the batch.
    """
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator) -> Iterator:
        import itertools
        import re
        from hashlib import sha256

        import pyarrow as pa

        escaped = re.compile(r"\\(.)", re.S)
        body_at = re.compile(r"(?:[^\\>]|\\.)*> ", re.S)
        own, out, said = None, [], ("", 0, 0)

        def closed() -> tuple:
            conv, n, turns, chars, loss, size, examples = own
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, examples

        def batch_of(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields])

        head = next(batches, None)
        if head is None:
            return
        fields = [pa.field("conv_id", head.schema.field("conv_id").type), *(pa.field(n, t) for n, t in (("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())))]
        for batch in itertools.chain([head], batches):
            for conv, piece, example in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "example")), strict=True):
                if example is not None:
                    last, at, before = said  # the piece before, where its text begins, and the characters of its context
                    context, since, to = example["context"], example["trained"]["from"] - before, example["trained"]["to"] - before
                    if own is None or context["from"] or context["until"] != own[1] - 1 or context["chars"] != before or since != at or last[to:] != CLOSE:
                        raise ValueError("an example's context isn't whole, or its mask isn't that of the turn after it")
                    reply = escaped.sub(r"\1", last[since:to])
                    own[3] += len(reply)
                    own[4].update(reply.encode("utf-8", "surrogatepass"))
                    own[6] += 1
                    continue
                if own is None or own[0] != conv:
                    if own is not None:
                        out.append(closed())
                    own = [conv, 0, sha256(), 0, sha256(), 0, 0]
                if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
                    raise ValueError("a piece isn't a turn of the template")
                at = body_at.match(piece, len(OPEN)).end()
                role = escaped.sub(r"\1", piece[len(OPEN) : at - len(MIDDLE)])
                text = escaped.sub(r"\1", piece[at : -len(CLOSE)])
                own[1] += 1
                own[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                said = piece, at, own[5]
                own[5] += len(piece)
            if out:
                yield batch_of(out)
                out = []
        if own is not None:
            yield batch_of([closed()])

    return dealt(rows).mapInArrow(run, schema)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts are full of control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
