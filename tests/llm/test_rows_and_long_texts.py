"""Rows of examples, frames read in two ways, and what each operator does with a text of half a megabyte: nothing is cut."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rillflow.llm")
from rillflow.llm import chat, jpeg, licenses, lines, media, minhash, packing, pieces, toxicity, trie, warc  # noqa: E402


def test_an_example_is_a_row(spark):
    turns = [(c, k, "assistant" if k % 2 else "user", f"t{c} <{k}>") for c in (1, 2, None) for k in range(9)] + [(3, 0, "user", "x"), (4, 0, "assistant", None)]
    rows = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))
    each = chat.expanded(rows)
    made = {(r.conv_id, r.example.n): r.example for r in each.where("example is not null").collect()}
    assert len(made) == 3 * 4 + 1 and each.where("example is null").count() == len(turns)
    full = {(r.conv_id, r.example): r for r in chat.rendered(rows).collect()}
    texts = {(r.conv_id, r.ord): r.piece for r in each.where("example is null").collect()}
    for (conv, n), e in made.items():
        context = "".join(texts[conv, k] for k in range(e.context["from"], e.context.until))
        assert len(context) == e.context.chars and full[conv, n].text == context + texts[conv, e.reply] and e.trained == full[conv, n].trained
    # an example whose context is not what it says
    wrong = rows.withColumn("start", F.when(F.col("example") == 2, F.col("start") + 1).otherwise(F.col("start")))
    with pytest.raises(Exception, match="context"):
        chat.read_back(wrong).collect()


def test_frames_are_read_in_two_ways(spark, monkeypatch):
    draw = np.random.default_rng(1)
    avi = media.write_avi(draw.integers(0, 256, 64 * 100).astype(np.uint8).tobytes())
    monkeypatch.setattr(media, "CHECKED", 1)
    payload, frames, _ = media.read_avi(avi)
    assert len(payload) == 6400 and len(frames) == 2
    monkeypatch.setattr(jpeg, "decode", lambda raw: np.zeros((512, 512), np.uint8))
    with pytest.raises(ValueError):
        media.read_avi(avi)
    monkeypatch.undo()
    dark, light = b"\0" * 4096 * 25 * 600, b"\xff" * 4096 * 25 * 600  # a shot ends after 1,200 seconds
    ends = [media.shots([np.frombuffer(x, np.uint8)[:4096].reshape(64, 64)] * 15000) for x in (dark, light)]
    assert ends == [[(0, 15000)], [(0, 15000)]]
    clips = spark.createDataFrame([([(0.0, 1200.0), (1200.0, 1234.5)],)], "clips array<struct<start:double,end:double>>")
    assert clips.select(F.array_join(F.transform("clips", lambda c: F.format_string("%.2f", c["end"])), ",")).first()[0] == "1200.00,1234.50"


def test_long_texts_are_taken_whole(spark, tmp_path):
    draw = random.Random(4)
    words = ["".join(draw.choice("abdeilnorst") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    body = [" ".join(draw.choice(words) for _ in range(10)) for _ in range(8_000)]
    long = "\n".join(body)
    end = "\n".join(body[-60:])
    rows = [(1, long), (2, end), (3, long + " more"), (4, long + "\nall rights reserved vequx")]
    assert len(long) > 400_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {r.doc_id: r for r in lines.repeated_lines(docs).select("doc_id", "kept_text", "copies").collect()}
    assert found[2].kept_text == "" and [(c.first_doc, c.first_line, c.lines) for c in found[2].copies] == [(1, 7_940, 60)]
    licensed = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (licensed[4].n_words, licensed[4].first_word, licensed[4].base_labels) == (80_004, 80_000, "reserved") and licensed[1].n_base == 0
    coded = {r.doc_id: r for r in pieces.encode(docs).select("doc_id", "text_sha256", "decoded_sha256").collect()}
    assert all(coded[i].text_sha256 == coded[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [near[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 1, 1] and near[1].n_shingles > 79_000
    packed = packing.pack_documents(docs).where("doc_id = 1").orderBy("piece").collect()
    assert [r.start for r in packed][1:] == [r.start + r.length for r in packed][:-1] and packed[-1].start > 100_000 and all(r.length == 1024 for r in packed[1:])
    bucket = toxicity.grams(["vequx"])[0]
    value = np.full(int(max(toxicity.grams([long])[0].max(), bucket.max())) + 1, -9.0, np.float32)
    value[bucket] = 9
    scored = {r.doc_id: r.toxic_score for r in toxicity.score(docs, value, 0.0).collect()}
    assert scored[4] > scored[1] == scored[3]
    warc.write_archive(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), str(tmp_path / "warc"))
    pages = warc.describe(warc.read_archive(spark, str(tmp_path / "warc"))).collect()
    assert {r.page_id: r.payload_bytes for r in pages} == {i: len(t) for i, t in rows}
    frames = {r.doc_id: r for r in media.read_media(media.to_avi(docs)).collect()}
    assert frames[1].n_bytes == len(long) and frames[1].payload_bytes == len(long) + -len(long) % 64
    talk = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    said = {r.conv_id: r for r in chat.read_back(chat.examples(talk)).collect()}
    assert all(said[i].loss_chars == len(t) and said[i].loss_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    assert {r.n_bytes for r in trie.paths(talk).collect()} == {len(t) for _, t in rows}
