
import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("rillflow.llm")
from rillflow.llm import chat, licenses, packing, queries  # noqa: E402


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_packing_takes_special_tokens_as_tokenizers_does(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "\u65e5 <|endoftext|>"), (4, "<|endoftext|"), (5, "plain"), (6, None)]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert want[1][0] == 5
    path = documents(spark, tmp_path, rows)
    for got in (queries.op10_packing(spark, path), corpus_pipeline.best_fit_packing(spark, spark.createDataFrame(rows, "doc_id long, text string"), path)):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in got.collect()} == want


def test_chat_reads_trained_text_from_whole_examples(spark):
    from pyspark.sql import functions as F

    turns = [(c, t, "assistant" if t % 2 else "user", f"{c}<{t}") for c in (1, 2) for t in range(60)]
    rows = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    texts = {(r.conv_id, r.example): r for r in chat.rendered(rows).collect()}
    assert len(texts) == 60
    whole = "".join(f"<turn {r}> {x.replace('<', chr(92) + '<')}</turn>\n" for c, _, r, x in turns if c == 1)
    assert all(whole.startswith(texts[1, k].text) and texts[1, k].text.count(chat.CLOSE) == 2 * k + 2 for k in range(30))
    got = {r.conv_id: r for r in chat.read_back(rows).collect()}
    said = "".join(x for c, _, r, x in turns if c == 1 and r == "assistant")
    assert got[1].n_examples == 30 and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    # a context that is missing from the example moves the mask, which only a reader of whole examples can see
    with pytest.raises(Exception, match="mask"):
        chat.read_back(rows.where(F.col("ord") != 0)).collect()


def test_licenses_count_a_template_place_once_and_in_order(spark):
    notice = licenses.NOTICES["no-warranty"]
    texts = [
        (1, "the software " * 8), (2, "the software " * 8 + notice[len("the software ") :]), (3, notice), (4, "the software is provided as is and without warranty of any kind"),
        (5, "the software " * 40 + notice + " the software" * 40), (6, "without warranty of any kind the software is provided as is"), (7, "of any kind " * 6), (8, None),
        (9, notice + " " + "and so on " * 50 + notice),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    none, whole = ("", 0.0), ("no-warranty", 1.0)
    assert got == {1: none, 2: whole, 3: whole, 4: ("no-warranty", 0.9), 5: whole, 6: none, 7: none, 8: none, 9: whole}
    from pyspark.sql import functions as F

    known = licenses.templates(spark)
    found = licenses.spans(licenses.candidates(docs.select(F.col("doc_id").alias("_row"), licenses.words().alias("_words")), known), known).collect()
    assert sorted((r.start, r.end) for r in found if r._row in (3, 9)) == [(0, 11), (0, 11), (161, 172)]


def test_near_dedup_goes_by_row(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    near, far, lone = text + " more", " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(80))
    rows = [(1, text), (2, near), (2, far), (3, None), (3, text), (None, near), (None, far + " z"), (None, lone), (None, lone + " a"), (None, None), (None, "only this one")]
    rows += [(4, "twice the same row"), (4, "twice the same row")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    found = corpus_pipeline.near_dedup(spark, docs, "").collect()
    got = sorted(((r.doc_id, r.text) for r in found if r.text not in (lone, lone + " a")), key=str)
    assert got == sorted([(1, text), (2, far), (3, None), (None, None), (None, "only this one"), (4, "twice the same row"), (4, "twice the same row")], key=str)
    assert sum(r.text in (lone, lone + " a") for r in found) == 1 and found[0].asDict().keys() == {"doc_id", "text", "source"}
