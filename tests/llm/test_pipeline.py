"""The corpus pipeline, stage by stage and whole, on rows with nulls, repeats, clashing names and empty tables; bounds of memory."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("rillflow.llm")
import corpus_pipeline  # noqa: E402
from test_operators import line_runs, sets_of  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept_text string, toxic_score double, component_id long, piece string"
ROOT = Path(__file__).resolve().parents[2]


def made(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "r", "k", 9.0, -1, "p") for i, t in rows], SCHEMA).repartition(3)


def corpus():
    draw = random.Random(12)
    plain = ["".join(draw.choice("abdeilnorst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(draw.choice(plain) for _ in range(n))
    rows, marks = [], []
    for i in range(240):
        text = "\n".join(line(draw.randint(4, 14)) for _ in range(draw.randint(1, 6)))
        toxic = i % 5 == 0
        if toxic:
            text += " vequx" + draw.choice(plain) + " mokfgh" + draw.choice(plain)
        rows.append((i, text))
        marks.append((i, None, int(toxic)))
    long = line(90)
    rows += [(300, long), (301, long + " more"), (302, long), (302, long), (303, line(70)), (303, "other text"), (None, None), (None, "lone words here"), (304, ""), (305, " \n\n")]
    rows += [(310, "\n".join(["again and again"] * 12)), (311, rows[1][1] + "\n" + line(5)), (312, " ".join(line(9) for _ in range(900)))]
    return rows, marks


def write(spark, folder, docs, marks):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_match_plain_versions(spark, tmp_path):
    rows, marks = corpus()
    sf_dir = write(spark, tmp_path, made(spark, rows), [*marks, (None, 1, 1), (3, 1, None)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.toxic_filter(spark, docs, sf_dir).cache()
    assert clean.columns == docs.columns and clean.schema == docs.schema
    left = sorted(((r.doc_id, r.text) for r in clean.collect()), key=str)
    gone = {i for i, _ in rows} - {i for i, _ in left}
    toxic = {i for i, _, y in marks if y}
    assert len(gone - toxic) <= 4 and len(toxic - gone) <= 4
    assert {(None, None), (304, ""), (305, " \n\n")} <= set(left)

    deduped = corpus_pipeline.line_dedup(spark, clean, sf_dir).cache()
    kept, _ = line_runs(left)
    want = sorted(((i, None if t is None else kept[i, t]) for i, t in left if kept[i, t or ""] == (t or "") or kept[i, t or ""].strip()), key=str)
    assert deduped.schema == docs.schema and sorted(((r.doc_id, r.text) for r in deduped.collect()), key=str) == want
    assert all(r.n_chars == len(r.text) for r in deduped.collect() if r.text is not None)

    unique = corpus_pipeline.near_dedup(spark, deduped, sf_dir).cache()
    sets = sets_of(want, 5)
    near = lambda s, t: bool(s and t) and 100 * len(s & t) >= 80 * len(s | t)
    after = sorted(((r.doc_id, r.text) for r in unique.collect()), key=str)
    assert unique.schema == docs.schema and set(after) <= set(want)
    for i, t in want:  # a component has two texts here, so links are its members
        others = [j for (j, u), s in sets.items() if u != t and j is not None and near(s, sets[i, t])] + [j for j, u in want if u == t and j is not None]
        if i is not None:
            assert ((i, t) in after) == (not sets[i, t] or i == min(others)), (i, t)

    packed = corpus_pipeline.best_fit_packing(spark, unique, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in after}

    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed.collect()))


def test_stages_take_empty_tables(spark, tmp_path):
    sf_dir = write(spark, tmp_path, made(spark, []).limit(0), [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        assert found.count() == 0
        if name != "packing":
            assert found.schema == docs.schema
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_fit_stays_within_its_memory():
    """At the documented most: 2 * SAMPLE texts of SAMPLE_BYTES bytes."""
    code = """
import random, resource
from rillflow.llm import toxicity
draw = random.Random(1)
words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(5000)]
size = toxicity.SAMPLE_BYTES
texts = [" ".join(draw.choice(words) for _ in range(size // 6))[:size].ljust(size, "x") for _ in range(2 * toxicity.SAMPLE)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
toxicity.fit(texts, [i % 2 for i in range(len(texts))], epochs=2)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 300


def test_scores_match_a_plain_scorer():
    import numpy as np

    from rillflow.llm import toxicity

    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "!!", "A-b", "日本 語", "one", "x" * 5000, texts[3], texts[3]]
    value, bias = toxicity.fit(texts[:60], [i % 3 == 0 for i in range(60)], epochs=8)
    got = toxicity.scores(texts, value, bias)

    def bucket(gram: bytes) -> int:
        h = 0
        for b, f in zip(gram, toxicity.FACTORS, strict=False):
            h += int(toxicity.BYTE[b]) * int(f)
        h &= (1 << 64) - 1
        return ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - toxicity.BITS)

    for text, score in zip(texts, got, strict=True):
        words = bytes(toxicity.PLAIN[list((text or "").lower().encode())]).split() if text else []
        best = 0.0
        for i in range(0, len(words), toxicity.SEGMENT):
            bag = []
            for w in words[i : i + toxicity.SEGMENT]:
                marked = b" " + w + b" "
                bag += [bucket(marked[a : a + n]) for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for a in range(len(marked) - n + 1)]
            if bag:
                best = max(best, 1 / (1 + np.exp(-np.clip(value[bag].astype(float).mean() + bias, -30, 30))))
        assert abs(best - score) < 1e-9, text
    assert got[3] == got[-1] == got[-2]
