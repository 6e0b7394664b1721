"""Vectors with many links and pages with many revisits, a few thousand rows each, against plain versions."""

import base64
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("rillflow.llm")
from rillflow.llm import vectors, warc  # noqa: E402


@pytest.mark.parametrize("block", [16, 256])
def test_thousands_of_vectors(spark, block):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(90, 12))
    points = (centers[draw.integers(0, 90, 2400)] + draw.normal(size=(2400, 12)) * draw.choice([0.05, 0.25], (2400, 1))).astype(np.float32)
    points[2000:2200] = points[7]  # equal vectors
    labels = [None if i % 53 == 0 else int(draw.integers(0, 3)) if i % 4 else 1 for i in range(2400)]
    rows = [(i, [float(v) for v in p], labels[i]) for i, p in enumerate(points)] + [(2400, None, 1), (2401, [0.0] * 12, 1), (2402, [float("nan")] * 12, 1)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5), 0.93, block=block).collect()}
    unit = points.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    known = np.array([-1 if v is None else v for v in labels])
    hit = (unit @ unit.T >= 0.93) & (known[:, None] == known) & (known >= 0)[:, None]
    np.fill_diagonal(hit, False)
    least = np.arange(2400)
    while True:
        after = np.minimum(least, np.where(hit, least[None, :], 2400).min(1))
        if (after == least).all():
            break
        least = after
    assert len(got) == 2403 and hit.sum() > 20_000
    for i in range(2400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), least[i], least[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (2400, 2401, 2402))


def test_thousands_of_pages(spark, tmp_path):
    draw = random.Random(6)
    texts = ["", None, "é" * 5000, *(f"<p>{i}</p>" * draw.randrange(1, 40) for i in range(150))]
    rows = [(i, None if i % 11 == 0 else f"http://h/{i}", draw.choice(texts)) for i in range(3000)] + [(5000 + i, "u", "hot") for i in range(1500)]
    draw.shuffle(rows)
    path = str(tmp_path / "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), path)
    got = {r.page_id: r for r in warc.describe(warc.read_archive(spark, path)).collect()}
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        raw = (html or "").encode()
        of = first.setdefault(raw, i)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), digest, "response" if of == i else "revisit", None if of == i else of)
    assert len(got) == 4500 and spark.read.parquet(f"{path}/payloads").count() == len(first)
