"""Each operator against a brute-force version on a small table with nulls, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("rillflow.llm")
from rillflow.llm import chat, licenses, lines, media, minhash, packing, pieces, shingles, toxicity, vectors, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, row string, kept_text string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "p", "r", "k") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = [line(draw.randint(3, 9)) for _ in range(14)]
    out = [(0, None), (1, ""), (2, "  \n\n "), (3, "one"), (4, "One two"), (5, "one TWO"), (6, "one\ntwo"), (7, "日本語 テスト 🎉 ünïcode"), (8, "a\rb\tc")]
    copy = "\n".join(base)
    out += [(10, copy), (11, copy), (12, copy), (12, copy), (13, copy + "\n" + line(4)), (14, "\n".join(base[2:9])), (15, "\n".join([*base[5:], *base[:5]]))]
    passage = line(60)
    out += [(20, line(5) + "\n" + passage), (21, passage + "\n" + line(5)), (22, "\n".join([base[0]] * 12)), (23, "\n".join(line(3) for _ in range(400)))]
    big = [draw.choice(words) for _ in range(4000)]
    for i in range(12):
        own = list(big)
        for _ in range(draw.choice([0, 20, 60, 150])):
            own[draw.randrange(len(own))] = "x%d" % draw.randrange(1000)
        out.append((30 + i, " ".join(own)))
    out += [(50, "All rights reserved. cc by CC-BY general public license, GENERAL public. license"), (51, "Permission is hereby granted, free of charge, to any new person obtaining a copy"), (None, "all rights reserved"), (None, None)]
    return out


def empty(spark):
    return table(spark, []).limit(0)


def line_runs(rows):
    """(kept text by (doc_id, text), maximal runs by it), from windows of every length, by the rules of lines.repeated_lines."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0], hashlib.md5((("-" if r[0] is None else str(r[0])) + ":" + r[1]).encode()).digest()))
    split = [t.split("\n") for _, t in order]
    worded = [[p for p, x in enumerate(a) if x.strip(" \t\r")] for a in split]
    count = lambda a: sum(len(re.findall(r"[^ \t\r]+", x)) for x in a)
    longest, live, n = {}, [(d, p) for d, w in enumerate(worded) for p in range(len(w))], 1
    while live:
        places = defaultdict(list)
        for d, p in live:
            if p + n <= len(worded[d]):
                places[tuple(split[d][q] for q in worded[d][p : p + n])].append((d, p))
        live = [at for found in places.values() if len(found) > 1 for at in found]
        for run, (first, *others) in places.items():
            if n >= 4 or count(run) >= 50:
                longest.update({(d, p): (n, first) for d, p in others if d != first[0] or p - first[1] >= n})
        n += 1
    kept, runs = {}, defaultdict(list)
    for d, a in enumerate(split):
        gone, end = set(), -1
        for p in range(len(worded[d])):
            n, first = longest.get((d, p), (0, None))
            if n and p + n > end:
                end = p + n
                gone |= set(range(worded[d][p], worded[d][end - 1] + 1))
                runs[order[d]].append((worded[d][p], n, order[first[0]][0], worded[first[0]][first[1]]))
        kept[order[d]] = "\n".join(x for p, x in enumerate(a) if p not in gone)
    return kept, runs


def test_line_runs_match_brute_force(spark, rows):
    draw = random.Random(8)
    line = lambda n: " ".join(draw.choice("abcdefgh") + str(draw.randrange(9)) for _ in range(n))
    base, some = [line(3) for _ in range(500)], [f"few {i}" for i in range(3)]
    more = [(100, "\n".join(base)), (101, "\n\n".join(base)), (102, "\n".join([line(2), *base[100:350], line(2), *base[20:23]]))]
    more += [(110, "\n".join(["same"] * 12)), (111, "\n".join(["p", "q"] * 4)), (112, "\n".join(["p", "", "q"] * 9)), (113, "\n" * 300 + "p\nq\np"), (114, "\n".join([line(60)] * 3)), (115, "same\n" * 300)]
    more += [(120 + i, "\n".join(draw.choice(some) for _ in range(draw.randint(1, 40)))) for i in range(25)]
    rows = [*rows, *more]
    kept, runs = line_runs(rows)
    got = lines.repeated_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(bool(r) for r in runs.values()) >= 20 and runs[101, more[1][1]][0] == (0, 500, 100, 0)
    for r in got:
        key = r.doc_id, r.text or ""
        assert (r.kept_text or "") == kept[key], r.doc_id
        assert [(c.line, c.lines, c.first_doc, c.first_line) for c in r.copies] == runs[key], r.doc_id
        assert r.row.kept_text == "k" and (r.text is None) == (r.kept_text is None)
    by_id = {r.doc_id: r for r in got}
    assert by_id[110].kept_text == "\n".join(["same"] * 4) and by_id[111].kept_text == "p\nq\np\nq"
    assert lines.repeated_lines(empty(spark)).count() == 0
    assert lines.repeated_lines(table(spark, [(1, "a\nb"), (2, None)])).count() == 2


def sets_of(rows, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i, t] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


@pytest.mark.parametrize("k,percent,bands,per", [(3, 85, 24, 6), (5, 80, 30, 5)])
def test_minhash_groups_match_brute_force(spark, rows, k, percent, bands, per):
    rows = [r for r in rows if r[0] is not None]
    sets = sets_of(rows, k)
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, _), s in sets.items():
        for (b, _), t in sets.items():
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = minhash.near_duplicates(table(spark, rows), k, percent, bands, per).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == top(r.doc_id) and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles in {len(s) for (i, _), s in sets.items() if i == r.doc_id}
    assert minhash.near_duplicates(empty(spark)).count() == 0
    nulls = minhash.near_duplicates(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in nulls) == [(-1, -1), (-1, 4), (4, 4)]


def test_blocks_of_a_large_bucket_find_every_pair(spark, monkeypatch):
    """Chains: neighbours are near, leaders are far, so links are left for the comparison across components."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"v{i}" for i in range(700)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 160])) for i in range(60)]
    sets = sets_of(rows, 3)
    linked = all(100 * len(sets[rows[i]] & sets[rows[i + 1]]) >= 85 * len(sets[rows[i]] | sets[rows[i + 1]]) for i in range(59))
    assert linked
    got = minhash.near_duplicates(table(spark, rows), 3, 85, 24, 6).collect()
    assert {r.component_id for r in got} == {0}


def test_posterior_bounds_keep_true_pairs():
    bounds = minhash.fewest_equal(144, 24, 85, 1e-7)
    draw = np.random.default_rng(0)
    equal = draw.random((200_000, 144)) < 0.85
    assert all((equal[:, :n].sum(1) < least).mean() < 1e-4 for n, least in bounds)
    assert bounds[-1][1] > 90


def test_shingles_do_not_depend_on_neighbours():
    a = shingles.shingle_sets(["x y z q", "", None, "Y z"], 3)
    assert [len(s) for s in a] == [2, 0, 0, 1]
    assert (shingles.shingle_sets(["  X\ty  Z q\n"], 3)[0] == a[0]).all()
    assert (shingles.shingle_sets(["y Z"], 3)[0] == a[3]).all() and not set(a[3]) & set(a[0])


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (60, "a<|endoftext|>b"), (61, "x" * 30000), (62, "word " * 3000)]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        stop, at, k = (len(ids) - 1) % 1024 + 1, 0, 0
        while at < len(ids):
            want[i, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())] += 1
            at, stop, k = stop, stop + 1024, k + 1
    got = packing.pack_documents(table(spark, rows), keep_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_equals_best_fit_over_pieces():
    draw = random.Random(1)
    for _ in range(100):
        size = draw.choice([8, 64, 1024])
        counts = {draw.randint(1, size): draw.randint(1, 60) for _ in range(draw.randint(1, 25))}
        slots, bins, seen = packing.plan(counts, size), [], Counter()
        for length, _, n, _, _ in slots:
            seen[length] += n
        assert seen == Counter(counts)
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            k = min((b for b in range(len(bins)) if bins[b] >= length), key=lambda b: bins[b], default=None)
            if k is None:
                bins.append(size - length)
            else:
                bins[k] -= length
        assert len(bins) == len({s + i for _, _, n, s, _ in slots for i in range(n)})


def plain_viterbi(p, text):
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    known = {p.text[i]: (s, i) for _, (_, s, i) in p.automaton.items()}
    longest = max(map(len, known))
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            s = known.get(text[start:end])
            if s and best[start] + s[0] > best[end]:
                best[end], back[end] = best[start] + s[0], (start, [s[1]])
        if text[end - 1] not in p.single and best[end - 1] + p.least > best[end]:
            best[end], back[end] = best[end - 1] + p.least, (end - 1, [p.byte[b] for b in text[end - 1].encode()])
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_pieces_match_plain_viterbi_and_decode(spark, rows):
    p = pieces.opened(pieces.default_model())
    got = pieces.encode(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    spelled = {*(t for t in texts.values() if len(t) < 900), max(texts.values(), key=len)}
    for r in got:
        text = texts[r.text_sha256]
        assert r.decoded_sha256 == r.text_sha256 and p.decode(r.ids) == text and r.n_pieces == len(r.ids)
        if text in spelled:
            assert list(r.ids) == (plain_viterbi(p, "▁" + text.replace(" ", "▁")) if text else [])
    again = pieces.decode(pieces.encode(table(spark, rows)).select("doc_id", "ids", "text_sha256")).collect()
    assert all(texts[r.text_sha256] == r.text for r in again)
    assert pieces.encode(empty(spark)).count() == 0


def test_vectors_match_brute_force(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 12))
    rows = []
    for i in range(900):
        v = centres[draw.integers(6)] + draw.normal(size=12) * draw.choice([0.05, 0.3, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(draw.integers(2))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)] + [(1000, rows[0][1], rows[0][2])]
    odd = [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [None] + [1.0] * 11, 1), (2003, [float("nan")] * 12, 0), (2004, rows[1][1], None), (2005, [float("inf")] * 12, 0), (2006, [], 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [1e30, 2e30], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    unit, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([r[2] for r in rows])
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    root = list(range(len(rows)))

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in zip(*np.nonzero(hit), strict=True):
        ra, rb = sorted((top(a), top(b)))
        root[rb] = ra
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        least[top(i)] = min(least[top(i)], r[0])
    want = Counter((r[0], int(hit[i].sum()), least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows))
    want += Counter((i, n, c, i == c) for i, n, c in [*((r[0], 0, r[0]) for r in odd[:7]), (2007, 2, 2007), (2008, 2, 2007), (2009, 2, 2007)])
    got = Counter(tuple(r) for r in vectors.near_duplicates(df, 0.93, block=32).collect())
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_forest_spans_components_without_their_links():
    draw = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        for share in (0.0, 0.01, 0.1, 1.0):
            hit = np.triu(draw.random((n, n)) < share, 1)
            hit = hit | hit.T
            root = list(range(n))

            def top(v, root=root):
                while root[v] != v:
                    v = root[v]
                return v

            for a, b in vectors.forest(hit):
                assert hit[a, b] and top(a) != top(b)
                root[top(b)] = top(a)
            assert all(top(a) == top(b) for a, b in zip(*np.nonzero(hit), strict=True))
    assert len(vectors.forest(np.ones((512, 512), bool) ^ np.eye(512, dtype=bool))) == 511


def test_distant_blocks_are_skipped(spark):
    rows = []
    for b in range(40):
        spot = [float(b)] + [0.0] * (vectors.DIRECTIONS - 1)
        rows.append((0, 2, b, spot, spot))
    df = spark.createDataFrame(rows, "label int, size int, block long, lo array<double>, hi array<double>")
    got = {(r.x, r.y) for r in vectors.close_blocks(df, 1.0).collect()}
    assert got == {(b, b) for b in range(40)} | {(b, b + 1) for b in range(39)}


def test_licenses_match_brute_force(spark, rows):
    rows = [*rows, (70, None), (71, "cc by " * 500), (72, "ALL RIGHTS reserved all rights RESERVED")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(table(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        hits = [(j, label) for label, p in licenses.PHRASES.items() for q in [p.split()] for j in range(len(w)) if w[j : j + len(q)] == q]
        at = [j for j, _ in hits]
        want.add((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == want
    found = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert found[51].labels == "mit" and found[51].base_labels == "" and 0.8 <= found[51].score <= 1
    assert licenses.scan(table(spark, rows)).count() == len(rows)
    assert licenses.scan(empty(spark)).count() == 0


def test_media_round_trip(spark, rows):
    got = media.read_media(media.to_avi(table(spark, rows))).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    clips = media.clip_rows(media.read_media(media.to_avi(table(spark, rows)))).collect()
    assert {c.clip for c in clips if c.doc_id == 3} == {0} and all(c.end > c.start for c in clips)
    assert media.features(empty(spark)).count() == 0


def test_shots_follow_the_histogram():
    draw = np.random.default_rng(1)
    dark, light = ([draw.integers(a, a + 64, (64, 64)).astype(np.uint8) for _ in range(10)] for a in (0, 160))
    assert media.shots([*dark, *light, *dark]) == [(0, 10), (10, 20), (20, 30)]
    every = np.arange(256, dtype=np.uint8).repeat(16).reshape(64, 64)
    assert (media.unframe(media.frame(every)) == every).all() and (media.unframe(media.frame(every.T.copy())) == every.T).all()


def best_cover(words, template):
    """The most template places that a text's pairs of words cover in the order of both, in a stretch not much longer than the template."""
    grams = [tuple(template[i : i + 2]) for i in range(len(template) - 1)]
    met = [(p, a) for p in range(len(words) - 1) for a, g in enumerate(grams) if tuple(words[p : p + 2]) == g]
    best = 0
    for start, _ in met:
        longest = {}
        for p, a in sorted(m for m in met if start <= m[0] <= start + len(template) + 2 * licenses.DRIFT - 2):
            longest[p, a] = 1 + max([n for (q, b), n in longest.items() if q < p and b < a], default=0)
        best = max(best, *longest.values())
    return best / len(grams)


def test_notices_in_full_from_a_table_of_templates(spark, monkeypatch):
    draw = random.Random(9)
    texts = [(label, text, False) for label, text in licenses.NOTICES.items()] + [(label, text, True) for label, text in licenses.PHRASES.items()]
    rows = [(i, text.upper()) for i, (_, text, _) in enumerate(texts)]
    for i, (_, text, whole) in enumerate(texts):
        for k in range(4):
            w = text.split()
            for _ in range(k * 2 if not whole else 0):
                w[draw.randrange(len(w))] = draw.choice(["changed", "the", w[0]])
            rows.append((100 + 10 * i + k, "before " * k + " ".join(w) + " after the software is"))
    docs = table(spark, rows)
    want = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        want[i] = {label for label, text, whole in texts if (" " + text + " " in " " + " ".join(w) + " " if whole else best_cover(w, text.split()) >= licenses.LEAST)}
    extra = [("short", "one", False), ("none", None, False), (None, "no label here", True)]
    known = licenses.template_grams(spark.createDataFrame(texts + extra, "label string, text string, whole boolean"))
    for sent in (licenses.SENT, 0):
        monkeypatch.setattr(licenses, "SENT", sent)
        got = {r.doc_id: (set(filter(None, r.labels.split(","))), r.score) for r in licenses.scan(docs, known).collect()}
        assert {i: labels for i, (labels, _) in got.items()} == want
        assert all(score == 1.0 for i, (_, score) in got.items() if i < 100)
    assert sum(map(bool, want.values())) > 30 and licenses.scan(docs, known.limit(0)).where("labels <> ''").count() == 0


def other_jpeg(parts, restart=0, tables=True):
    """A baseline frame by another coder: parts are (samples, h, v), with AC coefficients, one of two quantisation tables."""
    import struct

    from rillflow.llm import jpeg

    codes = {}
    for name, (counts, symbols) in jpeg.DEFAULT.items():
        code, it = 0, iter(bytes.fromhex(symbols))
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                codes[name, next(it)] = format(code, f"0{n}b")
                code += 1
            code <<= 1
    most_h, most_v = max(h for _, h, _ in parts), max(v for _, _, v in parts)
    high, wide = parts[0][0].shape
    down, across = -(-high // (8 * most_v)), -(-wide // (8 * most_h))
    steps = [np.full(64, 4 + q) + np.arange(64) // 16 for q in range(2)]
    natural = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    planes = []
    for samples, h, v in parts:
        size = down * v * 8, across * h * 8
        planes.append(np.pad(samples, [(0, size[0] - samples.shape[0]), (0, size[1] - samples.shape[1])], mode="edge").astype(float))

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    out, bits, last = b"", "", [0] * len(parts)
    for unit in range(down * across):
        if restart and unit and unit % restart == 0:
            bits += "1" * (-len(bits) % 8)
            out += int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, last = "", [0] * len(parts)
        y, x = divmod(unit, across)
        for k, (_, h, v) in enumerate(parts):
            for j in range(v):
                for i in range(h):
                    at = (y * v + j) * 8, (x * h + i) * 8
                    block = basis @ (planes[k][at[0] : at[0] + 8, at[1] : at[1] + 8] - 128) @ basis.T
                    q = np.rint(block.reshape(64)[natural] / steps[k > 0]).astype(int).tolist()
                    n, extra = number(q[0] - last[k])
                    last[k] = q[0]
                    bits += codes[int(k > 0), n] + extra
                    zeros = 0
                    for c in range(1, max([i for i in range(64) if q[i]], default=0) + 1):
                        if q[c] == 0:
                            zeros += 1
                            continue
                        bits += codes[16 + (k > 0), 0xF0] * (zeros // 16)
                        n, extra = number(q[c])
                        bits += codes[16 + (k > 0), (zeros % 16) << 4 | n] + extra
                        zeros = 0
                    if not q[63]:
                        bits += codes[16 + (k > 0), 0]
    bits += "1" * (-len(bits) % 8)
    out += int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    segment = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"".join(bytes([q, *steps[q]]) for q in range(2)))
    if tables:
        head += b"".join(segment(0xC4, bytes([name, *counts]) + bytes.fromhex(symbols)) for name, (counts, symbols) in jpeg.DEFAULT.items())
    head += segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(parts)) + b"".join(bytes([k + 1, h << 4 | v, int(k > 0)]) for k, (_, h, v) in enumerate(parts)))
    head += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + segment(0xDA, bytes([len(parts)]) + b"".join(bytes([k + 1, 0x11 * (k > 0)]) for k in range(len(parts))) + b"\0\x3f\0") + out + b"\xff\xd9"


def test_frames_of_another_coder(spark):
    from rillflow.llm import jpeg

    y, x = np.mgrid[0:37, 0:53]
    plane = lambda a, b: (128 + 90 * np.sin(x / a) * np.cos(y / b)).astype(np.uint8)
    grey, luma, blue, red = plane(5, 7), plane(6, 4), plane(20, 30), plane(25, 15)
    for restart in (0, 3):
        assert np.abs(jpeg.decode(other_jpeg([(grey, 1, 1)], restart)).astype(int) - grey).max() <= 12
    assert np.abs(jpeg.decode(other_jpeg([(grey, 1, 1)], tables=False)).astype(int) - grey).max() <= 12
    for h, v in ((1, 1), (2, 1), (2, 2)):
        got = jpeg.decode(other_jpeg([(luma, h, v), (blue[::v, ::h], 1, 1), (red[::v, ::h], 1, 1)], 2)).astype(int)
        assert got.shape == (37, 53, 3) and np.abs(got[:, :, 0] - luma).max() <= 12 and np.abs(got[:, :, 1] - blue).mean() <= 12 and np.abs(got[:, :, 2] - red).mean() <= 12
    every = np.arange(256, dtype=np.uint8).reshape(4, 64)
    assert (jpeg.decode(media.frame(every)) == np.kron(every, np.ones((8, 8), np.uint8))).all()
    good = other_jpeg([(grey, 1, 1)])
    for bad in (b"", b"\xff\xd8", good[:-40] + b"\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode(bad)
    # a film of another coder, with places counted from the file's start, in grey and colour
    dark, light = plane(9, 9) // 4, 255 - plane(9, 9) // 4
    film = [other_jpeg([(f, 1, 1)]) for f in (dark, dark, light, light, light)]
    avi = media.write_avi(b"\0" * 64)
    import struct

    at = avi.index(b"LIST", avi.index(b"strf"))
    movie, index = b"movi", b""
    for f in film:
        index += struct.pack("<4sIII", b"00dc", 16, at + 8 + len(movie), len(f))
        movie += media._chunk(b"00dc", f)
    whole = avi[:at] + media._chunk(b"LIST", movie) + media._chunk(b"idx1", index)
    rows = spark.createDataFrame([(1, whole), (2, None), (3, b""), (4, media.write_avi(b"x" * 128))], "doc_id long, avi binary")
    got = sorted((r.doc_id, r.clip, r.start, r.end) for r in media.shots_of(rows).collect())
    assert got == [(1, 0, 0.0, 0.08), (1, 1, 0.08, 0.2), (4, 0, 0.0, 0.04)]
    assert media.shots_of(rows.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a", "same"), (3, "http://b\r\nX: y", "same"), (9, None, "same"), (1, "http://c", None), (2, "http://d", ""), (7, "u", "WARC/1.1\r\n\r\nünï"), (7, "u", "WARC/1.1\r\n\r\nünï"), (None, "n", "only")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, header string")
    warc.write_archive(df, str(tmp_path / "a"))
    back = warc.read_archive(spark, str(tmp_path / "a"))
    import base64

    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        again = first is not None and i != first
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(tuple(r) for r in warc.describe(back).collect()) == want
    for r in back.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and b"\r\nX: y" not in head
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 4
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="isn't that of its digest"):
        warc.describe(back.withColumn("payload", F.encode(F.lit("else"), "UTF-8")).withColumn("record", F.concat("record", "record"))).collect()
    warc.write_archive(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_chat_read_back(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "<turn user> x</turn>\n", "\\<\\\\", "日本\n> 語", "a\\"]
    turns = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "assi>st\\ant", None][: c + 1])]
    turns += [(50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (50, 0, "user", "q"), (None, 0, "assistant", "n")]
    df = chat.with_probe(spark, spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, piece string"))
    rows = chat.examples(df)
    got = {r.conv_id: r for r in chat.read_back(rows).collect()}
    by = defaultdict(list)
    for c, t, r, x in [*turns, (-7, 0, "user", odd[0]), (-7, 1, "assistant", odd[0])]:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    full = {(r.conv_id, r.example): r for r in chat.rendered(rows).collect()}
    assert len(full) == sum(r.n_examples for r in got.values())
    r = full[50, 1]
    assert r.text[r.trained["from"] : r.trained["to"]] == "x" and r.text.count(chat.CLOSE) == 3
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_every_example_is_its_context_and_reply(spark):
    draw = random.Random(6)
    said = ["x", "", "<", "\\", "</turn>\n", "a > b", "日本 🎉"]
    turns = [(c, t, draw.choice(["user", "assistant", "system", None]), "".join(draw.choice(said) for _ in range(draw.randint(0, 4)))) for c in range(12) for t in range(draw.randint(0, 14))]
    rows = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))
    escape = lambda t: t.replace("\\", "\\\\").replace("<", "\\<")
    want = {}
    for c in range(12):
        text, n = "", 0
        for _, _, role, body in sorted(t for t in turns if t[0] == c):
            since = len(text) + len(f"<turn {role or ''}> ")
            text += f"<turn {role or ''}> {escape(body)}</turn>\n"
            if role == "assistant":
                want[c, n] = (text, since, len(text) - len("</turn>\n"))
                n += 1
    got = {(r.conv_id, r.example): (r.text, r.trained["from"], r.trained["to"]) for r in chat.rendered(rows).collect()}
    assert got == want and len(want) > 15


def test_a_long_conversation_takes_linear_work(spark):
    from pyspark.sql import functions as F

    n = 100_000
    role = F.when(F.col("id") % 2 == 1, "assistant").otherwise("user")
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("said "), F.col("id").cast("string")).alias("text"))
    r = chat.read_back(chat.examples(turns)).first()
    whole = "".join(f"said {i}" for i in range(1, n, 2))
    assert (r.n_turns, r.n_examples, r.loss_chars, r.loss_sha256) == (n, n // 2, len(whole), hashlib.sha256(whole.encode()).hexdigest())


def test_toxicity_learns_parts_of_words(spark):
    draw = random.Random(3)
    plain = ["".join(draw.choice("abdeilnorst") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    bad = ["vequx", "mokfgh"]
    rows, marks = [], []
    for i in range(400):
        w = [draw.choice(plain) for _ in range(draw.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            w[draw.randrange(len(w))] = draw.choice(bad) + draw.choice(plain)
        rows.append((i, " ".join(w)))
        marks.append((i, None, int(toxic)))
    docs = table(spark, [*rows, (900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    value, bias = toxicity.model(docs, labels)
    got = toxicity.score(docs, value, bias).select("doc_id", "toxic_score", toxicity.held_out().alias("h")).collect()
    assert len(got) == 403 and all(0 <= r.toxic_score <= 1 for r in got)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    held = [(r.toxic_score >= 0.3, r.doc_id % 4 == 0) for r in got if r.h and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95
    value, bias = toxicity.model(docs, labels.limit(0))
    assert {r.toxic_score < 0.3 for r in toxicity.score(docs, value, bias).collect()} == {True}
    assert toxicity.score(empty(spark), value, bias).count() == 0
