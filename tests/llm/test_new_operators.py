"""Recompression, Hilbert zone maps and contour integration against brute force, and their defined results."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapledger.llm import feast, hilbert, recompression

VECTORS = "vec_id long, embedding array<double>, label int"


# -- Substring dedup ------------------------------------------------------------------------------------------------


def without_repeats(rows):
    """(doc_id, words, words removed, what is left) of every document, window by window."""
    least, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    size = recompression.WINDOW
    for i, words in split:
        for k in range(len(words) - size + 1) if i is not None else ():
            window = tuple(words[k : k + size])
            least[window] = min(least.get(window, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - size + 1) if i is not None else ():
            if least[tuple(words[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def removed(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "row": F.lit("x"), "cover": F.lit(2)} | more)
    return sorted((tuple(r) for r in recompression.deduplicated(frame).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_long_repeats_are_settled_by_their_blocks():
    """Whole texts in pieces: every window begins in one block, equal texts have equal blocks but at their ends."""
    draw = random.Random(9)
    words = [draw.choice("abcdefgh") for _ in range(3000)]
    parse = recompression.Parse(pa.array([" ".join(words), "x y " + " ".join(words[50:]) + " z", "a b"]), recompression.high((3, 4)))
    w, n, *names = parse.blocks()
    assert (recompression.expanded(w, n) == parse.windows()).all()
    own = [set(zip(*(name[(w >= a) & (w < b)] for name in names))) for a, b in zip(parse.at, parse.at[1:])]
    assert len(own[0] & own[1]) > 0.8 * len(own[1]) and len(own[0]) < 600 and not own[2]


@pytest.mark.parametrize("alphabet,seed", [(1, 0), (2, 1), (3, 2), (30, 3), (2000, 4)])
def test_repeats_are_found_in_any_alphabet(spark, alphabet, seed):
    draw = random.Random(seed)
    word = [f"w{k}é" for k in range(alphabet)]
    passages = [[draw.choice(word) for _ in range(n)] for n in (12, 13, 14, 30, 200)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += [draw.choice(word) for _ in range(draw.randint(0, 20))] + draw.choice(passages)
        rows.append((draw.randint(0, 50), " ".join(words)))
    assert removed(spark, rows) == without_repeats(rows)


def test_runs_and_periods_at_the_ends_of_a_repeat(spark):
    base = "a a a b a b a b c c c d e f g h i j k l l l".split()
    rows = [(1, " ".join(base)), (2, " ".join(["a", "a"] + base + ["l", "l"])), (3, " ".join(base[1:14])), (4, " ".join(base[2:16] + ["l"])), (5, "a " * 40), (6, "a " * 13), (7, "a b " * 30), (8, "b a " * 10)]
    assert removed(spark, rows) == without_repeats(rows)


def test_odd_documents_keep_their_defined_results(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [
        (1, None), (2, ""), (3, " \n\t\v\f\r "), (4, text), (4, text), (4, text + " tail"), (9, "x y " + text.replace(" ", "\n")), (None, text), (None, text),
        (0, "only here"), (7, "w " * 30_000), (8, "w " * 30_000), (10, text + " tail"),
    ]
    got = removed(spark, rows)
    assert got == without_repeats(rows)
    assert [r for r in got if r[0] is None] == [(None, 40, 0, text)] * 2  # an id that is null loses nothing
    assert {r[2] for r in got if r[0] == 4} == {0} and (9, 41, 40, "x y") in got


def test_an_empty_table_has_no_documents(spark):
    assert removed(spark, []) == []


def test_a_hot_passage_leaves_a_slice_as_two_rows(spark):
    """Rows that have to meet under one name don't grow with the documents of a slice."""
    passage = " ".join(f"p{k}" for k in range(13))
    batch = pa.RecordBatch.from_pydict({"doc": list(range(500)), "doc_id": list(range(500)), "row": [0] * 500, "text": [f"u{k} {passage} v{k}" for k in range(500)],
                                           "settled": pa.array([None] * 500, pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32())])))})
    out = pa.Table.from_batches(list(recompression._anchors((1, 2))(iter([batch])))).to_pylist()
    together = {}
    for r in out:
        together.setdefault(r["key"], []).append(r)
    assert max(len(v) for v in together.values()) == 2
    assert {r["doc"] for r in out if r["kind"] == recompression.DECIDED} == set(range(500))


def test_equal_windows_have_equal_names_and_anchors():
    draw = random.Random(5)
    words = [draw.choice("abc") for _ in range(400)]
    parse = recompression.Parse(pa.array([" ".join(words), "b " + " ".join(words[100:300]) + " c"]), (7, 11))
    w = parse.windows()
    names, keys = parse.names(w), parse.anchors(w)[1]
    text = words + ["b"] + words[100:300] + ["c"]
    seen: dict = {}
    for k, name, anchor in zip(w, names, keys):
        assert seen.setdefault(tuple(text[k : k + 13]), (name, anchor)) == (name, anchor)
    assert len({v[0] for v in seen.values()}) == len(seen)  # and different ones have different names


# -- Centroid clustering --------------------------------------------------------------------------------------------


def test_the_curve_visits_neighbouring_cells_one_after_another():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = hilbert.hilbert_place(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1).max() == 1


def test_a_box_never_loses_the_nearest_centroid():
    draw = np.random.default_rng(3)
    less = 0
    for _ in range(200):
        x = draw.integers(-50, 50, hilbert.DIMENSION) + draw.integers(0, draw.integers(2, 60), (20, hilbert.DIMENSION))
        centroids = draw.integers(-90, 90, (12, hilbert.DIMENSION))
        among = hilbert.candidates(x.min(0), x.max(0), centroids)
        every = ((x[:, None] - centroids) ** 2).sum(2)
        cluster, distance = hilbert.nearest(x, centroids, among)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        less += len(among) < len(centroids)
    assert less


def clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found)


def test_clusters_of_hot_and_odd_vectors(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(0, 3, (6, 64))
    rows = [(i, (centres[i % 6] + draw.normal(0, 0.2, 64)).tolist()) for i in range(300)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(400)] + [(5, rows[5][1]), (5, centres[3].tolist())]  # a hot vector, repeated rows and ids
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2006, [1.0] * 65)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], VECTORS).withColumns({"cluster": F.lit("x"), "place": F.lit(1), "tie": F.lit(2), "x": F.lit(3)})
    assert sorted(map(tuple, hilbert.clustered(frame, 7, 3).collect())) == clusters(rows, 7, 3)


def test_few_vectors_and_large_components(spark):
    rows = [(1, [3e5] * 64), (2, [-3e5] + [0.5] * 63), (3, [0.0] * 64)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert sorted(map(tuple, hilbert.clustered(frame, 5, 2).collect())) == clusters(rows, 5, 2)
    assert hilbert.clustered(frame.where("vec_id > 9")).collect() == []
    assert hilbert.clustered(spark.createDataFrame([(1, [2.0**19] * 64, 1), (None, [0.1] * 64, 1)], VECTORS)).select("vec_id", "cluster").collect() == [(None, 0)]


# -- Whitening ------------------------------------------------------------------------------------------------------


def test_inertia_counts_are_those_of_the_spectrum():
    draw = np.random.default_rng(1)
    for width in (1, 2, 7, 40):
        a = draw.normal(size=(width, width))
        v = a + a.T if width % 2 else a @ a.T
        e = np.linalg.eigvalsh(v)
        for s in (*((e[1:] + e[:-1]) / 2), e[0] - 1, e[-1] + 1):
            assert feast.above(v, s) == int((e > s).sum())
    assert feast.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no single pivot here


@pytest.mark.parametrize("spectrum", [
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [5] * 6 + [1] * 6, [1e9, 1, 1, 1e-3, 1e-3, 1e-5], [4, 4 - 1e-9, 4 - 2e-9, 1, 0, 0, 0], [1.0] * 30, [3.0], [1e12] + [1.0] * 20,
])
def test_contour_integration_finds_all_of_the_top(spark, spectrum):
    draw = np.random.default_rng(len(spectrum))
    turn, _ = np.linalg.qr(draw.normal(size=(len(spectrum),) * 2))
    v = turn * np.array(spectrum) @ turn.T
    v = (v + v.T) / 2
    e, u = feast.components(spark, v)
    want = sorted((s for s in spectrum if s > feast.RANK * max(spectrum)), reverse=True)[:8]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-13 * max(spectrum))
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ u - u * e).max() < 1e-12 * max(spectrum)


def test_whitening_by_numpy(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(size=12) * np.arange(1, 13)).tolist(), 0) for i in range(400)] + [(1000 + i, [0.25] * 12, 1) for i in range(200)]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [1.0] * 11, 1), (2003, [None] * 12, 1), (2004, [float("nan")] * 12, 1), (2005, [float("-inf")] * 12, 1)]
    got = feast.whitened(spark.createDataFrame(rows + odd, VECTORS).withColumn("component", F.lit("x"))).orderBy("vec_id", "component").collect()
    x = np.floor(1024 * np.array([v for _, v, _ in rows])).astype(np.int64) + 100_000
    d = x - x.mean(0)
    v = d.T @ d / len(x)
    e, u = (a[..., ::-1][..., :8] for a in np.linalg.eigh(v))
    y = d @ u / np.sqrt(e)
    have = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    assert np.abs(have * np.sign((have * y).sum(0)) - y).max() < 1e-9
    assert [r["deviation"] for r in got[::8]] == [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x]
    assert np.allclose([r["explained"] for r in got[:8]], e / np.trace(v), rtol=1e-12)
    assert {r["n"] for r in got} == {600} and got[0]["identity_error"] < 1e-10 and [r["component"] for r in got[:8]] == list(range(1, 9))


def test_vectors_that_cannot_be_whitened(spark):
    frame = lambda *rows: spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert feast.whitened(frame()).collect() == []
    assert feast.whitened(frame((1, [1.0, 2.0]))).collect() == [] == feast.whitened(frame((1, [1.0, 2.0]), (2, [1.0, 2.0]))).collect()
    assert feast.whitened(frame((1, []), (2, None))).collect() == []
    line = feast.whitened(frame((1, [0.0, 0.0]), (None, [2.0, 2.0]), (3, [4.0, 4.0]))).collect()  # rank one: one component
    assert [r["component"] for r in line] == [1, 1, 1] and abs(line[0]["explained"] - 1) < 1e-12
    far = feast.whitened(frame((1, [2.0**30, 0.0]), (2, [-(2.0**30), 1.0]), (3, [2.0**36, 1.0]))).collect()
    assert {r["n"] for r in far} == {2} and {r["deviation"] for r in far} == {None} and abs(abs(far[0]["whitened"]) - 1) < 1e-9


# -- BPE ------------------------------------------------------------------------------------------------------------


def test_words_of_any_length_are_merged_like_the_library_does():
    import time

    from tokenizers import Tokenizer

    from snapledger.llm import bpe

    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation()
    with open(bpe.tokenizer_path(), encoding="utf-8") as file:
        model = bpe.model_of(file.read())
    draw = random.Random(6)
    cases = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("a", "ab", "etaoinshr", "éßçdeлю", "!?-*") for n in (1, 7, 47, 48, 49, 50, 300, 4000)]
    cases += ["word,", "Word.", "it's", ".,", ",", "a.b", "x" * 40 + "\x7f", "<|startoftext|>a", "ABC,"]
    for text in cases:
        ids = [i for w in model.words(text) for i in model.merged(w)]
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
    begin = time.monotonic()
    assert len(model.merged("".join(draw.choice("etaoinshr") for _ in range(200_000)))) > 1000
    assert time.monotonic() - begin < 10
