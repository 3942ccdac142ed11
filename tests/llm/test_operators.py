"""Each operator on small fixtures: right results by brute force, and the defined results of odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from snapledger.llm import bagminhash, bpe, chat, decontaminate, embeddings, html, pii, quality, sharding, shingles, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("bcdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "null id here now and then"), (6, "w " * 30_000)]


def odd(spark):
    """Odd rows in a table with extra columns, some named like results."""
    return docs(spark, ODD).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("component", F.lit(2)).withColumn("text_key", F.lit(3))


# -- HTML ---------------------------------------------------------------------------------------------------------


def page(k: int, body: str) -> str:
    return (f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><a href='/{k}'>Home</a></nav>"
            f"<div class='cookie-notice'>We use cookies {k}</div><div class=wrap><article><h1>Head {k}</h1>{body}</article>"
            f"<div class='comments'><p>nice {k}</p></div></div><form><input>Send</form><footer>&copy; site</footer></body></html>")


def test_html_keeps_the_article_only(spark):
    body = "<p>A&amp;B  <b>bo</b>ld<br>next<!-- no --><script>x<y</script><p>1 &lt; 2 &eacute;</p>"
    rows = [(k, f"http://h.example/{k}", page(k, body)) for k in range(8)] + [(90, None, None), (91, "x", ""), (91, "x", "")]
    got = {(r["page_id"], r["text"]) for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got == {(k, f"Head {k} A&B bold next 1 < 2 é") for k in range(8)} | {(90, ""), (91, "")}


def test_html_template_drops_constant_texts_without_an_article(spark):
    rows = [(k, "http://h.example/", f"<div>Our site</div><div><p>{' '.join(prose(k, 9))}</p></div><div>Buy now</div>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: " ".join(prose(k, 9)) for k in range(6)}


def test_html_equivalence_classes(spark):
    rows = [(k, "http://h.example/", f"<div id=a><ul>{'<li>x' * k}</ul></div><section class=b>{k}</section>") for k in range(1, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("site", html.host(F.col("url")))
    (row,) = html.templates(pages).collect()
    assert set(row["roles"]) == {"/div.id=a", "/div.id=a/ul", "/section.class=b"}  # list entries vary


def test_html_constant_texts_of_a_layout(spark):
    """An odd page, a run that a page repeats and a second layout don't bring back a layout's constant texts."""
    own = lambda k: " ".join(prose(k, 9))
    rows = [(k, f"<div>Our site</div><div><p>{own(k)}</p></div>{'<div>Buy now</div>' * (1 + (k == 2))}") for k in range(9)]
    rows += [(20 + k, f"<section>Second menu</section><section><p>{own(20 + k)}</p></section>") for k in range(4)] + [(90, "<p>moved</p>")]
    pages = spark.createDataFrame([(k, "http://h.example/", x) for k, x in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extracted(pages).collect()}
    assert got == {k: "moved" if k == 90 else own(k) for k, _ in rows}


def test_html_slots_decide_before_tags(spark, monkeypatch):
    link = lambda k: "".join(f"<a href=/{w}>{w} {w}</a>" for w in prose(3000 + k, 12))
    own = lambda k, n=30: " ".join(prose(k, n))
    linked = lambda k: f"<div class=xa>{link(k)}</div><div class=xb><p>{own(k)} <a href=/z>{k}</a></p></div>"
    inside = lambda k: f"<article><p>{own(k)}</p><div class=xc>{link(k)}</div></article>"
    beside = lambda k: f"<article><p>{own(k, 8)}</p></article><div class=xd><p>{own(500 + k, 60)}</p></div><div class=xe>by {k}</div>"
    named = lambda k: f"<nav>{link(k)}</nav><div class=widget><p>{own(k)}</p></div>"
    made = {"a": (linked, lambda k: f"{own(k)} {k}"), "b": (inside, own), "c": (beside, lambda k: f"{own(k, 8)} {own(500 + k, 60)}"), "d": (named, own)}
    rows = [(100 * i + k, f"http://{h}.example/", make(k)) for i, (h, (make, _)) in enumerate(made.items()) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extracted(pages).collect()}
    assert got == {100 * i + k: want(k) for i, (_, want) in enumerate(made.values()) for k in range(6)}
    whole = html.templates
    monkeypatch.setattr(html, "templates", lambda pages: whole(pages).withColumn("roles", F.array().cast("array<string>")))
    without = {r["page_id"]: r["text"] for r in html.extracted(pages).collect()}
    assert all(without[p] != got[p] for p in got)


def test_html_unclosed_and_stray_tags():
    assert html.main_text("<article><p>a<p>b</div><ul><li>c<li>d</article> tail", frozenset(), frozenset()) == "a b c d"
    assert html.main_text("x < y <b>z", frozenset(), frozenset()) == "x < y z"
    assert html.main_text("<main><p title='a>b'>t<script>never", frozenset(), frozenset()) == "t"


def test_html_query_on_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html as entities
    for r in html.op1_html(spark, sf).collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", given[r["page_id"]], re.S)[1])
        blocks = [" ".join(entities.unescape(x).split()) for x in re.sub(r"<[^>]*>", "\0", inner).split("\0")]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# -- quality and toxicity -----------------------------------------------------------------------------------------


def ranked(scores: list[float], truth: list[int]) -> float:
    good = [s for s, y in zip(scores, truth) if y]
    bad = [s for s, y in zip(scores, truth) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, sf).collect()}
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 for r in got.values())
    known = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    held = [(r["score"], y) for r, y in known if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r, _ in known)
    assert ranked(*zip(*held)) > 0.93


def test_quality_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)] + [(None, 1, 1)], LABELS)
    got = quality.scored(odd(spark), labels)
    assert got.count() == len(ODD) and got.where("score is null or isnan(score)").count() == 0
    assert quality.scored(odd(spark), labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.scored(odd(spark).limit(0), labels).count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert ranked(*zip(*held)) > 0.9
    caught = sum(s >= 0.5 for s, y in held if y) / sum(y for _, y in held)
    wrong = sum(s >= 0.5 for s, y in held if not y) / sum(1 - y for _, y in held)
    assert caught > 0.75 and wrong < 0.02
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_learns_words_and_stems_from_positives_alone(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = prose(i, 40) + (["grumbleo" + random.Random(i).choice("abcdef")] if bad else [])
        rows.append((i, " ".join(words)))
        if bad:
            labels.append((i, 1, 1))
    got = {r["doc_id"]: r for r in toxicity.scored(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert ranked([got[i]["score"] for i in held], [int(i % 6 == 0) for i in held]) > 0.95


def test_toxicity_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 1), (5, 1, 0), (None, 1, 1), (7, None, None)], LABELS)
    got = toxicity.scored(odd(spark), labels, "s", "p")
    assert got.count() == len(ODD) and got.columns[-2:] == ["s", "p"] and got.where("s between 0 and 1").count() == len(ODD)
    none = toxicity.scored(odd(spark), labels.limit(0), "s", "p")
    assert none.where("s = 0 and p = 0").count() == len(ODD)
    assert toxicity.scored(odd(spark).limit(0), labels, "s", "p").count() == 0


# -- near-duplicates ----------------------------------------------------------------------------------------------


def test_signatures_are_unbiased():
    draw = np.random.default_rng(5)
    off = []
    for _ in range(40):
        names = np.unique(draw.integers(1, 1 << 62, 60).astype(np.uint64))
        a, b = draw.integers(0, 40, len(names)), draw.integers(0, 40, len(names))
        b = np.where(draw.random(len(names)) < 0.6, a, b)
        one, two = (names[a > 0], a[a > 0]), (names[b > 0], b[b > 0])
        s = bagminhash.signatures([one, two])
        off.append((s[0] == s[1]).mean() - shingles.overlap(one, two))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.05


def test_word_hashes_follow_the_words():
    texts = ["The cat, the CAT!", None, "", "Ärger-Öl 12a", "x"]
    words, at = shingles.word_hashes(pa.array(texts))
    spelt = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in spelt]
    flat = [w for ws in spelt for w in ws]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))


def brute_classes(rows) -> dict:
    texts = [t for _, t in rows]
    bag = shingles.bags(pa.array(texts, pa.string()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if len(bag[i][0]) and (texts[i] == texts[j] or shingles.overlap(bag[i], bag[j]) >= 0.8):
                root[find(i)] = find(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def edited(words: list[str], n: int, seed: int) -> list[str]:
    draw, out = random.Random(seed), list(words)
    for k in draw.sample(range(len(words)), n):
        out[k] = f"edit{seed}x{k}"
    return out


def family(base: int, copies: int, edits: int, first: int):
    words = prose(base, 200)
    return [(first + k, " ".join(edited(words, edits * k // copies, first + k))) for k in range(copies)]


def test_near_duplicates_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 16)  # a family of several blocks
    rows = family(1, 60, 8, 100) + family(2, 9, 5, 200) + [(300 + k, " ".join(prose(50 + k, 80))) for k in range(30)]
    rows += [(400 + k, rows[0][1]) for k in range(20)] + [(430, "again and " * 200), (431, "again and " * 201), (432, "again and " * 90)]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_odd_rows(spark):
    got = Counter((r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(odd(spark)).collect())
    assert got == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (None, None), (6, 6)])
    kept = Counter(r["doc_id"] for r in bagminhash.deduplicated(odd(spark)).collect())
    assert kept == Counter([1, 2, 3, 4, None, 6])
    assert bagminhash.deduplicated(odd(spark)).columns == odd(spark).columns
    assert bagminhash.near_duplicates(odd(spark).limit(0)).count() == 0 == bagminhash.deduplicated(odd(spark).limit(0)).count()


# -- sharding -----------------------------------------------------------------------------------------------------


def test_sharding_law_and_positions(spark):
    rows = [(i, " ".join(prose(i, i % 90))) for i in range(3000)] + ODD
    got = sharding.shard(docs(spark, rows).withColumn("shard", F.lit(9))).collect()
    assert len(got) == len(rows)
    loads, places = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) <= set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    rest = [v for v in loads.values() if v < 60_000]  # the long text fills a shard of its own
    assert max(rest) - min(rest) <= 0.02 * max(rest)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(docs(spark, ODD).limit(0)).count() == 0


def test_equal_records_spread_over_all_shards(spark):
    rows = spark.range(100_000).select(
        F.when(F.col("id") < 40_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 40_000, "a").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard(rows).cache()
    loads = got.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    sizes = [r["bytes"] for r in loads]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 0.01 * max(sizes)
    assert sum(r["n"] for r in loads) == 100_000 and all(r["n"] == r["slots"] == r["last"] + 1 for r in loads)
    moved = got.where("next_shard <> shard")
    assert {r["next_shard"] for r in moved.select("next_shard").distinct().collect()} == {24} and abs(moved.count() - 4_000) < 200


def test_slot_map_edits():
    sizes = {s: 50 + s * 7919 % 1000 for s in range(4096)}
    first = sharding.first_map(sizes)
    changed = {s: n * (3 if s % 24 == 0 else 1) for s, n in sizes.items()}
    loads = lambda m, of, n: [sum(of[s] for s in m if m[s] == k) for k in range(n)]
    edited_map = sharding.rebalanced(first, changed, 24)
    assert max(loads(edited_map, changed, 24)) - min(loads(edited_map, changed, 24)) < 1000
    more = sharding.grown(first, sizes, 24)
    assert {more[s] for s in more if more[s] != first[s]} == {24}
    share = sum(sizes.values()) / 25
    assert abs(loads(more, sizes, 25)[24] - share) < 0.02 * share


def test_slot_map_versions_are_kept(spark, tmp_path):
    first = sharding.first_map({0: 5}, 3, 4)
    sharding.stored(spark, first, 1, str(tmp_path))
    sharding.stored(spark, {**first, 0: 2}, 2, str(tmp_path))
    both = spark.read.schema(sharding.MAP_SCHEMA).parquet(f"{tmp_path}/version=*")
    assert both.groupBy("version").count().count() == 2


# -- PII ----------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_as_by_python(spark):
    draw = random.Random(3)
    bits = ["a@b.c", "x.y%z@q-r.s.t", "@", ".", "_", "1.2.3.4", "256.1.1.1", "01.002.0003.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "5500005555555559", "+1 (702) 555-0742", "+12", "+", " ", "é", "😀", "7", "-", "word", "(", "0" * 17, "a@b.c_d@e.f", "9.9.9.9.9"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(600)] + ["1" * 60_000, "a" * 60_000 + "@", "1 " * 30_000, "+1" + "." * 50_000]
    got = pii.found_spans(docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("term"))  # the made-up words may disclose
        assert base == listed and r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]


def secret_rows():
    rows = [(i, f"{' '.join(prose(i, 20))} Nightjar contact boss{'' if i < 7 else i}@firm.example {' '.join(prose(900 + i, 5))}") for i in range(10)]
    rows += [(50 + i, f"{' '.join(prose(50 + i, 30))} contact nobody") for i in range(40)]
    return rows + [(95, "so the NIGHTJAR flies, nightjars don't")]


def test_words_that_disclose_an_entity(spark):
    rows = [(i, t.replace("boss7", "boss").replace("boss8", "boss").replace("boss9", "boss")) for i, t in secret_rows()]
    got = {r["term"]: r["level"] for r in pii.disclosing(docs(spark, rows).withColumn("key", F.col("doc_id").cast("string").cast("binary"))).collect()}
    # 51 texts, 10 with the entity; the word is in those and one more, "contact" in 50.
    assert got == {"nightjar": pytest.approx(1 + np.log(10 / 11) / -np.log(10 / 51))}
    spans = {r["doc_id"]: r["spans"] for r in pii.found_spans(docs(spark, rows)).collect()}
    assert spans[95] == "term:7:15" and spans[60] == ""
    cleaned = {r["doc_id"]: r for r in pii.sanitised(docs(spark, rows).withColumn("kind", F.lit(1))).collect()}
    assert cleaned[95]["text"] == "so the [TERM] flies, nightjars don't" and cleaned[95]["n_chars"] == len(cleaned[95]["text"])
    assert "[TERM] contact [EMAIL] " in cleaned[3]["text"] and cleaned[60]["text"] == dict(rows)[60]


def keyed(table):
    return table.withColumn("key", F.col("doc_id").cast("string").cast("binary"))


def test_words_far_from_the_entity_disclose_it(spark):
    far = " ".join(prose(1, 60))  # words of every text, longer than any window
    rows = [(i, f"Nightjar {far} see boss@firm.example" if i % 2 else f"boss@firm.example, {far} Nightjar 李雷") for i in range(30)]
    rows += [(50 + i, f"{far} {' '.join(prose(50 + i, 30))} contact nobody") for i in range(400)]
    rows += [(460, "write to nightjar@firm.example"), (461, f"{far} 李明")]
    got = {r["term"]: r["level"] for r in pii.disclosing(keyed(docs(spark, rows))).collect()}
    # 432 texts, 30 with the entity; the first word is in all of those, once more inside an entity only, the second in half.
    assert got == {"nightjar": 1.0, "see": 1.0, "李雷": 1.0}


def test_entities_of_one_and_of_two_texts(spark):
    common = prose(77, 200)
    draw = random.Random(8)
    some = lambda: " ".join(draw.choice(common) for _ in range(30))
    rows = [(i, f"{some()} only{'abcdefghij'[i % 10]}{i}x") for i in range(700)]
    rows[3:5] = [(3, f"Nightjar {some()} chanceword 10.20.30.40"), (4, f"10.20.30.40 {some()} nightjar otherword")]
    rows[8] = (8, f"Dr Quillfeather {some()} luckyword n.quillfeather@firm.example")
    rows[9] = (9, f"{some()} loneword +1 (702) 555-0742")
    got = {(r["term"], r["level"]) for r in pii.disclosing(keyed(docs(spark, rows))).collect()}
    # Words of one text pass by chance unless the entity spells them.
    assert got == {("nightjar", 1.0), ("quillfeather", 1.0)}
    cleaned = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, rows)).collect()}
    assert cleaned[8].startswith("Dr  ") and cleaned[8].endswith("luckyword [EMAIL]") and "ightjar" not in cleaned[3] + cleaned[4]


def test_pii_odd_rows(spark):
    got = pii.found_spans(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r["spans"] == "" for r in got)
    out = pii.sanitised(odd(spark))
    assert out.columns == odd(spark).columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, odd(spark).collect()))
    assert pii.found_spans(odd(spark).limit(0)).count() == 0 == pii.sanitised(odd(spark).limit(0)).count()


# -- decontamination ----------------------------------------------------------------------------------------------


def brute_leaks(rows, items) -> set:
    spell = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    for d, text in rows:
        words = spell(text)
        for i, item in items:
            own = spell(item)
            width = min(13, len(own))
            if not own:
                continue
            for shift in range(-len(own), len(words)):
                same = [int(own[q] == words[q + shift]) for q in range(max(0, -shift), min(len(own), len(words) - shift))]
                if any(sum(same[s : s + width]) >= -(-width * 8 // 10) for s in range(len(same) - width + 1)):
                    # Items below the window need a seed, too: short ones match as a whole.
                    out.add((d, i))
    return out


def test_leaks_as_by_brute_force(spark):
    items = [(k, " ".join(prose(500 + k, 14 + k * 5))) for k in range(6)] + [(20, "five short words of test"), (21, None), (22, ""), (23, "five short words of test")]
    rows = []
    for k in range(40):
        passage = items[k % 6][1].split()
        rows.append((k, " ".join(prose(k, 30) + edited(passage, min(len(passage) // 13 * 2, k % 4), k) + prose(k + 200, 30))))
    rows += [(60 + k, " ".join(prose(60 + k, 100))) for k in range(10)]
    rows += [(80, items[3][1].upper().replace(" ", ", ")), (81, " ".join(items[4][1].split()[:13])), (82, " ".join(items[4][1].split()[:10])), (83, "is Five short words of test?"), (84, "five short words of")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == brute_leaks(rows, items)
    clean = {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_masks_miss_no_window_with_two_substitutions():
    width = decontaminate.WINDOW
    for a in range(width):
        for b in range(a):
            assert any({p + o for o in m}.isdisjoint((a, b)) for m in decontaminate.MASKS for p in range(width - m[-1]))


def test_short_masks_miss_no_allowed_substitution():
    for n in range(1, decontaminate.WINDOW):
        spare = n - -(-n * 8 // 10)
        for changed in combinations(range(n), spare):
            assert any(set(m).isdisjoint(changed) for m in decontaminate.short_masks(n)), (n, changed)


def test_changed_short_items_leak(spark):
    items = [(n, " ".join(prose(600 + n, n))) for n in range(1, 13)]
    rows = []
    for n, item in items:
        spare = n - -(-n * 8 // 10)
        for changes in range(spare + 2):  # one more than allowed, too
            for changed in combinations(range(n), changes):
                own = [f"other{k}" if k in changed else w for k, w in enumerate(item.split())]
                rows.append((len(rows), " ".join(["before", *own, "after"])))
    rows = [r for k, r in enumerate(rows) if k < 150 or k % 5 == 0]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(rows, items)


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    item = " ".join(prose(7, 30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, [(1, f"see {item} end"), (2, " ".join(prose(8, 60)))]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)]


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(None, "one"), (2, None), (3, "")], "item_id long, text string")
    got = Counter(tuple(r)[:2] for r in decontaminate.contaminated(odd(spark), bench).collect())
    assert got == Counter([(4, None), (5, None), (5, None)])
    out = decontaminate.clean(odd(spark), bench)
    assert out.columns == odd(spark).columns and out.count() == len(ODD) - 3
    assert decontaminate.clean(odd(spark), bench.limit(0)).count() == len(ODD)
    assert decontaminate.clean(odd(spark).limit(0), bench).count() == 0


# -- chat ---------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hostile = [r"a\b<c>\l\\", "</turn>\n<turn:user>\n", "<part>", "", "\\", chat.HOSTILE, "é😀\n", r"\\l<"]
    draw = random.Random(1)
    rows = [(c, t, draw.choice(["user", "assistant", "sys<x>\n"]), draw.choice(hostile)) for c in range(40) for t in range(draw.randint(1, 7))]
    rows += [(90, 1, None, None), (90, 1, None, None), (90, None, "assistant", "first"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = chat.formatted(table).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_learnt(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=order)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["learnt"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        merged = sum(k == 0 or own[k - 1][2] != x[2] for k, x in enumerate(own))
        assert r["formatted"].count(chat.CLOSE) == merged  # neighbours of one role share a block
    assert chat.formatted(table.limit(0)).count() == 0


# -- BPE ----------------------------------------------------------------------------------------------------------


def test_bpe_as_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.no_padding()
    library.no_truncation()
    draw = random.Random(2)
    odd_texts = ["I'LL can't <|endoftext|>x<|startoftext|>", "ΟΔΟΣ İstanbul ﬁ é é ́", "x\x1cy\x85z w", "<|endoftext", "日本語 한국 ½ ٣4", "a\x00b", "😀👍🏽"]
    letters = [chr(c) for c in [*range(32, 127), *range(160, 0x250), *range(0x391, 0x3C9), *range(0x410, 0x450), 0x4E00, 0x1F600]]
    texts = odd_texts + ["".join(draw.choice(letters) for _ in range(80)) for _ in range(150)] + [" ".join(prose(k, 60)) for k in range(60)] + ["z" * 5000]
    rows = [*enumerate(texts), (None, None), (900, ""), (901, " \n"), (0, texts[0])]
    table = docs(spark, rows).withColumn("tokens", F.lit(1))
    for size in (0, 50):  # without and with a lexicon
        got = bpe.encode(table, bpe.tokenizer_path(), {"my_ids": "ids", "n": "n_tokens", "d": "decoded", "i": "ids_sha256", "h": "decoded_sha256"}, size)
        assert got.columns[: len(table.columns)] == table.columns and got.count() == len(rows)
        for r in got.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["my_ids"] == ids and r["n"] == len(ids)
            assert r["d"] == library.decode(ids, skip_special_tokens=False)
            assert r["i"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["h"] == hashlib.sha256(r["d"].encode()).hexdigest()
    assert bpe.encode(table.limit(0), bpe.tokenizer_path(), {"i": "ids"}).count() == 0


def test_transducer_is_exact_and_minimal(tmp_path):
    words = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate(sorted({w for s in range(40) for w in prose(s, 50)}))}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compiled(words))
    lexicon = bpe.Lexicon(str(path))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w + "x") is None and lexicon.find(w[:-1]) == words.get(w[:-1]) for w in words)
    futures = set()  # as many states as there are different sets of endings
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    for p in prefixes:
        futures.add(frozenset(w[len(p) :] for w in words if w.startswith(p)))
    assert len(lexicon.final) == len(futures)


# -- embeddings ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def test_embeddings_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    monkeypatch.setattr(embeddings, "TARGET", 50)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(300, 16))
    rows = [(i, x, int(i % 3)) for i, x in enumerate(base)]
    for k in range(500):
        i = int(draw.integers(0, 40 if k % 2 else 3))
        rows.append((1000 + k, base[i] * draw.uniform(0.5, 2) + draw.normal(size=16) * draw.choice([0.05, 0.2, 0.4]), i % 3))
    rows += [(3000 + k, base[5], 2) for k in range(30)]
    rows = [(i, [float(np.float32(v)) for v in x], label) for i, x, label in rows]
    bad = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, rows[0][1], None), (5004, [], 0), (5005, [None] * 16, 0), (None, rows[0][1], 0), (5006, [1.0], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + bad, VECTORS).withColumn("node", F.lit(1))).collect()}
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(near, False)
    found = sum(got[r[0]]["n_links"] for r in rows)
    assert found <= near.sum() and found >= 0.97 * near.sum()
    assert all(got[r[0]]["n_links"] <= near[k].sum() for k, r in enumerate(rows))
    least = {r["vec_id"]: r["component_id"] for r in got.values()}
    for k, r in enumerate(rows):
        assert least[r[0]] <= r[0] and got[r[0]]["kept"] == (least[r[0]] == r[0])
        if got[r[0]]["n_links"]:
            assert any(least[rows[j][0]] == least[r[0]] for j in np.flatnonzero(near[k]))
    for r in bad:
        assert got[r[0]]["n_links"] == 0 and got[r[0]]["component_id"] == r[0] and got[r[0]]["kept"] == (r[0] is not None)


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from snapledger.llm.common import folder

    session = lambda **set_: SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: set_.get("base", other)), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        folder(session())
    assert folder(session(base="/shared/here/")) == "/shared/here"


def test_true_links_of_keys_that_end_in_zero_bytes(spark):
    keys = [b"\x01" * 15 + b"\x00", b"\x02" * 16, b"\x03" * 14 + b"\x00\x00", b"\x04" * 16]
    units = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.99, float(np.sqrt(1 - 0.99**2))]]
    rows = [(k, "1:2", 1, True, u) for k, u in zip(map(bytearray, keys), units)]
    points = spark.createDataFrame(rows, "node binary, part string, copies long, asked boolean, unit array<double>")
    true = embeddings.true_links(points, points.groupBy("part").agg(F.count("*").alias("n"))).collect()
    assert {bytes(r["node"]): r["there"] for r in true} == dict(zip(keys, [1, 0, 0, 1]))


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None, None)], VECTORS)).count() == 1


def test_lone_pairs_beside_a_dense_group_are_found(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(4000, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = draw.normal(size=(150, 48))
    side -= (side * base[:150]).sum(1)[:, None] * base[:150]
    partner = 0.937 * base[:150] + np.sqrt(1 - 0.937**2) * side / np.linalg.norm(side, axis=1)[:, None]
    group = base[200] + draw.normal(size=(300, 48)) * 0.02
    x = np.concatenate((base, partner, group))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VECTORS.replace("float", "double"))).collect()}
    lone = [got[4000 + k]["component_id"] == k == got[k]["component_id"] for k in range(150)]
    assert sum(lone) >= 147
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = (unit @ unit.T >= 0.93).sum(1) - 1
    assert all(got[i]["n_links"] <= t for i, t in enumerate(true)) and sum(r["n_links"] for r in got.values()) >= 0.98 * true.sum()


# -- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_as_stage_by_stage_by_hand(spark, tmp_path):
    """Toxic documents, copies and leaking documents go, PII is replaced, and the library's ids are added."""
    from tokenizers import Tokenizer

    rows, labels = [], []
    for i in range(400):
        words = prose(i, 40)
        if i % 5 == 0:
            words[7] = "horridword"
            labels.append((i, 1, 1))
        rows.append((i, " ".join(words)))
    item = " ".join(prose(7777, 30))
    rows += [(1000, f"{rows[1][1]}"), (1001, " ".join(edited(rows[2][1].split(), 1, 9))), (1002, f"a {item} b"), (1003, rows[3][1] + " me@firm.example"), (1004, None), (1005, "")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = [(i, t) for i, t in rows if not (i < 1000 and i % 5 == 0) and i != 1002]
    classes = brute_classes(clean)
    assert set(got) == {i for i, _ in clean if classes[i] == i}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    for i, text in clean:
        if i in got:
            want = None if text is None else text.replace("me@firm.example", "[EMAIL]")
            assert got[i]["text"] == want and got[i]["ids"] == library.encode(want or "", add_special_tokens=False).ids
            assert got[i]["n_chars"] == (None if want is None else len(want))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs(spark, ODD).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        assert out.columns[: len(table.columns)] == table.columns and out.count() == len(ODD) - 2 * (name == "near_dedup"), name
