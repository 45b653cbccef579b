import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bytetext, decontaminate, katz, language_id, license_scan, line_dedup, minhash_dedup, packing, quality_classifier, quality_rules, queries, suffix_dedup, tables
from tracewell.llm.tables import held_out, row_key

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, words string, found string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def made():
    """Texts with what may go wrong: nulls, empty, ties, copies, near copies, repeated rows, long and odd characters."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdeéñß", k=r.randint(1, 7))) for _ in range(80)]

    def prose(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", ". ", "\n", ", "]) for _ in range(n))

    texts = [None, "", " \n\t ", "one", "Ünï     Straße İ", "a b c d e f g h i j " * 30, "mit License, Apache-license; GENERAL public\nlicense mit license", "no licence here. mit"]
    texts += ["Released under the MIT License.\n" + prose(40), prose(30) + "\nLicensed under CC BY-NC 4.0.", "x" * 3000, "née " * 500, "$#* 12 <>|& %%"]
    texts += [prose(r.randint(5, 200)) for _ in range(25)]
    long = prose(900)
    passage = prose(120)
    texts += [long, long, long + " end", "begin " + long, long[:3000], prose(60) + passage + prose(50), prose(20) + passage, passage[:400], passage[1:402]]
    words = long.split(" ")
    for k in (3, 6, 25, 60):
        other = list(words)
        for i in r.sample(range(len(words)), k):
            other[i] = "zz"
        texts.append(" ".join(other))
    rows = [(i * 7 % 101 + 100, t) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (5, passage), (5, passage)]


ROWS = made()
BENCHMARK = [(1, " ".join(ROWS[30][1].split()[3:18])), (2, "a b c d e f g h i j"), (3, "one"), (4, None), (5, "!!"), (None, "Straße"), (6, "one"), (7, " ".join(ROWS[38][1].split()[40:70])), (2, "a b c d e f g h i j")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "xy"[len(t or "") % 2], "s", 1, 2, "w", "f") for d, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def want(values):
    return sorted(map(tuple, values), key=repr)


@pytest.mark.parametrize("order,heavy", [(1, 200_000), (2, 200_000), (2, 20), (3, 50)])
def test_katz(docs, none, order, heavy):
    how = katz.Katz(order=order, heavy=heavy, chunk_bytes=4000, bucket_grams=500)
    got = rows(katz.katz_scores(docs, ~held_out(10, 0), how), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    train = [brute.Katz.tokens(t) for d, t in ROWS if brute.crc(d) % 10]
    model = brute.Katz(train, order)
    single = {g[0]: c for g, c in model.counts[0].items()}
    n, v = sum(single.values()), len(single)
    expected = []
    for d, t in ROWS:
        own = brute.Katz.tokens(t)
        base = sum(np.log10((single.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        expected.append((d, brute.crc(d) % 10 == 0, len(own), sum(w in single for w in own), n, base, model.score(t)))
    key = lambda x: (x[0], x[2], round(x[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    assert katz.katz_scores(none, F.lit(True), how).count() == 0
    assert {r["score"] for r in katz.katz_scores(docs, F.lit(False), how).collect()} == {0.0}


def test_registered_katz_is_a_trigram_model(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = brute.Katz([brute.Katz.tokens(t) for d, t in ROWS if brute.crc(d) % 10], 3)
    got = queries.op1_katz_scores(spark, str(tmp_path)).collect()
    for r, (_, x) in zip(sorted(got, key=lambda r: (r["doc_id"], r["score"])), sorted((d, model.score(t)) for d, t in ROWS), strict=True):
        assert r["score"] == pytest.approx(x, rel=1e-9, abs=1e-9)


def test_katz_scores_store_no_model(docs, monkeypatch):
    how, stored = katz.Katz(order=3, chunk_bytes=4000, bucket_grams=500), []
    monkeypatch.setattr(katz, "store", lambda *a: stored.append(katz_store(*a)) or stored[-1])
    katz_store = tables.store
    kept, model, _ = katz.train(docs, ~held_out(10, 0), how)
    assert model.count() > 0
    stored.clear()
    got = katz.katz_scores(docs, ~held_out(10, 0), how)
    assert sum(t.where("kind = 'model'").count() for t in stored if "kind" in t.columns) == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, kept.collect()))


def test_katz_answers_are_dealt_to_chunks_once(docs, monkeypatch):
    """No level deals out again what the levels below have answered, and words alone make no more buckets than they need."""
    plans, asked, katz_store, request = {}, [], tables.store, katz.Level
    monkeypatch.setattr(katz, "Level", lambda *a, **b: asked.append(request(*a, **b)) or asked[-1])
    monkeypatch.setattr(katz, "store", lambda df, name, *a: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or katz_store(df, name, *a))
    katz.katz_scores(docs, ~held_out(10, 0), katz.Katz(order=3, chunk_bytes=20_000, bucket_grams=500))
    assert [plans[f"katz-level{n}"].count("Exchange hashpartitioning") for n in (1, 2, 3)] == [1, 1, 1]
    assert "Exchange" not in plans["katz-scores"]
    assert asked[0].buckets < asked[1].buckets == asked[2].buckets


@pytest.mark.parametrize("bound", [50, 1 << 40, 1 << 62])
def test_katz_distinct_numbers(bound):
    keys = np.random.default_rng(5).integers(0, bound, 3000, dtype=np.uint64)
    keys[1000:2000] = keys[:1000]
    got, at, which = katz.distinct(keys.copy(), bound)
    assert (got == np.unique(keys)).all() and (keys[at] == got).all() and (got[which] == keys).all()


def test_katz_sums_to_one(docs):
    words = sorted({w for _, t in ROWS for w in brute.Katz.tokens(t) if w})[:60]
    model = brute.Katz([brute.Katz.tokens(" ".join(words[i:] + words[:9])) for i in range(0, 50, 3)], 2)
    everything = [*model.counts[0], ("unknown",)]
    for h in (None, words[3], words[40], "never"):
        assert sum(model.p((h, g[0])) for g in everything) == pytest.approx(1)


def test_quality_classifier(spark, none):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choices(["word", "text", "good"] if i % 2 else ["$$$", "<>", "##"], k=40))) for i in range(400)] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, ~held_out(4, 2)).collect()
    held = [x for x in got if brute.crc(x["doc_id"]) % 4 == 2 and x["doc_id"] < 400]
    assert len(got) == 402 and all(0 <= x["score"] <= 1 for x in got)
    assert np.mean([(x["score"] >= 0.5) == x["doc_id"] % 2 for x in held]) > 0.97
    assert quality_classifier.classify(none, labels, F.lit(True)).count() == 0
    assert {x["score"] for x in quality_classifier.classify(docs, labels.where("false"), F.lit(True)).collect()} == {0.5}


def test_quality_classifier_by_brute_force(spark):
    r = random.Random(2)
    texts = [t for _, t in ROWS if t is None or len(t) < 4000]
    for t, x in zip(texts, quality_classifier.features(*next((d, o) for _, d, o in bytetext.chunks(pa.array(texts, pa.string()), 1 << 40)))):
        assert x.tolist() == pytest.approx(brute.text_features(t))
    how = quality_classifier.Training(bins=6, pair_bins=3, pairs=4, rounds=12, pair_rounds=8)
    made_ = [(i, " ".join(r.choices(["word", "Text", "good.", "$$", "<>", "7"], [3, 3, 3, i % 3, i % 2, 1], k=r.randint(1, 60))) + "\n" * (i % 4)) for i in range(120)]
    labels = [(i, int(i % 3 == 0 or i % 7 == 0)) for i, _ in made_]
    docs = spark.createDataFrame([(*d, 1, 0.5, "f") for d in made_ + made_[:5]], "doc_id long, text string, row int, score double, features string")
    got = {(x["doc_id"], x["score"]) for x in quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 4 != 2, how).collect()}
    held = [(d, t) for d, t in made_ + made_[:5] if d % 4 != 2]
    model = brute.additive_model([brute.text_features(t) for _, t in held], [dict(labels)[d] for d, _ in held], how)
    expected = {d: model(brute.text_features(t)) for d, t in made_}
    assert len(got) == 120 and all(s == pytest.approx(expected[d], abs=1e-6) for d, s in got)


def test_license_scan(docs, none, spark):
    found = license_scan.scan(docs)
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want((d, *brute.licences(t)) for d, t in ROWS)
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert "cc-by-nc" in {r["labels"] for r in found.collect()}
    texts = [f"{'some words first ' * k}{passage} and more" for k, (_, passage, _) in enumerate(license_scan.TEMPLATES)]
    texts += ["permission is hereby granted " * 3, "software license free of charge", "license " * 500]
    labels = [r["labels"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for (label, _, _), got in zip(license_scan.TEMPLATES, labels):
        assert label in got.split(",")
    assert labels[-3:] == ["", "", ""]
    assert license_scan.scan(none).count() == 0


def test_license_labels_by_brute_force(docs, spark):
    r = random.Random(9)
    texts = [t for _, t in ROWS[:30]]
    for _, passage, _ in license_scan.TEMPLATES:  # whole, with words changed, and cut
        words = passage.split()
        for k in (0, 1, 2, 4):
            texts.append("before this " + " ".join("other" if r.random() < k / len(words) else w for w in words) + " and after")
        texts.append(" ".join(words[len(words) // 4 :]).upper())
    data = list(enumerate(texts))
    got = license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).orderBy("doc_id").collect()
    expected = brute.licence_labels(texts, license_scan.TEMPLATES, license_scan.Scan().agree)
    assert [r["labels"] for r in got] == [x for x, _ in expected]
    assert [r["score"] for r in got] == pytest.approx([x for _, x in expected], abs=1e-9)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


def test_license_scan_whole_licences(spark):
    texts = [f"Copyright (c) 2025 A\n\n{MIT}\n\ncode()", f"{MIT}\n-----\n{BSD}", f"/* {BSD} */"]
    assert len(brute.ALNUM_WORD.findall(texts[1])) > 150
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "bsd,mit", "bsd"]


def test_license_scan_misspelt_words(spark):
    """A notice one of whose words is misspelt keeps its label, whichever word, as long as its key phrases stand."""
    texts, want = [], []
    for label, passage, needs in license_scan.TEMPLATES:
        words, fixed = passage.split(), set(" ".join(needs).split())
        for k, w in enumerate(words):
            if w not in fixed and len(words) > 10:
                texts.append(" ".join([*words[:k], w + "x", *words[k + 1 :]]))
                want.append(label)
    assert any("unencumberedx" in t for t in texts)
    texts += ["plain text"] * 300
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [t for t, w, r in zip(texts, want, got) if w not in r["labels"].split(",")] == []
    expected = brute.licence_labels(texts, license_scan.TEMPLATES, license_scan.Scan().agree)
    assert [r["labels"] for r in got] == [x for x, _ in expected]


def test_license_scan_two_notices(spark):
    pairs = [(a, b) for a in license_scan.TEMPLATES for b in license_scan.TEMPLATES if a != b]
    texts = [f"{a[1]}. And then {b[1]}." for a, b in pairs]
    every = " ".join(p for _, p, _ in license_scan.TEMPLATES)  # no word is rarer than another
    for others in ([], ["plain text"] * 300, [every] * 3):
        frame = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
        got = license_scan.scan(frame).where(F.col("doc_id") < len(texts)).orderBy("doc_id").collect()
        assert [p for p, r in zip(pairs, got, strict=True) if not {p[0][0], p[1][0]} <= set(r["labels"].split(","))] == []
    alone = spark.createDataFrame([(k, p) for k, (_, p, _) in enumerate(license_scan.TEMPLATES)] + [(20 + k, every) for k in range(200)], "doc_id long, text string")
    for r in license_scan.scan(alone).where("doc_id < 20").collect():
        assert license_scan.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == pytest.approx(1)


def test_line_dedup(spark):
    line = "this is a line of eight whole words here"
    texts = [f"Own first text.\n{line}\nmore of it", f"{line.upper()}  \nan other text\n{line}", None, "", f"Here it is. {line} too. This is  A line of eight whole words! End", "short one\nshort one\n分かち書きのない行", "分かち書きのない行\nSHORT  one"]
    got = {r["doc_id"]: r for r in line_dedup.remove_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["kept_text"] for i in range(7)] == [texts[0], "an other text\n", "", "", texts[4], "short one\n分かち書きのない行", ""]
    assert [tuple(x) for x in got[1]["spans"]] == [(0, 43), (57, 97)]


@pytest.mark.parametrize("hot", [1000, 2])
def test_line_dedup_by_brute_force(docs, none, spark, hot):
    r = random.Random(12)
    sentences = ["".join(r.choices("abc de.! é", k=r.randint(3, 90))) for _ in range(60)]
    made_ = [(r.choice([None, *range(50)]), r.choice([" ", "\n", "\n\n"]).join(r.choices(sentences, k=r.randint(1, 9)))) for _ in range(150)]
    for data in (ROWS, made_ + made_[:20]):
        frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "0 as row", "1 as rank", "2 as digest")
        keys = {(x["doc_id"], x["text"]): x["key"] for x in frame.select("doc_id", "text", row_key().alias("key")).collect()}
        found = line_dedup.remove_units(frame, line_dedup.Units(hot=hot))
        assert rows(found, "doc_id", "n_chars", "n_removed", "kept_sha256") == want(brute.without_repeated_units(data, lambda d, t: keys[d, t]))
    assert line_dedup.remove_units(none).count() == 0


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got, *names) == want((d, *brute.rules(t)) for d, t in ROWS)
    assert got.where("base_failed and kept").count() == 0 and got.where("kept").count() > 10
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_bands_by_the_compressor(docs, spark):
    bands = quality_rules.Bands()
    r = random.Random(5)
    made_ = ["".join(r.choices("ab c", k=n)) for n in (63, 64, 300, 2047, 2048, 2049, 5000)] + ["".join(chr(r.randint(33, 1000)) for _ in range(n)) for n in (50, 500, 3000)] + ["same words again " * 300]
    data = ROWS + [(1000 + i, t) for i, t in enumerate(made_)]
    got = quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string"))
    expected = []
    for d, t in data:
        ratio, passes = brute.band_verdict(t, bands)
        expected.append((d, round(ratio, 9), passes and not brute.rules(t)[5]))
    assert rows(got.select("doc_id", F.round("ratio", 9).alias("ratio"), "kept"), "doc_id", "ratio", "kept") == want(expected)
    assert len({k for *_, k in expected}) == 2


def test_quality_rules_see_the_end(spark):
    r = random.Random(4)
    prose = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") if i % 7 else " " for i in range(4096))
    texts = [prose[:2048] + "x" * 2047, prose[:4095], prose[:2048], prose[:2000]]
    got = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["kept"] for x in got] == [False, True, True, True] and got[0]["chunk_high"] > 3.2
    assert [x["chunk_high"] is None for x in got] == [False, False, False, True]


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontaminate(spark, docs, none, block):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.decontaminate(docs, benchmark, block_words=block), *names) == want((d, *brute.leaks(t, BENCHMARK)) for d, t in ROWS)
    assert decontaminate.decontaminate(none, benchmark, block_words=block).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false"), block_words=block).where("contaminated").count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer, how = Tokenizer.from_file(TOKENIZER), packing.Packing(capacity=256, bucket_rows=10)
    expected = []
    for d, t in ROWS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(d, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    got = packing.pack(docs, TOKENIZER, how)
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == want(expected)
    at = {}
    for r in sorted(got.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 256 and len(at) <= 1.02 * sum(at.values()) / 256 + 2
    assert packing.pack(none, TOKENIZER, how).count() == 0
    whole = packing.sequences(docs, TOKENIZER, how).collect()
    assert sorted(len(r["ids"]) // 4 for r in whole) == sorted(at.values())


def test_packing_fits_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    other = TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    assert isinstance(packing.fitting(TOKENIZER, 100), packing.WordTokens) and isinstance(packing.fitting(other, 100), packing.WholeTokens)
    texts = [t for _, t in ROWS if t is None or len(t) < 500]
    tokenizer = Tokenizer.from_file(other)
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), other, packing.Packing(capacity=4096, bucket_rows=10))
    expected = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts)]
    assert rows(got, "doc_id", "length", "ids_crc32") == want(expected)


@pytest.mark.parametrize("operator", ["katz", "quality", "rules", "license", "lines", "leaks", "pack", "minhash", "language"])
def test_a_text_over_a_chunk(spark, operator):
    """Texts of more than a mebibyte, a chunk's size, get what brute force says."""
    r = random.Random(31)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(2, 9))) for _ in range(5000)]
    body = " ".join(r.choices(vocabulary, k=250_000))
    assert len(body.encode()) > bytetext.CHUNK_BYTES
    data = [(1, body + "\nreleased under the mit license"), (2, "short and other words"), (3, body + "\nreleased under the mit license too"), (4, None)]
    docs = spark.createDataFrame([(*d, "x" if d[0] == 2 else "y") for d in data], "doc_id long, text string, lang string")
    if operator == "katz":
        model = brute.Katz([brute.Katz.tokens(t) for _, t in data[:2]], 1)
        got = {x["doc_id"]: x["score"] for x in katz.katz_scores(docs, F.col("doc_id") < 3, katz.Katz(order=1)).collect()}
        assert all(got[d] == pytest.approx(model.score(t), rel=1e-9) for d, t in data)
    elif operator == "quality":
        got = {x["doc_id"]: x["features"] for x in quality_classifier.measure(docs).collect()}
        assert all(got[d] == pytest.approx(brute.text_features(t)) for d, t in data)
    elif operator == "rules":
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert rows(quality_rules.quality_rules(docs), *names) == want((d, *brute.rules(t)) for d, t in data)
    elif operator == "license":
        got = license_scan.scan(docs)
        assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want((d, *brute.licences(t)) for d, t in data)
    elif operator == "lines":
        got = {x["doc_id"]: x for x in line_dedup.remove_units(docs).collect()}
        assert [got[d]["n_removed"] for d in (1, 2, 3, 4)] == [0, 0, len(body) + 1, 0]
    elif operator == "leaks":
        items = [(7, " ".join(body.split()[200_000:200_012])), (8, "never found here at all")]
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"]) for x in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
        words = len(brute.ALNUM_WORD.findall(body))
        assert got == {1: (words + 5, 12, 1), 2: (4, 0, 0), 3: (words + 6, 12, 1), 4: (0, 0, 0)}
    elif operator == "pack":
        from tokenizers import Tokenizer

        ids = {d: np.array(Tokenizer.from_file(TOKENIZER).encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in data}
        got = packing.pack(docs, TOKENIZER).collect()
        assert {(x["doc_id"], x["start"], x["ids_crc32"]) for x in got} == {(d, k, zlib.crc32(v[k : k + 2048].tobytes())) for d, v in ids.items() for k in range(0, len(v), 2048)}
    elif operator == "minhash":
        assert rows(minhash_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == want(brute.components(data))
    else:
        got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(docs, language_id.learn(docs, language_id.Space(dimensions=256)), language_id.Space(dimensions=256)).collect()}
        assert got == {1: "y", 2: "x", 3: "y", 4: "und"}


def test_plan_uses_all():
    r = np.random.default_rng(1)
    for top in (40, 300, 2048):
        counts = np.bincount(np.minimum(r.geometric(8 / top, 5000), top - 1), minlength=top)
        used = np.zeros(top, int)
        n = 0
        for lengths, k in packing.plan(counts, packing.Packing(capacity=top)):
            assert sum(lengths) <= top
            np.add.at(used, list(lengths), k)
            n += k
        assert (used == counts).all() and n <= 1.01 * (counts * np.arange(top)).sum() / top + 2


@pytest.mark.parametrize("tile,shingles", [(256, 2_000_000), (2, 2_000_000), (256, 300)])
def test_minhash(docs, none, tile, shingles):
    found = minhash_dedup.near_duplicates(docs, minhash_dedup.MinHash(tile=tile, tile_shingles=shingles))
    assert rows(found, "doc_id", "n_shingles", "component_id") == want(brute.components(ROWS))
    assert found.where("kept <> (doc_id = component_id)").count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_minhash_group_of_strays(spark):
    """Texts near one another, few of which are linked with the pivot itself."""
    r = random.Random(14)
    base, data = [f"w{i}" for i in range(120)], []
    for i in range(90):
        words = list(base)
        for k in r.sample(range(120), r.randint(1, 4)):
            words[k] = f"x{r.randint(0, 3)}"
        data.append((i, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for tile in (256, 7):
        found = minhash_dedup.near_duplicates(docs, minhash_dedup.MinHash(percent=80, bands=37, tile=tile))
        assert rows(found, "doc_id", "n_shingles", "component_id") == want(brute.components(data, 80))


def test_minhash_shared_boilerplate(spark, monkeypatch):
    """Unlinked texts with most words in common: what is compared at last grows as they do; links among them are found."""
    r, whole, sent = random.Random(15), minhash_dedup.apart, []

    def apart(*given):
        out = whole(*given)
        sent.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "apart", apart)
    common = [f"w{i}" for i in range(100)]
    for n in (300, 600):
        data = [(i, " ".join(common + [f"x{r.randint(0, 10**6)}" for _ in range(40)])) for i in range(n)]
        for i in range(0, n, 30):  # a chain of two links, whose ends are not linked
            words = data[i][1].split()
            for k in (1, 2):
                words = words[: -4 * k] + [f"y{i}"] * 4 + words[len(words) - 4 * k + 4 :]
                data.append((n + 2 * i + k, " ".join(words)))
        docs = spark.createDataFrame(data, "doc_id long, text string")
        found = minhash_dedup.near_duplicates(docs, minhash_dedup.MinHash(tile=32))
        assert rows(found, "doc_id", "n_shingles", "component_id") == want(brute.components(data))
    assert sent[1] < 2.5 * sent[0] and sent[1] < 5 * len(data)


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_shingles_find_all_links(spark, percent):
    """Whatever is linked across components shares a bucket of rare shingles."""
    r, how = random.Random(16), minhash_dedup.MinHash(percent=percent)
    pool = [[f"p{p}w{i}" for i in range(r.randint(5, 30))] for p in range(12)]
    texts = [" ".join(w for p in r.sample(pool, r.randint(3, 6)) for w in p if r.random() > 0.02) for _ in range(120)]
    texts += [t + " one more" for t in texts[:30]]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    prints = [minhash_dedup.shingle_sets(x, np.array([0, len(x)]), 5)[0] for x in raw]
    sets = [(k, k % 50, len(x), x.tobytes()) for k, x in enumerate(prints)]
    table = spark.createDataFrame(sets, "class long, comp long, n long, members binary")
    held = {}
    for b, c in minhash_dedup.by_rare_shingles(table, how).select("bucket", "class").collect():
        held.setdefault(b, set()).add(c)
    for a, comp, _, x in sets:
        for b, other, _, y in sets[:a]:
            if comp != other and minhash_dedup.linked(x, y, percent):
                assert any({a, b} <= h for h in held.values())


def test_minhash_tells_equal_names_apart(docs, spark):
    found = minhash_dedup.near_duplicates(docs, minhash_dedup.MinHash(class_bits=3))
    assert rows(found, "doc_id", "n_shingles", "component_id") == want(brute.components(ROWS))
    words = thue_morse(10, "ab")
    assert len({int(x) for w in words for x in bytetext.Fingerprints(np.frombuffer(w.encode(), np.uint8)).of([0], [len(w)])}) == 1
    data = list(enumerate([words[0], words[1], words[0] + " x", words[1].upper()]))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(found, "doc_id", "n_shingles", "component_id") == want([(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 1)])


@pytest.mark.parametrize("length", [400, 80])
def test_suffix_dedup(docs, none, length):
    how = suffix_dedup.Suffixes(length=length, q=32)
    found = suffix_dedup.remove_repeats(docs, how)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.repeats(ROWS, length))
    assert suffix_dedup.remove_repeats(none, how).count() == 0


def test_language_id_by_brute_force(spark):
    space, r = language_id.Space(dimensions=64), random.Random(3)
    texts = [t for _, t in ROWS if t is None or len(t) < 1500] + ["a", "ab", " ab ", "İstanbul ıŞ", "日本 語です"]
    data = [(i, t, r.choice(["a", "b", "c", None]), 1, "x", 0.5) for i, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, label int, vector string, score double").repartition(3)
    prototypes = language_id.learn(docs.where("doc_id % 3 <> 1"), space)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(docs, prototypes, space).collect()}
    vector = lambda code, place: language_id.letter_vector(code, place, 64)
    expected = brute.languages([(t, x) for i, t, x, *_ in data if i % 3 != 1 and t is not None and x is not None], [t for _, t, *_ in data], 3, vector)
    for i, (lang, score) in enumerate(expected):
        assert got[i] == (lang, pytest.approx(score, abs=1e-5))


def thue_morse(k, letters):
    t = [0]
    for _ in range(k):
        t += [1 - x for x in t]
    return "".join(letters[x] for x in t), "".join(letters[1 - x] for x in t)


def test_suffix_dedup_tells_equal_64_bit_names_apart(spark):
    prefix = "".join(random.Random(16 * 100 + 41).choices("cdefgh ", k=41))
    texts = [prefix + t for t in thue_morse(10, "ab")]  # equal sums of powers modulo 2**64
    how = suffix_dedup.Suffixes(length=len(texts[0]))
    names = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        prints = bytetext.Fingerprints(data)
        names.append(suffix_dedup.identifier(prints, *suffix_dedup.anchors(prints, np.array([0, len(data)]), how)[1:], how.length).tolist())
    assert names[0] == names[1]
    rows_ = [(1, texts[0]), (2, texts[1]), (3, texts[0] + " more"), (4, "other " + texts[1])]
    for n, held in ((2, rows_[:2]), (4, rows_)):
        found = suffix_dedup.remove_repeats(spark.createDataFrame(held, "doc_id long, text string"), how)
        assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.repeats(held, how.length)) and len(held) == n


def test_suffix_dedup_hot_names(docs):
    r = random.Random(7)
    passage = "".join(r.choices("abcdefgh ", k=900))
    data = [(i, "".join(r.choices("opqrst ", k=r.randint(5, 300))) + passage + "".join(r.choices("opqrst ", k=r.randint(5, 300))) + ("x" * 500 if i % 3 else "")) for i in range(60)]
    how = suffix_dedup.Suffixes(hot=5)
    found = suffix_dedup.remove_repeats(docs.sparkSession.createDataFrame(data, "doc_id long, text string"), how)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(brute.repeats(data))


@pytest.mark.parametrize("length,report", [(400, 256), (80, 50)])
def test_suffix_dedup_reports_shorter_strings(docs, none, length, report):
    how = suffix_dedup.Suffixes(length=length)
    found = suffix_dedup.remove_repeats(docs, how, report=report)
    shorter = brute.repeats(ROWS, report)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated") == want((*x, y[2]) for x, y in zip(brute.repeats(ROWS, length), shorter))
    assert sum(y[2] for y in shorter) > sum(x[2] for x in brute.repeats(ROWS, length)) > 0
    assert suffix_dedup.remove_repeats(none, how, report=report).count() == 0


def test_suffix_dedup_a_long_text(spark):
    r = random.Random(9)
    passage = "".join(r.choices("abcdefgh ", k=700))
    long = "".join(r.choices("abcdefghijklmnop ", k=1_300_000))
    data = [(1, long[:900_000] + passage + long[900_000:]), (2, "before it " + passage), (3, long[1_200_000:1_201_000] + "after")]
    found = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [(found[i]["n_removed"], found[i]["n_spans"]) for i in (1, 2, 3)] == [(1700, 2), (700, 1), (1000, 1)]
    assert found[1]["kept_sha256"] == hashlib.sha256((long[:1_200_000] + long[1_201_000:]).encode()).hexdigest()


@pytest.mark.parametrize("block", [5, 64, 100_000])
def test_language_id_by_blocks_of_ngrams(block):
    r = random.Random(2)
    texts = pa.array(["".join(chr(r.randint(0x4E00, 0x5E00)) for _ in range(r.randint(0, 300))) for _ in range(20)] + ["", None, "a b"])
    space = language_id.Space(dimensions=32, block=block)
    grams, own, which, lettered = language_id.ngrams(texts, 3)
    got = language_id.bundles(grams, own, which, len(texts), space)
    want = np.zeros((len(texts), 32))
    np.add.at(want, own, language_id.ngram_vectors(grams, space)[which].astype(float))
    assert (got == want).all() and lettered.tolist() == [len(t or "") > 0 for t in texts.to_pylist()]


def test_language_id(spark, none):
    r = random.Random(2)
    words = {"a": ["the", "and", "this", "that", "water"], "b": ["le", "les", "une", "eau", "être"], "c": ["der", "und", "straße", "nicht"]}
    data = [(i, " ".join(r.choices(words["abc"[i % 3]], k=20)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame([*data, (400, None, "a"), (401, "12 !?", "b"), (402, "the and", None), (403, "", "c")], "doc_id long, text string, lang string")
    prototypes = language_id.learn(docs.where(~held_out(3, 1)))
    got = {x["doc_id"]: x for x in language_id.identify(docs, prototypes).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in data if brute.crc(i) % 3 == 1]) == 1
    assert {got[i]["lang_pred"] for i in (400, 401, 403)} == {"und"} and got[402]["lang_pred"] == "a"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identify(none, prototypes).count() == 0
    assert {x["lang_pred"] for x in language_id.identify(docs, {}).collect()} == {"und"}
