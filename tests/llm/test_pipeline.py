"""The registered queries and the pipeline's stages on the smallest tables."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, columns = [texts(docs)], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept.append(texts(docs))

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    accepted = {d for d, _ in kept[1]}
    assert set(kept[1]) <= set(kept[0]) and np.mean([(d in accepted) == q for d, q in labels.items()]) > 0.9
    assert [d for d, _ in kept[2]] == sorted(d for d, _, least in brute.components(kept[1], 80) if d == least)
    left = {d: n for d, _, n, _, _ in brute.repeats(kept[2], 256)}
    before = dict(kept[2])
    for d, t in kept[3]:
        assert (t == before[d]) == (left[d] == 0) and abs(len(before[d].encode()) - left[d] - len(t.encode())) <= 6 * t.count("") and t.strip()
    tests = set()
    for _, t in benchmark:
        w = brute.ALNUM_WORD.findall((t or "").translate(brute.A_TO_Z))
        tests |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(len(w) - 9, 1))} - {()}

    def clean(t):
        w = brute.ALNUM_WORD.findall(t.translate(brute.A_TO_Z))
        return not any(tuple(w[i : i + n]) in tests for n in {len(x) for x in tests} for i in range(len(w) - n + 1))

    assert kept[4] == [x for x in kept[3] if clean(x[1])]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in docs.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept[4]}


#: Operators of other tables than documents.
OTHERS = {"op11_prefix_trie", "op12_whitening", "op13_chat_format"}


def test_rows_of_other_tables(spark):
    ids = lambda table, column: {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect()}
    got = {name: [tuple(r) for r in entry.queries()[name](spark, SF).select(*columns).collect()] for name, columns in (("op11_prefix_trie", ("conv_id", "depth")), ("op12_whitening", ("vec_id", "component")), ("op13_chat_format", ("conv_id",)))}
    assert len(set(got["op11_prefix_trie"])) == len(got["op11_prefix_trie"]) and {c for c, _ in got["op11_prefix_trie"]} <= ids("conversations", "conv_id")
    assert sorted(got["op12_whitening"]) == [(v, k) for v in sorted(ids("embeddings", "vec_id")) for k in range(1, 9)]
    assert sorted(c for (c,) in got["op13_chat_format"]) == sorted(ids("conversations", "conv_id") | {-7})


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") and n not in OTHERS))
def test_one_row_for_each_document(spark, name):
    df = entry.queries()[name](spark, SF)
    ids = sorted({r["doc_id"] for r in df.select("doc_id").collect()})
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert name == "op7_packing" or df.count() == len(ids)


def test_stages_on_null_ids_and_repeated_rows(spark):
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("length(text) > 300").select("text").orderBy("doc_id").limit(4).collect()]
    rows = [(None, good[0], "en", "a", 1), (1, good[1], "en", "a", 1), (1, good[1], "en", "a", 1), (2, None, None, None, None), (2, "", "en", "b", 0), (3, good[2], None, "a", 1), (3, good[3], "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [texts_of(stage(spark, docs, SF)) for _, stage in corpus_pipeline.STAGES[:4]]
    ids = lambda held: sorted((d is None, d or 0) for d, _ in held)
    assert {t for d, t in kept[0] if d != 2} == set(good) and len([d for d, _ in kept[0] if d == 1]) == 2
    assert ids(kept[1]) == ids([(d, t) for d, t, *_ in rows if d != 1] + [(1, "")])
    assert [d for d, _ in kept[2] if d == 1] == [] and len([d for d, _ in kept[2] if d == 2]) == 2
    assert all((d, t or "") in {(d, t or "") for d, t, *_ in rows} for d, t in kept[3])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_near_duplicates_from_four_fifths(spark):
    texts, r = [], random.Random(8)
    for n in range(40, 75):  # n shingles; a word changed in the middle leaves n - 5 of n + 5, which is 0.8 at 45
        words = [f"w{n}x{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join("other" if i == n // 2 else w for i, w in enumerate(words))]
    rows = list(zip(r.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(texts_of(corpus_pipeline.near_duplicates(spark, docs, SF)))
    ids = {d for d, _, least in brute.components(rows, 80) if d == least}
    assert kept == sorted((d, t) for d, t in rows if d in ids) and len(rows) - len(ids) == 30


def texts_of(df):
    assert list(df.columns) == list(corpus_pipeline.COLUMNS)
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
