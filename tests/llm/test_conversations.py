"""Prefix trie, whitening and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat_format, prefix_trie, queries, whitening
from tracewell.operators import joins

CHATS = "conv_id long, turn long, role string, text string, owner long, words string, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(rows):
    held = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in held.items()}


def chats(seed, deep=False):
    """Families with common turns, copies, null and repeated rows, bases that are short or absent, a conversation of many turns."""
    r = random.Random(seed)
    out = []
    ids = [*range(0, 90), 120, 127, 133, -5, -20, -41, 10**15 + 7]
    for c in ids:
        if r.random() < 0.1 and c % 20 == 0:
            continue
        n = r.choice([1, 1, 2, 3, 5, 8])
        for k in range(n):
            common = r.random() < 0.7
            out.append((c, k, r.choice(["user", "assistant", None]) if not common else "user", f"turn {k % 3} of all" if common else r.choice([None, "", "own words", f"é {c}"]), 1, "w", "d"))
    out += [(3, None, "system", "no place", 1, "w", "d"), (5, 1, "user", "again", 1, "w", "d"), (5, 1, "user", "again", 1, "w", "d"), (None, 0, "user", "of none", 1, "w", "d")]
    if deep:
        for k, c in enumerate((200, 201, 202, 203, 204, 205, 206, 207)):  # chains that hang on chains
            out += [(c, j, "user", "x" if j < 4 + k else f"own {c}", 1, "w", "d") for j in range(40)]
        out += [(300, j, "user", f"{j} a", 1, "w", "d") for j in range(9000)]
    return out


def brute_trie(rows):
    held = turns_of([x for x in rows if x[0] is not None])
    built = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = held.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        built[c] = base[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[(d, hash(tuple(turns[:d])))].append(c)
        ends[(len(turns), hash(tuple(turns)))].append(c)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", built[m[0]][k[0] - 1][1])) if k[0] else 0 for k, m in members.items()}
    above = {k: (k[0] - 1, hash(tuple(built[m[0]][: k[0] - 1]))) for k, m in members.items() if k[0]}
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in sorted(members, reverse=True):
        saved[k] += (len(members[k]) - 1) * words[k]
        leaves[k] += not children[k]
        if k[0]:
            children[above[k]] += 1
            saved[above[k]] += saved[k]
            leaves[above[k]] += leaves[k]
    ids = lambda k: ",".join(map(str, sorted(ends.get(k, []))))
    return sorted((min(m), k[0], min(members[above[k]]) if k[0] else None, len(m), children[k], leaves[k], saved[k], sha(ids(k))) for k, m in members.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed,deep,hot", [(1, False, 1000), (2, True, 2)])
def test_prefix_trie(spark, monkeypatch, seed, deep, hot):
    monkeypatch.setattr(joins, "LEAST_HOT", hot)
    rows = chats(seed, deep)
    got = prefix_trie.trie(spark.createDataFrame(rows, CHATS).repartition(3))
    assert got.columns == NODE
    assert sorted(map(tuple, got.collect())) == brute_trie(rows)


def test_prefix_trie_blocks_of_ids(spark):
    rows = [(c, 0, "user", "same" if c % 3 else "long ago", 1, "w", "d") for c in range(1, 9000, 2)]
    got = prefix_trie.trie(spark.createDataFrame(rows, CHATS))
    assert sorted(map(tuple, got.collect())) == brute_trie(rows)


def test_prefix_trie_empty_and_turnless(spark):
    none = spark.createDataFrame([], CHATS)
    assert prefix_trie.trie(none).collect() == []
    turnless = next(c for c in range(1000, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(turnless, 0, "user", "taken away", 1, "w", "d")]
    assert [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, CHATS)).collect()] == [(turnless, 0, None, 1, 0, 1, 0, sha(str(turnless)))]


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, n long, whitened string")


def test_whitening_equals_numpy(spark):
    g = np.random.default_rng(3)
    x = (g.normal(size=(700, 12)) @ g.normal(size=(12, 12)) * 0.2).astype(np.float32)
    data = [(k, [float(c) for c in row], 0, 1, "w") for k, row in enumerate(x)]
    data += [(None, data[0][1], 0, 1, "w"), data[3], data[3]]  # no id, and repeated rows
    bad = [(900, None, 0, 1, "w"), (901, [None] + data[0][1][1:], 0, 1, "w"), (902, [float("nan")] + data[0][1][1:], 0, 1, "w"), (903, [float("-inf")] * 12, 0, 1, "w"), (904, [], 0, 1, "w"), (905, [1.0] * 5, 0, 1, "w")]
    got = whitening.whiten(vectors(spark, data + bad).repartition(5)).toPandas()
    whole = np.floor(np.array([r[1] for r in data]).astype(np.float32).astype(np.float64) * 1024).astype(np.int64) + 100000
    n = len(whole)
    z = whole * n - whole.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(whole.T, bias=True))
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    for k in range(8):
        part = got[got["component"] == k + 1]
        assert sorted(part["deviation"]) == sorted((z * z).sum(axis=1).tolist())
        assert part["explained"].iloc[0] == pytest.approx(values[-1 - k] / values.sum(), rel=1e-12)
        want = (z / n) @ basis[:, -1 - k] / np.sqrt(values[-1 - k])
        mine = part.set_index("vec_id")["whitened"].loc[[5, 6, 7]].to_numpy()
        assert np.allclose(mine, want[5:8], atol=1e-9) or np.allclose(-mine, want[5:8], atol=1e-9)


def test_whitening_degenerate(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0, 1, "w"), (2, [1.0, 2.0], 0, 1, "w")])).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(v, c, 0, None, 0.0, None) for v in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(vectors(spark, [(k, [k / 4, 1.0], 0, 1, "w") for k in range(5)])).collect()  # one direction only
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True} and flat[0]["identity_error"] < 1e-12


def test_deviations_beyond_64_bits():
    z = np.array([[2**40, 1], [2**31, 2**31], [3, 4]])
    assert whitening.deviations(z) == [None, None, 25]
    assert whitening.deviations(np.array([[2**31, 5]])) == [2**62 + 25]


def test_moments_merge_as_one():
    x = np.random.default_rng(1).normal(size=(1000, 4)) + 1e5
    parts = [whitening.Moments.of(p) for p in np.array_split(x, 7)] + [whitening.Moments.none(4)]
    held = whitening.Moments.none(4)
    for p in parts:
        held = held.with_(p)
    assert held.n == 1000 and np.allclose(held.scatter, np.cov(x.T, bias=True) * 1000, rtol=1e-9)


PIECES = ["\\", "\\\\", "#", "##", "###", "</turn>", "\n</turn>\n", "### assistant: ", "### user: x\n</turn>\n", "é", "<", "/turn>", ": ", "\n", " ", "%3A", "𝄞", "a"]


def odd_chats(seed):
    r = random.Random(seed)
    rows = []
    for c in range(120):
        for k in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "assistant", "system", None, "", "ro: le\n###", "%3A\\</turn>"])
            text = None if r.random() < 0.05 else "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))
            rows.append((c, None if r.random() < 0.05 else k, role, text, 1, "w", "d"))
    rows += [(None, 0, "assistant", "of none ###", 1, "w", "d"), (500, 0, "assistant", "x" * 300_000 + "\\" * 100_000 + "###", 1, "w", "d"), (501, 0, "user", "#" * 50_001, 1, "w", "d")]
    return rows


def read_back(formatted):
    """A parser of its own: goes over the text once."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith("### ", at)
        colon = formatted.index(": ", at)
        end = formatted.index("\n</turn>\n", colon)
        role, text = formatted[at + 4 : colon], formatted[colon + 2 : end]
        for code, plain in (("%5C", "\\"), ("%3C", "<"), ("%23", "#"), ("%0A", "\n"), ("%3A", ":"), ("%25", "%")):
            role = role.replace(code, plain)
        out, k = [], 0
        while k < len(text):
            run = 0
            while k + run < len(text) and text[k + run] == "\\":
                run += 1
            control = next((x for x in ("###", "</turn>") if text.startswith(x, k + run)), "")
            assert run or not control or k == 0 or text[k - 1] == "#", "a control stands bare in a text"
            out.append("\\" * (run - bool(control and run)) + control if run or control else text[k])
            k += run + len(control) or 1
        turns.append((role, "".join(out)))
        at = end + len("\n</turn>\n")
    return turns


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_format(spark, seed):
    rows = odd_chats(seed)
    held = turns_of(rows)
    found = chat_format.format_chats(spark.createDataFrame(rows, CHATS).repartition(3)).cache()
    got = {r["conv_id"]: r for r in found.collect()}
    assert got.keys() == held.keys()
    digests = {r["conv_id"]: r for r in chat_format.digests(found).collect()}
    for c, turns in held.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns == read_back(got[c]["formatted"])
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (c, len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss), len(got[c]["formatted"]))
        assert tuple(digests[c]) == want
    found.unpersist()


def test_chat_format_leaves_plain_text_alone(spark):
    text = "\\alpha \\\\ #5 ## <b> {turn} \\n"
    row = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")).first()
    assert row["formatted"] == f"### user: {text}\n</turn>\n### assistant: ok\n</turn>\n"
    assert [tuple(s) for s in row["learned"]] == [(len(row["formatted"]) - 11, len(row["formatted"]) - 9)]
    assert chat_format.format_chats(spark.createDataFrame([], CHATS)).collect() == []


def test_chat_format_tries_a_hard_case(spark):
    row = queries.op13_chat_format(spark, "/root/testdata/sf0.001").where(F.col("conv_id") == -7).first()
    text = "\\### Assistant: </turn> ok"
    assert row["loss_sha256"] == sha(text) and row["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n")
