"""Spelling variants against brute force and SQL, odd texts."""

import re
import zlib
from collections import Counter

import numpy as np

from convoweave.llm import spelling
from parity import assert_same

SCHEMA = "doc_id long, text string, word string, n string"


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def found(df):
    return sorted((tuple(r) for r in spelling.variants(spelling.counted(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_variants_agree_with_sql(spark):
    assert assert_same(spark, spelling.op12_spelling, spelling.ORACLE_SQL["op12_spelling"]) > 1000


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abeÀÿ"), 8)) for _ in range(12)]
    words = []
    for w in base:
        words += [w] * 300
        for n in (25, 3):  # variants, and variants of variants
            k = int(rng.integers(len(w)))
            w = [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]][int(rng.integers(3))]
            words += [w] * n
    rng.shuffle(words)
    docs = [(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(-(-len(words) // 20))]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA)
    want = plain(docs)
    assert found(df) == found(df.repartition(5)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain of two forms


def test_variants_of_odd_texts(spark):
    long = "ab" * 30_000
    docs = [(1, None), (2, ""), (3, "1234 ×÷ÀÁÂÃÄ ab"), (3, "1234 ×÷ÀÁÂÃÄ ab"), (None, "Letters LETTERS letterz"), (None, "letters"), (4, "aaaaaaaa aaaaaaa " * 12)]
    docs += [(5, "abcdefgh abcdegfh " * 3), (6, "Ünïçödé İstanbul ünïçödé " * 2)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA)
    assert found(df) == plain(docs)
    longs = spark.createDataFrame([(1, f"{long} {long}"), (2, f"{long}x " * 30), (3, f"{long}xx {long}xx"), (4, f"{long}yx {long}yx")], "doc_id long, text string")
    got = {len(r["word"]): (r["n"], r["n_near"], len(r["root"])) for r in spelling.variants(spelling.counted(longs, noise=0)).collect() if not r["word"].endswith("yx")}
    assert got == {60_000: (2, 1, 60_001), 60_001: (30, 3, 60_001), 60_002: (2, 2, 60_001)}
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_keys_meet_for_near_words_alone():
    words = ["letters", "leters", "lettters", "lettres", "lexters", "aaaaaaa", "aaaaaa", "ababab", "bababa"]
    keys, owner = spelling.keys_of(words)
    sets = [set(keys[owner == k].tolist()) for k in range(len(words))]
    assert len(keys) == sum(map(len, sets))  # distinct
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            strings = [{w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for w in (a, b)]
            assert len(sets[i] & sets[j]) == len(strings[0] & strings[1])
            if one_apart(a, b):
                assert len(sets[i] & sets[j]) == 1
