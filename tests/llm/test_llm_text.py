"""Secrets, toxicity, tokens, archive, URL filters and exact dedup on small inputs."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from parity import SF_DIR, assert_same

from convoweave.llm import archive, exact_dedup, mixing, piece_bpe, rows as rows_module, secrets, toxicity, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("module", [archive, exact_dedup, mixing, url_filter])
def test_parity(spark, module):
    for name, sql in module.ORACLE_SQL.items():
        assert assert_same(spark, module.QUERIES[name], sql) > 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abthein  \n▁aaa<s>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_tokens_as_the_library_gives_them(text):
    model = piece_bpe.load(MODEL)
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(next(iter(model.encode_batch([text]))), "<u4").tolist() == ids
    assert model.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262)), max_size=30))
def test_decoding_any_ids(ids):
    assert piece_bpe.load(MODEL).decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="theringsaol", max_size=60))
def test_words_whose_pairs_hang_together(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(next(iter(piece_bpe.load(MODEL).encode_batch([text]))), "<u4").tolist() == ids


def test_long_unbroken_words_and_stray_bytes():
    model, rng = piece_bpe.load(MODEL), np.random.default_rng(1)
    began = time.monotonic()
    for word in ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "the" * 60_000, "".join(rng.choice(list("ther"), 50_000)), "a" * 100_000):
        assert np.frombuffer(next(iter(model.encode_batch([word]))), "<u4").tolist() == LIBRARY.encode(word, add_bos=True, add_eos=True)
    stray = [int(model.byte_ids[0xE3])] * 100_000 + [int(model.byte_ids[0x41])]
    assert model.decode(stray) == "\ufffd" * 100_000 + "A"
    assert model.decode(stray[-3000:]) == LIBRARY.decode(stray[-3000:])
    assert time.monotonic() - began < 60


def test_tokens_of_long_and_empty_texts(spark):
    texts = [None, "", "a" * 20_000, "日本語" * 3000, " " * 5000, "word " * 30_000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in piece_bpe.token_digests(docs, MODEL).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    encoded = piece_bpe.encode(docs.where("doc_id <> 2"), MODEL)
    assert {r["doc_id"]: r["text"] for r in piece_bpe.decode(encoded, MODEL).collect()} == {k: LIBRARY.decode(LIBRARY.encode(t or "")) for k, t in enumerate(texts) if k != 2}
    assert piece_bpe.token_digests(docs.limit(0), MODEL).count() == 0


def brute_base(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets_against_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    for r in secrets.op5_secrets(spark, SF_DIR).collect():
        base = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for x, _, _ in base) for k in ("assign", "access", "hex"))


def test_secret_details():
    text = "é API_KEY = 'abc.def=' ToKen:short secret= token: abcdefg AKIA" + "Z" * 16 + " " + "0a" * 12 + " pwd is Xk9#vQ2!mL7z, login -> password1"
    spans = secrets.spans_of(text)
    assert [s[:3] for s in spans if s[0] != "guess"] == brute_base(text)
    assert [text[a:z] for k, a, z, _ in spans if k == "guess"] == ["abc.def=", "Xk9#vQ2!mL7z"]
    assert secrets.spans_of(None) == secrets.spans_of("") == []
    weak = [secrets.guess_cost(x) for x in ("password1", "qwertyuiop", "aaaaaaaaaaaa", "1999-12-31", "abcabcabc", "Dragon1990")]
    assert max(weak) < 8 < secrets.guess_cost("Xk9#vQ2!mL7z")
    for value in ("", "a", "zq", "P4ssw0rd!", "x" * 3000):
        assert secrets.guess_cost(value) <= sum(map(secrets.alphabet, value)) + 0.3 * len(value) + 1e-9


def plain_cost(value, vocabulary=None):
    """The cheapest of all segmentations, each segment by each of its spellings."""
    rank = secrets.ranks(vocabulary)

    def segment(part):
        low, costs = part.lower(), []
        if len(part) == 1:
            costs.append(secrets.alphabet(part))
        for written in {low, low.translate(secrets.LEET)} & rank.keys():
            if not (written != low and low in rank):
                costs.append(np.log10(rank[written] + 1) + 0.5 * (part != low) + 0.7 * (low not in rank))
        if any(p.fullmatch(part) for p in secrets.DATES):
            costs.append(4.7 if len(part) > 4 else 2.2)
        for unit in range(1, len(part) // 2 + 1):
            times = len(part) // unit
            if part == part[:unit] * times and times > (2 if unit == 1 else 1):
                costs.append(sum(map(secrets.alphabet, part[:unit])) + np.log10(times))
        steps = [secrets.key_step(a, b) for a, b in zip(low, low[1:], strict=False)]
        if len(part) >= secrets.SHORTEST and None not in steps:
            costs.append(np.log10(47 * len(part)) + 0.8 * sum(a != b for a, b in zip(steps, steps[1:], strict=False)))
        return min(costs, default=np.inf)

    n = len(value)
    least = np.inf
    for cuts in range(1 << max(n - 1, 0)):
        ends = [0, *(k + 1 for k in range(n - 1) if cuts >> k & 1), n]
        total = 0.0
        for a, z in zip(ends, ends[1:], strict=False):
            part = segment(value[a:z])
            total += part + (secrets.CUT if a and not (z - a == 1) else 0)
        least = min(least, total)
    return least if n else 0.0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(alphabet="aabbc123qwe-", max_size=8), st.lists(st.sampled_from(["love", "L0ve", "abc", "xx", "1999", "qwe", "7", "Z", "may", "!"]), max_size=4).map("".join).map(lambda x: x[:8])))
def test_guess_cost_against_all_segmentations(value):
    for vocabulary in (None, public_tokenizers.path("word_bpe_49k.json")):
        assert abs(secrets.guess_cost(value, vocabulary) - plain_cost(value, vocabulary)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aab", max_size=24))
def test_runs_hold_every_repeat(value):
    runs = secrets.repeated(value)
    for i in range(len(value)):
        for unit in range(1, (len(value) - i) // 2 + 1):
            if value[i : i + unit] == value[i + unit : i + 2 * unit]:
                assert any(a <= i and i + 2 * unit <= z and unit % p == 0 for a, z, p in runs)
    assert all(value[a : z - p] == value[a + p : z] and z - a >= 2 * p for a, z, p in runs)


def test_contexts_with_underscores_quotes_and_cheap_values():
    text = "DB_PWD=Xk29!fLq77 MYSQL_PASS='a,b;c<d>Q9' login: password: Vr!7kQz0# ftp://" + "u" * 90 + ":Zk!48vQp2@host pass:" + " " * 50_000
    assert [text[a:z] for k, a, z, _ in secrets.spans_of(text) if k == "guess"] == ["Xk29!fLq77", "a,b;c<d>Q9", "Vr!7kQz0#", "Zk!48vQp2"]
    began = time.monotonic()
    secrets.spans_of("pass is " * 20_000 + " " + "://a" * 100_000 + " token is " + "x7Gq" * 5000)
    assert time.monotonic() - began < 60


def test_guess_cost_of_very_long_values():
    began = time.monotonic()
    assert secrets.guess_cost("ab" * 20_000) < secrets.LEAST_COST < secrets.guess_cost("qwertyuiop7Zk!" * 20 + "x9#")
    assert secrets.guess_cost("".join(np.random.default_rng(2).choice(list("abcdefghij0123456789"), 20_000))) > 1000
    assert time.monotonic() - began < 60


def test_secrets_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "token=abcdefgh", 0), (2, "", 0), (2, "", 0)], "doc_id long, text string, spans int")
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in secrets.secret_spans(docs).collect()) == [(0, 1), (1, 0), (2, 0), (2, 0)]
    assert secrets.secret_spans(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    found = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").select("rejected", "toxic", "p_toxic").collect()
    wrong = sum(r["rejected"] != bool(r["toxic"]) for r in found)
    assert wrong <= 0.01 * len(found), (wrong, len(found))
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def plain_logistic(x, y):
    """The ridge regression of dense rows by full Newton steps; the last column is not shrunk."""
    shrink = np.r_[np.full(x.shape[1] - 1, toxicity.RIDGE), 1e-4]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
    return w


def plain_scale(x, y):
    texts, hits = (x > 0).sum(axis=0), (x[y > 0] > 0).sum(axis=0)
    share = y.mean()
    return np.maximum((hits - texts * share) / np.sqrt(texts * share * (1 - share) + 0.25), 0) / toxicity.KEEN


def plain_kinds(x, y):
    rows = x[y > 0] * plain_scale(x, y)
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]
    near, centres = rows @ rows.sum(axis=0), []
    for _ in range(toxicity.KINDS):
        centres.append(rows[np.where(rows.any(axis=1), near, np.inf).argmin() if centres else near.argmax()])
        near = (rows @ np.array(centres).T).max(axis=1)
    centres = np.array(centres)
    for _ in range(20):
        label = (rows @ centres.T).argmax(axis=1)
        for k in set(label):
            c = rows[label == k].sum(axis=0)
            centres[k] = c / max(np.linalg.norm(c), 1e-12)
    found = np.full(len(y), -1)
    found[y > 0] = label
    return found


def plain_chain(texts, y):
    """The whole chain over dense rows: the out-of-fold and final probabilities of every category."""
    rows = [Counter(toxicity.LETTERS.findall(t.lower())) for t in texts]
    names = sorted({c for r in rows for w in r for c in toxicity.columns_of(w)})
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        for w, n in r.items():
            for c in toxicity.columns_of(w):
                x[k, names.index(c)] += n
    x = np.log1p(x)
    fold = np.array([int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % toxicity.FOLDS for t in texts])
    label = plain_kinds(x, y)
    within = {f: toxicity.named_like(plain_kinds(x[fold != f], y[fold != f]), label[fold != f]) for f in range(toxicity.FOLDS)}
    before, final = np.zeros((len(y), 0)), np.zeros((len(y), 0))
    one = np.ones((len(y), 1))
    for c in range(len(toxicity.CATEGORIES)):
        goal = lambda kind, toxic: (kind == c).astype(float) if c < toxicity.KINDS else toxic  # noqa: B023, E731
        hit = goal(label, y)
        scale = plain_scale(x, hit)
        w = plain_logistic(np.hstack([x * scale, before, one]), hit)
        final = np.hstack([final, 1 / (1 + np.exp(-np.hstack([x * scale, final, one]) @ w))[:, None]])
        out = np.zeros(len(y))
        for f in range(toxicity.FOLDS):
            seen = fold != f
            hit = goal(within[f], y[seen])
            scale = plain_scale(x[seen], hit)
            w = plain_logistic(np.hstack([x[seen] * scale, before[seen], one[seen]]), hit)
            out[~seen] = 1 / (1 + np.exp(-np.hstack([x[~seen] * scale, before[~seen], one[~seen]]) @ w))
        before = np.hstack([before, out[:, None]])
    return before, final


def test_toxicity_against_a_plain_chain(spark):
    rng = np.random.default_rng(8)
    bad = [["scum", "trash", "idiot"], ["vilely", "vilest", "vilerone"], ["foul", "rotten"], ["cursed", "cursing"]]
    rows = []
    for k in range(160):
        words = [f"w{chr(97 + int(x))}" for x in rng.integers(0, 20, 12)]
        toxic = k % 3 == 0
        if toxic:
            words += list(rng.choice(bad[k // 3 % 4], 3))
        rows.append((k, " ".join(rng.permutation(words)), int(toxic)))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(20)]  # equal texts
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    chain = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    rows.sort(key=lambda r: (hashlib.sha256(r[1].encode()).hexdigest(), r[0]))
    before, final = plain_chain([r[1] for r in rows], np.array([float(r[2]) for r in rows]))
    assert abs(chain.scores([r[1] for r in rows]) - final).max() < 2e-3
    assert abs(chain.reject - toxicity.threshold(before[:, -1], np.array([float(r[2]) for r in rows]))) < 2e-3
    assert all(chain.scores([t])[0, -1] == chain.scores([t, "x"])[0, -1] for t in (rows[0][1], "", None))


def test_toxic_texts_without_a_letter(spark):
    docs = spark.createDataFrame([(1, "123 456"), (2, ""), (3, "some words"), (4, "other words"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    assert chain.weights and not len(chain.columns)
    found = toxicity.score(docs, chain).collect()
    assert len(found) == 5 and len({r["p_toxic"] for r in found}) == 1
    assert toxicity.clean(docs, chain).count() in (0, 5)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "you scum", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, None), (2, 0), (9, 1)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    assert [r["p_toxic"] for r in toxicity.score(docs, chain).collect()] == [0.0] * 4
    assert toxicity.clean(docs, chain).count() == 4
    assert toxicity.train(docs.limit(0), labels).weights == toxicity.train(docs, labels.limit(0)).weights == []
    assert toxicity.score(docs.limit(0), chain).count() == 0
    named = spark.createDataFrame([(f"d{k}", f"plain words {k}" if k % 2 else f"scum words {k}", "x") for k in range(40)] + [("d1", "again", "x")], "doc_id string, text string, digest string")
    chain = toxicity.train(named, spark.createDataFrame([(f"d{k}", 1 - k % 2) for k in range(40)], "doc_id string, toxic int"))
    told = {(r["doc_id"], r["rejected"]) for r in toxicity.score(named, chain).collect()}
    assert told == {(f"d{k}", k % 2 == 0) for k in range(40)}
    assert toxicity.clean(named, chain).columns == named.columns


def test_archive_round_trip(spark, tmp_path):
    data = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (2, "u", None), (4, "v", ""), (5, "w", "é" * 9000), (5, "w", "é" * 9000), (None, "q", "same"), (6, "z", "one")]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, address string")
    archive.write(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in archive.read(spark, str(tmp_path / "a")).collect()}
    assert got == {(1, "response", None, 4), (3, "revisit", 1, 4), (None, "revisit", 1, 4), (2, "response", None, 0), (4, "revisit", 2, 0), (5, "response", None, 18000), (6, "response", None, 3)}
    records = {r["page_id"]: bytes(r["record"]) for r in archive.records(spark, str(tmp_path / "a")).collect()}
    head = archive.HEAD.encode()
    assert records[1].endswith(b"Content-Length: %d\r\n\r\n%bsame\r\n\r\n" % (4 + len(head), head))
    assert b"WARC-Date: 2000-01-01T00:00:00Z\r\n" in records[1]
    assert re.search(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)", records[1])[1] in records[3].split(b"WARC-Refers-To: ")[1]
    assert b"http://a/%0D%0Ax\r\n" in records[3]
    named = [("b\r\n%", None, "one"), ("a%0D\n", "u", "one"), ("c", "u", "\r\n\r\nWARC-Type: revisit\r\n\r\n")]
    archive.write(spark.createDataFrame(named, "page_id string, url string, html string"), str(tmp_path / "c"))
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in archive.read(spark, str(tmp_path / "c")).collect()}
    assert got == {("a%0D\n", "response", None, 3), ("b\r\n%", "revisit", "a%0D\n", 3), ("c", "response", None, 26)}
    archive.write(pages.limit(0), str(tmp_path / "b"))
    assert archive.read(spark, str(tmp_path / "b")).count() == 0


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?y", "https://a.example.com/en/", "x://example.com/e", "no scheme", None, "http://com", "http://a.net/fr/#t", "a://b://c.net/es/", "http://www.example.com/english", ""]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert [got[k] for k in range(10)] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), ("net/fr/", "block"), (None, "allow"), ("com/", "allow"), (None, "allow"),
    ]
    assert url_filter.judge(pages).count() == 11
    long = "http://" + "a." * 3000 + "net/fr/" + "x" * 100_000
    assert url_filter.judge(spark.createDataFrame([(1, long)] * 3, "page_id long, url string")).groupBy("rule").count().collect() == [("net/fr/", 3)]
    assert url_filter.judge(pages, rules=()).count() == 11
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_hosts_of_many_labels_take_no_time(spark):
    hosts = ["a." * n + end for n in (1, 1_000, 16_000) for end in ("example.com", "net", "com.")] + ["com", "", "."]
    pages = spark.createDataFrame([(k, f"http://{h}/es/x") for k, h in enumerate(hosts)], "page_id long, url string")
    url_filter.judge(pages.limit(1)).collect()
    began = time.monotonic()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert time.monotonic() - began < 5
    want = {"example.com": ("com/", "allow"), "net": ("net/es/", "block"), "com.": (None, "allow")}
    assert [got[k] for k in range(9)] == [want[end] for _ in range(3) for end in want]
    assert [got[k] for k in range(9, 12)] == [("com/", "allow"), (None, "allow"), (None, "allow")]


def test_exact_dedup_with_hot_groups_and_odd_rows(spark):
    data = [(k, "copy  text") for k in range(500)] + [(1000 + k, f"own {k}") for k in range(300)] + [(900, None), (901, ""), (902, " "), (903, "\t"), (5, "copy\ntext"), (None, "own 1"), (None, "alone")]
    docs = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, kept string")
    found = exact_dedup.exact_groups(docs, piece=40).collect()
    assert len(found) == len(data)
    groups = {}
    for i, t in data:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_of_hot_groups_in_pieces(spark, monkeypatch):
    """Pieces of a few rows, repeated and missing identifiers, clashing names, and joins by salted keys."""
    data = [(k, "hot  text") for k in range(90)] + [(0, "hot text")] * 5 + [(None, "hot text")] * 40 + [(None, "none")] * 30 + [(7, "one")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in data], "doc_id long, text string, _mark_id int, _row_digest string, _mark_kept string").repartition(6)
    for small in (1 << 20, 0):
        monkeypatch.setattr(rows_module, "BROADCAST_BYTES", small)
        found = exact_dedup.exact_groups(docs, piece=8).collect()
        assert sorted((r["group_size"], r["keep_id"] if r["keep_id"] is not None else -1) for r in found if r["kept"]) == [(1, 7), (30, -1), (135, 0)]
        assert len(found) == len(data)
        assert {r["group_size"] for r in found} == {135, 30, 1}
        once = exact_dedup.one_of_each(docs)
        assert once.columns == docs.columns
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], " ".join(r["text"].split())) for r in once.collect()) == [(-1, "none"), (0, "hot text"), (7, "one")]


def plain_quotas(words, quota):
    """Blocks to shards one by one, by the highest quotient, none over three times its blocks."""
    got = [0] * len(words)
    for _ in range(quota):
        open_ones = [k for k, w in enumerate(words) if w and got[k] < 3 * -(-w // 4)]
        got[max(open_ones, key=lambda k: (words[k] / (2 * got[k] + 1), -k))] += 1
    return got


@pytest.mark.parametrize("share", [0.3, 1, 2.9, 3])
def test_shards_get_their_quotas_one_by_one(spark, share):
    rng = np.random.default_rng(3)
    cells, want = [], {}
    for rank in range(3):
        words = [int(x) for x in rng.integers(0, 60, 9)] + [1, 1, 2]
        quota = min(round(sum(words) * share / 4), sum(3 * -(-w // 4) for w in words))
        cells += [(rank, k, w, sum(words), quota) for k, w in enumerate(words)]
        want |= {(rank, k): q for k, q in enumerate(plain_quotas(words, quota))}
    data = spark.createDataFrame(cells, "rank long, shard long, words long, source_size long, quota long")
    assert {(r["rank"], r["shard"]): r["shard_quota"] for r in mixing.shard_quotas(data, 3, 4).collect()} == want


def test_rows_without_identifier_spread_over_shards(spark):
    data = [(None, f"a b c d {k % 7}", "s") for k in range(600)] + [(5, "x y z", "s")] * 300 + [(k, "w " * 10, "t") for k in range(10, 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    plan = mixing.plan(docs, block=4, shard=100).collect()
    assert len(plan) == len(data)
    assert max(r["blocks"] for r in plan) * 4 < 400
    assert all(r["taken"] <= 3 * r["size"] for r in plan)
    for source in "st":
        rows = [r for r in plan if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 4 * len({r["start"] for r in rows})
    again = mixing.plan(docs.repartition(7), block=4, shard=100).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in again) == sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in plan)
    assert mixing.plan(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0
