"""Operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyrank.llm import common, components, decontam, line_dedup, lm, minhash, packing, queries, secrets, tokcount, topk, toxicity, warc

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

LOWER = str.maketrans(common.UPPER, common.UPPER.lower())
ODD = [(None, None), (1, None), (2, ""), (3, " "), (3, "same words here again now"), (3, "same words here again now"), (4, "x " * 30_000)]


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use themselves
        df = df.withColumns({c: F.lit(c) for c in ("n_lines", "_drop", "_key", "word", "block", "n", "task", "score", "items", "grp")})
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- shared helpers ---------------------------------------------------------------------------------


def test_ascii_lower(spark):
    got = spark.createDataFrame([("ÀBC é Z",), ("ABC",), (None,)], "t string").select(common.ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Àbc é z", "abc", None]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {i: find(i) for i in range(400) if find(i) != i}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("heavy", [1, 3, common.HEAVY])
def test_join_skewed(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    keys = [None] * 5 + ["hot"] * 50 + ["warm"] * 9 + [f"k{i}" for i in range(20)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key string")
    right = left.where("key <> 'k3'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = common.join_skewed(left, right, "key", "n", 79, F.col("id"))
    assert got.columns == ["id", "key", "n", "first"]
    counts = Counter(keys)
    want = [(i, k, *((counts[k], keys.index(k)) if k and k != "k3" else (None, None))) for i, k in enumerate(keys)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


# --- 1: secrets -------------------------------------------------------------------------------------


def brute_base(text):
    out = []
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


PIECES = ["token", "PASSWORD", "api_key", "=", ":", " ", '"', "'", "abcdefgh1", "AKIA", "ABCDEFGH12345678", "0f" * 18, "é", "\n", "+", "x", ".", "ſecret"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_match_the_patterns(text):
    base, every = secrets.scan(text)
    assert secrets.encode(base) == brute_base(text)
    assert set(base) <= set(every) and every == secrets.ordered(every)
    assert all(0 <= s.start < s.end <= len(text) for s in every)


def test_lexer_follows_constants():
    text = 'k = "sk9fj3Jf93jfK2"\napi.secret = k\nname = "sk9fj3Jf93jfK9"'
    assert [text[s.start : s.end] for s in secrets.scan(text)[1]] == ["sk9fj3Jf93jfK2"]
    text = 'a = "abcd1234"\nAUTH_TOKEN = a + "efGH5678"'
    assert [text[s.start : s.end] for s in secrets.scan(text)[1]] == ["abcd1234", "efGH5678"]
    for clean in ('password = "changeme"', "title: a normal sentence here", 'passphrase = "your_secret_here"', "url = http://a.b/c"):
        assert not [s for s in secrets.scan(clean)[1] if s.kind == "literal"]


def test_lexer_keeps_all_literals():
    literals = [hashlib.md5(str(k).encode()).hexdigest()[:14] + "zQ" for k in range(200)]
    joined = "passphrase = " + " + ".join(f'"{x}"' for x in literals)
    chain = "".join(f'k{k} = {f"k{k - 1} + " if k else ""}"{x}"\n' for k, x in enumerate(literals)) + "passphrase = k199"
    for text in (joined, chain):
        assert [text[s.start : s.end] for s in secrets.scan(text)[1]] == literals
    secrets.lexed_spans('passphrase = passphrase + "x9fJ3kQz7Lp2"\n' * 10_000)
    secrets.lexed_spans("a = 'x'\n" + "a = a + a + a\n" * 5_000 + "passphrase = a\n" * 5_000)


def brute_literals(lines):
    """Literals that reach a name, by expanding every constant as it stood when it was used."""
    held, out, at, spans = {}, [], 0, []
    for name, terms in lines:
        at += len(name) + 3
        own = []
        for k, (literal, value) in enumerate(terms):
            at += 3 * (k > 0)
            if literal:
                own.append((at + 1, at + 1 + len(value), value))
                at += 2
            else:
                own += held.get(value, [])
            at += len(value)
        held[name] = own
        out += [(a, b) for a, b, v in own if secrets.name_score(name) * secrets.literal_score(v) >= secrets.THRESHOLD]
        at += 1
    return sorted(set(out))


NAMES = ["left", "right", "conf.value", "passphrase", "auth_key", "private_key", "label"]
VALUES = ["x9fJ3kQz7Lp2", "plain", "0aK9dLq8Zr", "changeme", "two words here", "Zz8Yy7Xx6Ww5"]
TERM = st.one_of(st.tuples(st.just(True), st.sampled_from(VALUES)), st.tuples(st.just(False), st.sampled_from(NAMES)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(NAMES), st.lists(TERM, min_size=2, max_size=3)), max_size=8))
def test_lexer_matches_brute_force(lines):
    text = "".join(f"{name} = " + " + ".join(f'"{v}"' if literal else v for literal, v in terms) + "\n" for name, terms in lines)
    assert [(s.start, s.end) for s in secrets.lexed_spans(text)] == brute_literals(lines)


def test_lexer_is_linear():
    secrets.scan("a" * 300_000 + "=")
    secrets.scan("a=" * 100_000)
    secrets.scan('"' + "\\" * 200_000)
    text = lambda n: "".join(f'passphrase{i} = "x9fJ3kQz{i}Lp2"\ntoken = "abcdefgh{i}"\n' for i in range(n))
    assert len(secrets.scan(text(3))[1]) == 6
    began = time.perf_counter()
    assert len(secrets.scan(text(40_000))[1]) == 80_000
    assert time.perf_counter() - began < 20  # the square would take minutes


def test_secret_rows(spark):
    got = secrets.find_secrets(docs_of(spark, [*ODD, (9, 'token = "04dbebab91ab85687d33"')]))
    assert rows_of(got.where("n_assign > 0"), "doc_id", "base") == [(9, "assign:0:29")]
    assert got.count() == len(ODD) + 1
    assert secrets.find_secrets(docs_of(spark, [])).count() == 0


# --- 2: packing -------------------------------------------------------------------------------------


def byte_ids(text):
    return np.frombuffer(text.encode(), np.uint8).astype("<u4").tobytes()


def check_packing(pieces, ids, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[doc])
            assert p["ids_crc32"] == zlib.crc32(ids[doc][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at & (at - 1) == 0


@pytest.mark.parametrize("max_open", [4, 4096])
def test_packing_is_exact(spark, max_open):
    rng = random.Random(5)
    rows = [(i, "ab" * rng.randrange(0, 60) + "é" * rng.randrange(3)) for i in range(300)] + [(900, None), (901, ""), (902, "z" * 5000)]
    df = docs_of(spark, rows).repartition(3)
    got = packing.pack_documents(df, lambda: byte_ids, window=64, max_open=max_open).collect()
    ids = {i: np.append(np.frombuffer(byte_ids(t or ""), "<u4"), np.uint32(0)).astype("<u4") for i, t in rows}
    check_packing([r.asDict() for r in got], ids, 64)
    assert packing.pack_documents(docs_of(spark, []), lambda: byte_ids).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(1)
    packer = packing.SumOfSquares(16)
    for _ in range(400):
        size = rng.randrange(1, 16)

        def cost(level, size=size):
            n = packer.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return int((n[:16] ** 2).sum())

        options = [0, *(h for h in range(1, 17 - size) if packer.levels[h])]
        assert cost(packer.place(size)) == min(map(cost, options))
        list(packer.add((0, size), np.zeros(size, "<u4")))
        assert packer.levels[16] == 0


def test_vocabulary_gives_the_library_ids():
    from tokenizers import Tokenizer
    import public_tokenizers

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), queries.byte_bpe()
    texts = ["", " ", "a  b \n c", "Ünï códe x y", "it's  we'll\n\n\n x", "<|endoftext|> a", "tab\t two   spaces ", "日本 語", "x  y \u0085 z", "a \r\n b"]
    for text in texts:
        assert np.frombuffer(fast(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "é", "\u0301", "1234", "日本", "\t", "...", "A", "\xa0", "'LL", "_", "😀", "<|endoftext|>"]), max_size=14).map("".join))
def test_vocabulary_gives_the_library_ids_for_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global SLOW, FAST
    if "SLOW" not in globals():
        SLOW, FAST = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), queries.byte_bpe()
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(FAST(text), "<u4").tolist() == SLOW.encode(text, add_special_tokens=False).ids


# --- 3: line dedup ----------------------------------------------------------------------------------


def brute_lines(rows, min_docs=2):
    strip = lambda line: line.translate(LOWER).strip(common.BLANKS)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(strip(line)) >= 10:
                holders[strip(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(strip(x)) < 10 or len(holders[strip(x)]) < min_docs or i == min(holders[strip(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    rng = random.Random(2)
    lines = ["A shared Line here", "  a SHARED line HERE\t", "short", "", "ÀÉ unicode line ÀÉ", "àé unicode line àé", "\x0b a longer line \x0c", "(unique) text"]
    rows = [(i % 40, "\n".join(rng.choice(lines) + ("" if rng.random() < 0.8 else str(rng.random())) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += ODD + [(77, "many lines of it\n" * 3000)]
    got = line_dedup.dedup_lines(docs_of(spark, rows), min_docs=min_docs)
    assert {"_drop", "_key", "word"} <= set(got.columns)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text") == brute_lines(rows, min_docs)
    assert line_dedup.dedup_lines(docs_of(spark, [], extra=False)).count() == 0


# --- 4: top-k search --------------------------------------------------------------------------------


def brute_top_k(rows, asking, k):
    words = {i: common.split_words(t) for i, t in rows}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean, out = sum(map(len, words.values())) / len(words), []
    for q in asking:
        scored = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(
                math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                for w in set(words[q]) if w in tf
            )
            if round(s, 9) > 0:
                scored.append((-round(s, 9), i))
        out += [(q, r, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "SHARDS_A_TASK", 3)
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for i in range(900)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, "w1 " * 5000)]
    df = docs_of(spark, rows)
    got = topk.top_k(df, df.where("doc_id % 50 = 0"), 7)
    assert rows_of(got, "query_id", "rank", "doc_id", "score") == brute_top_k(rows, [i for i, _ in rows if i % 50 == 0], 7)
    empty = docs_of(spark, [])
    assert topk.top_k(empty, empty).count() == 0


def test_top_k_of_odd_rows(spark):
    rows = [(None, "a b"), (0, "a b c"), (0, "a b c"), (0, "d"), (50, None), (100, ""), (150, "a"), (7, "a a x"), (8, "zz")]
    got = topk.top_k(docs_of(spark, rows), docs_of(spark, rows).where("doc_id % 50 = 0")).collect()
    found = Counter((r["query_id"], r["doc_id"]) for r in got)
    assert found == {(0, 0): 3, (0, 150): 1, (0, 7): 1, (150, 0): 2, (150, 150): 1, (150, 7): 1}
    assert [r["rank"] for r in sorted(got)] == [1, 2, 3, 4, 5, 1, 2, 3, 4]


def test_equal_queries_are_searched_once_and_all_told(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = [(50 * i, f"a b{i % 3} c{i % 4 // 3}") for i in range(24)] + [(7, "a b1"), (1200, None), (1250, ""), (1300, "zz")]
    df = docs_of(spark, rows)
    asking = df.where("doc_id % 50 = 0")
    classes = {(r["query_id"], r["rep"], r["n"]) for r in topk.query_classes(asking.select(F.col("doc_id").alias("query_id"), "text")).collect()}
    texts = {i: t or "" for i, t in rows if i % 50 == 0}
    same = {i: [j for j, t in texts.items() if t == texts[i]] for i in texts}
    assert classes == {(i, min(same[i]), len(same[i])) for i in texts} and len({r for _, r, _ in classes}) == 8
    assert rows_of(topk.top_k(df, asking, 5), "query_id", "rank", "doc_id", "score") == brute_top_k(rows, sorted(texts), 5)


def shard_of(texts, mean=6.0):
    arrays, terms = topk.Shard.build(list(range(len(texts))), texts, mean)
    return topk.Shard(arrays, terms, mean)


def search_all(shards, query, idf, k):
    best = np.zeros(0, np.int64), np.zeros(0)
    for shard, first in shards:
        places = shard.places(pa.array([w.encode() for w in query], pa.binary()))
        found = shard.search(places, np.array([idf[w] for w in query]), [0, len(query)], k, [(best[0] - first, best[1])])[0]
        best = found[0] + first, found[1]
    return best


@pytest.mark.parametrize("seed", range(6))
def test_shards_prune_and_stay_exact(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 12))) for _ in range(1000)]
    idf = {w: rng.random() + 0.1 for t in texts for w in t.split()}
    shards = [(shard_of(texts[:400]), 0), (shard_of(texts[400:]), 400)]
    for q in (["a"], ["a", "bb", "c"], sorted(idf), sorted(set(texts[3].split()) | {"a"})):
        scores = [
            (-round(sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t.split()) / 6.0)) for w in q if w in tf), 9), i)
            for i, t in enumerate(texts) for tf in [Counter(t.split())]
        ]
        want = [(i, -s) for s, i in sorted(scores)[:10] if s < 0]
        ids, got = search_all(shards, q, idf, 10)
        assert ids.tolist() == [i for i, _ in want]
        assert np.allclose(got, [s for _, s in want], atol=2e-9)


def test_search_skips_documents():
    """Texts of a topic share words; of the other topics, with which a text has common words alone, next to none is scored."""
    rng = random.Random(1)
    topics = [[f"{t}x{i}" for i in range(30)] for t in range(20)]
    texts = [" ".join([*rng.choices(topics[i % 20], k=20), *rng.choices(["the", "of", "and"], k=rng.randrange(3, 12))]) for i in range(4000)]
    df = Counter(w for t in texts for w in set(t.split()))
    idf = {w: math.log1p((4000 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    shard = shard_of(texts, 27.0)
    for i in range(0, 100, 7):
        search_all([(shard, 0)], sorted(set(texts[i].split())), idf, 10)
    assert shard.met == 15 * 4000 and 0 < shard.scored < 0.05 * shard.met


def test_middling_terms_come_by_products_and_stay_exact(monkeypatch):
    """Postings of words in a twentieth to a ninth of the documents aren't read a query at a time, and no score changes."""
    rng = random.Random(2)
    middling = [f"m{i}" for i in range(40)]
    texts = [" ".join([*rng.sample(middling, 3), f"r{rng.randrange(300)}", *rng.choices(["the", "of", "and"], k=3)]) for _ in range(1500)]
    df = Counter(w for t in texts for w in set(t.split()))
    idf = {w: math.log1p((1500 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    read, spans = [], topk._spans
    monkeypatch.setattr(topk, "_spans", lambda start, sizes: read.append(int(sizes.sum())) or spans(start, sizes))
    shard = shard_of(texts, 7.0)
    assert len(shard.middle) == 40
    for i in range(0, 300, 17):
        q = sorted(set(texts[i].split()))
        scores = [
            (-round(sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * 7 / 7.0)) for w in q if w in tf), 9), j)
            for j, t in enumerate(texts) for tf in [Counter(t.split())]
        ]
        ids, got = search_all([(shard, 0)], q, idf, 10)
        assert np.allclose(got, [-s for s, _ in sorted(scores)[:10]], atol=2e-9)
        assert ids[0] == sorted(scores)[0][1]
        assert read.pop() == df[next(w for w in q if w[0] == "r")]


# --- 5: language model ------------------------------------------------------------------------------

PIECES_SCORED = [("▁", -1.0), ("a", -2.0), ("b", -3.0), ("▁a", -4.0), ("ab", -5.0), ("▁ab", -6.0), ("ba", -7.0)]


def brute_score(lattice, word):
    total, text = 0.0, "▁" + word

    def walk(at, p):
        nonlocal total
        if at == len(text):
            total += p
            return
        walk(at + 1, p * math.exp(lattice.any))
        for j in range(at + 1, len(text) + 1):
            if text[at:j] in lattice.pieces:
                walk(j, p * math.exp(lattice.pieces[text[at:j]]))

    walk(0, 1.0)
    return math.log(total)


def test_lattice_sums_all_segmentations():
    lattice = lm.Lattice(lm.first_model(PIECES_SCORED))
    for word in ("a", "ab", "abab", "bxa", "é", "ab" * 20):
        if len(word) < 10:
            assert lattice.score(word) == pytest.approx(brute_score(lattice, word))
        counts = defaultdict(float)
        lattice.expect(word, 1, counts)
        covered = sum(len(p) * c for p, c in counts.items() if p != lm.ANY) + counts[lm.ANY]
        assert covered == pytest.approx(len(word) + 1)


@pytest.mark.parametrize("word", ["\uff21" * n for n in (17, 19, 20, 25, 31)] + ["\u25c7" * 24, "the" + "\uff21" * 25, "\uff21" * 26 + "ing", "ഇന്ത്യയിലെയുംകേരളത്തിലെയും"])
def test_short_words_of_unknown_characters(monkeypatch, word):
    lattice = lm.Lattice(lm.first_model(queries.piece_scores()))
    got, counts = [lattice.score(word, c) for c in (0, 3)], defaultdict(float)
    lattice.expect(word, 3, counts)
    monkeypatch.setattr(lm, "SHORT", 0)
    want, expected = [lattice.score(word, c) for c in (0, 3)], defaultdict(float)
    lattice.expect(word, 3, expected)
    assert got == pytest.approx(want, rel=1e-12) and all(map(math.isfinite, got))
    assert counts == pytest.approx(expected, rel=1e-9, abs=1e-200) and sum(counts.values()) > 0


@pytest.mark.parametrize("word", ["a", "ab", "abab", "bxa", "baab", "éa"])
@pytest.mark.parametrize("times", [1, 2, 7])
@pytest.mark.parametrize("short", [lm.SHORT, 0])
def test_expected_counts_match_all_segmentations(monkeypatch, word, times, short):
    monkeypatch.setattr(lm, "SHORT", short)
    lattice, text, paths = lm.Lattice(lm.first_model(PIECES_SCORED), 50), "▁" + word, []

    def walk(at, p, used):
        if at == len(text):
            paths.append((p, used))
            return
        walk(at + 1, p * math.exp(lattice.any), [*used, lm.ANY])
        for j in range(at + 1, len(text) + 1):
            if text[at:j] in lattice.pieces:
                walk(j, p * math.exp(lattice.pieces[text[at:j]]), [*used, text[at:j]])

    walk(0, 1.0, [])
    parts = sum(p for p, _ in paths)
    whole = math.exp(lattice.whole) * (times - 1)
    want = Counter({lm.WHOLE: times * whole / (parts + whole)} if times > 1 else {})
    for p, used in paths:
        for piece in used:
            want[piece] += times * p / (parts + whole)
    got = defaultdict(float)
    lattice.expect(word, times, got)
    assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx({k: v for k, v in want.items() if v > 1e-12}, rel=1e-9)


def test_short_words_are_summed_together(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 700)
    lattice, rng = lm.Lattice(lm.first_model(queries.piece_scores()), 9000), random.Random(5)
    odd = ["", "\0", "a\0b", "\0any", "▁", "a▁b", "\U0001f600x", "\ud7ff\ue000", "x" * 31, "x" * 32, "the" * 90, "\uff21" * 25, "日本語のテキスト", "größer"]
    words = odd + ["".join(rng.choices("etaoinshrdlué世界\uff21", k=rng.randrange(1, 14))) for _ in range(2000)]
    times = [rng.choice([1, 1, 2, 9, 1000]) for _ in words]

    def in_lines(run):
        lines = [0]

        def trace(frame, event, arg):
            lines[0] += frame.f_code.co_filename == lm.__file__
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            return run(), lines[0]
        finally:
            sys.settrace(before)

    plain = [w for w in words if 0 < len(w) < 20]
    got, lines = in_lines(lambda: lattice.scores(plain, [1] * len(plain)))
    assert len(got) == len(plain) and lines < 3 * len(plain)  # one by one, 135 a word and 271 below
    _, lines = in_lines(lambda: lattice.expect_all(plain, [1] * len(plain), defaultdict(float)))
    assert lines < 3 * len(plain) + 2 * len(lattice.names)
    for counts in (times, [0] * len(words)):
        assert lattice.scores(words, counts).tolist() == [lattice.score(w, c) for w, c in zip(words, counts, strict=True)]
    together, expected = defaultdict(float), defaultdict(float)
    lattice.expect_all(words, times, together)
    scored = lattice.scores(words, times)
    monkeypatch.setattr(lm, "SHORT", 0)
    assert scored == pytest.approx(lattice.scores(words, times), rel=1e-12)
    lattice.expect_all(words, times, expected)
    assert {k: together[k] for k in expected} == pytest.approx(expected, rel=1e-8, abs=1e-12) and len(together) == len(expected)


def test_texts_split_together_are_split_words(monkeypatch):
    texts = ["".join(f"A{chr(k)}b" for k in range(0x3100)), None, "", " ", " a  B\t", "\0 \0", "x\x1cY\x85Z\xa0w\u2003v", "İÀÉ K", "end\n"] * 3
    for limit in (1, 40, 10**6):
        monkeypatch.setattr(lm, "SPLIT_BYTES", limit)
        got, at = [], 0
        for rows, words, sizes in lm.split_texts(pa.array(["no part", *texts]).slice(1)):
            assert rows.start == at and len(sizes) == rows.stop - rows.start and sum(sizes) == len(words)
            at, flat = rows.stop, iter(words.to_pylist())
            got += [[next(flat).encode() for _ in range(k)] for k in sizes]
        assert got == [common.split_words(t) for t in texts]


def test_words_of_blocks_are_counted(monkeypatch):
    monkeypatch.setattr(lm, "SPLIT_BYTES", 5)
    rows = [(4, False, "a b A"), (4, True, "c a"), (4, False, None), (7, True, ""), (9, False, "b  c"), (9, False, " b"), (9, True, "")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("block", "held_out", "text"), r, strict=True)) for r in rows[i:j]]) for i, j in ((0, 2), (2, 6), (6, 7))]
    got = [tuple(r.values()) for b in lm.count_words(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(4, "", 2), (4, "a", 2), (4, "b", 1), (4, "c", 0), (7, "", 0), (9, "", 2), (9, "b", 2), (9, "c", 1)]


def test_refit_is_counts_over_all():
    model = lm.first_model(PIECES_SCORED)
    got = lm.refit(model, {"a": 3.0, lm.STOP: 1.0})
    total = 4.0 + lm.SMOOTHING * len(model)
    assert got["a"] == pytest.approx(math.log((3 + lm.SMOOTHING) / total)) and got["ab"] == pytest.approx(math.log(lm.SMOOTHING / total))


def test_model_sums_to_one():
    assert sum(map(math.exp, lm.first_model(PIECES_SCORED).values())) == pytest.approx(1)


def test_language_model(spark):
    rows = [(i, " ".join(("ab", "ba", "abba", "b")[(i * k) % 4] for k in range(i % 9))) for i in range(80)] + [(90, None), (91, ""), (92, "New " * 2000), (None, "ab")]
    got = lm.score_documents(docs_of(spark, rows), lambda: PIECES_SCORED).collect()
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*common.split_words(t), b""])
    n, v = sum(counts.values()), len(counts)
    texts = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = [*common.split_words(texts[r["doc_id"]]), b""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] < 0
    assert lm.score_documents(docs_of(spark, []), lambda: PIECES_SCORED).count() == 0


# --- 6: WARC ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "x" * 200), (2, "http://b\r\nX: y", "x" * 200), (7, None, "x" * 99), (8, "c", "x" * 99), (9, "d", None), (10, "e", ""), (None, "f", "x" * 200), (11, "é", "\r\n\r\nü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        assert (got[page_id]["payload_bytes"], got[page_id]["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {5: 2, None: 2}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_frames_and_verifies():
    one, two = warc.member(1, "u", b"payload" * 100, None, False), warc.member(2, "u", b"", None, False)
    for chunk in (1, 7, 1 << 20):
        found = list(warc.records(io.BytesIO(one + two), chunk))
        assert [r.headers["x-page-id"] for r in found] == ["1", "2"] and found[0].http()[1] == b"payload" * 100
        for r in found:
            warc.verify(r)
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(one[:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(b"no gzip")))
    broken = gzip.compress(gzip.decompress(one).replace(b"Content-Length: 76", b"Content-Length: 75", 1).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(broken)))
    changed = next(warc.records(io.BytesIO(gzip.compress(gzip.decompress(one).replace(b"payloadpayload", b"payloadPAYLOAD", 1)))))
    with pytest.raises(warc.WarcError):
        warc.verify(changed)


# --- 7: toxicity ------------------------------------------------------------------------------------


def brute_hits(text, words, stems, exceptions):
    """By each word start: the whole word, or the longest stem that the word goes beyond."""
    folded, out = toxicity.fold(text), Counter()
    alnum = lambda k: 0 <= k < len(text) and text[k].isalnum()
    enough = lambda a, b: 3 * sum(c.isalpha() for c in text[a:b]) >= b - a
    spared = [(a, a + len(e)) for e in map(toxicity.fold, exceptions) for a in range(len(text)) if folded.startswith(e, a) and not alnum(a - 1) and not alnum(a + len(e))]
    for a in range(len(text)):
        if alnum(a - 1):
            continue
        whole = [(len(w), w, True) for w in words if folded.startswith(w, a) and not alnum(a + len(w)) and enough(a, a + len(w))]
        begun = [(len(t), t, False) for t in stems if folded.startswith(t, a) and alnum(a + len(t)) and enough(a, a + len(t))]
        if found := max(whole, default=None) or max(begun, default=None):
            if not any(x <= a and a + found[0] <= y for x, y in spared):
                out[found[1:]] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "Id1ot", "!diоt", "idiots", "trash", "tra$h", " can", " ", ",", "s", "3", "$$$", "loser", "L0SER", "1115", "ｔｒａｓｈ", "é"]), max_size=12).map("".join))
def test_matcher(text):
    words, stems = [toxicity.fold(w) for w in ("idiot", "trash", "loser")], [toxicity.fold(w) for w in ("idio", "idiot", "los")]
    assert toxicity.Matcher(words, stems, ("trash can",)).hits(text) == brute_hits(text, words, stems, ("trash can",))


def test_matcher_cases():
    hits = lambda text: sum(toxicity.Matcher(toxicity.first_model().words).hits(text).values())
    for text in ("you IDIOT!", "id1ot", "ＩＤＩＯＴ", "іdіоt", "!diot", "$tupid.", "l0ser", "idiot$$$"):
        assert hits(text) == 1, text
    for text in ("idiotproofx", "in the trash can", "1115", "", "a garbage collector"):
        assert hits(text) == 0, text
    began = time.perf_counter()
    assert hits("trash can " * 100_000) == 0 and hits("trash, can " * 100_000) == 100_000
    assert time.perf_counter() - began < 10  # one pass: the square would take hours


def test_lexicon_is_learned(spark):
    """Words and stems of no list are found from labels; copies of one text count once."""
    rng = random.Random(17)
    plain = [f"{a}{b}" for a in ("ta", "ro", "mi", "nel", "kor") for b in ("ba", "di", "lus", "mon", "pe", "sta", "vik")]
    text = lambda i, *more: " ".join([*(rng.choice(plain) for _ in range(40)), *more, str(i)])
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, text(i, "zorgle", rng.choice(["quab", "quab"]) + rng.choice(plain)) if bad else text(i, "quab" if i % 9 == 0 else "calm")))
        labels.append((i, int(bad)))
    copied = text(0, "harmless", "mention", "here")
    rows += [(1000 + k, copied) for k in range(200)]
    labels += [(1000 + k, 1) for k in range(200)]
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zorgie" in model.words and model.stems and all(s.startswith("quab") for s in model.stems)
    assert not {"harmiess", "mention", "here", "caim"} & set(model.words)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(spark, rows), model).collect()}
    wrong = [i for i, y in labels[:600] if got[i]["predicted"] != y]
    assert not wrong
    unseen = [(1, text(1, "quabzzz", "quabyyy")), (2, text(2, "z0rgle")), (3, text(3, "quab")), (4, text(4))]
    assert [r["predicted"] for r in sorted(toxicity.score_documents(docs_of(spark, unseen), model).collect())] == [1, 1, 0, 0]


def test_toxicity(spark):
    rows = [(i, "a calm text about birds and trees " * 3 + ("you idiot and moron" if i % 4 == 0 else f"number {i}") + f" {i} {i * i}") for i in range(400)]
    rows += [(1001, None), (1002, ""), (1003, "idiot " * 40_000), (None, "you moron"), (1, rows[1][1])]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    labels = labels.unionByName(labels.limit(3))
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert got[1001]["score"] == got[1002]["score"] < 0.5 < got[1003]["score"] <= 1 and not got[None]["held_out"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert toxicity.score_documents(docs, model).count() == len(rows)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == 303
    assert toxicity.train(docs, labels.where("toxic = 0")) == toxicity.first_model()
    assert toxicity.score_documents(docs_of(spark, []), toxicity.train(docs_of(spark, []), labels.limit(0))).count() == 0


# --- 8: decontamination -----------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, window=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for i, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in ids if x is not None), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", bound)
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["aa", "Bb", "cc", "É1", "dd"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 25]) + 3 * (i > 3))) for i in range(12)] + [(20, None), (21, "..."), (22, "zz"), (23, "yy zz"), (None, text(11)), (1, text(14))]
    items.append((30, items[6][1]))
    rows = [(i, text(30) + ", " + (rng.choice(items)[1] or "") + "! " + text(5)) for i in range(50)] + ODD + [(60, "zz"), (61, "yy-ZZ"), (62, (items[7][1] + " ") * 200)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = decontam.contamination(docs_of(spark, rows), benchmark)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == brute_contamination(rows, items)
    assert decontam.contamination(docs_of(spark, rows), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs_of(spark, [], extra=False), benchmark).count() == 0


# --- 9: near duplicates -----------------------------------------------------------------------------


def brute_near(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("block", [minhash.BLOCK_DOCS, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash, "PIVOTS", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(rng.choice([1, 2, 20])):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    rows += [(2001, None), (2002, ""), (2003, " \n"), (2004, "one two"), (2005, "ONE  two"), (2006, "w " * 20_000)]
    got = minhash.near_duplicates(docs_of(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_near(rows), key=repr)


def test_chain_without_a_main_component(spark, monkeypatch):
    """A group whose links are sparse: each text is near the next few only; blocks of two, pivots of one."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 2)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    words = [f"c{k}" for k in range(400)]
    rows = [(i, " ".join(words[9 * i : 9 * i + 100])) for i in range(14)]
    rows += [(100 + i, " ".join(words[14 * i : 14 * i + 60] + [f"z{i}x{k}" for k in range(40)])) for i in range(6)]
    got = minhash.near_duplicates(docs_of(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_near(rows), key=repr)


def test_near_duplicates_move_texts_of_groups_only(spark, monkeypatch):
    moved, sieved = [], minhash.sieved
    monkeypatch.setattr(minhash, "sieved", lambda df, ids: moved.append((sieved(df, ids), df)) or moved[-1][0])
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, words(i, 20)) for i in range(400)] + [(1000, words(7, 20) + " more"), (None, words(7, 20))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(400)} | {1000: 7, None: None}
    few, all_rows = (df.count() for df in moved[0])
    assert 2 <= few < 10 and all_rows == 402


@pytest.mark.parametrize("marks", [1, 5, 1 << 18])
def test_sieved_loses_no_row(spark, monkeypatch, marks):
    monkeypatch.setattr(common, "MARKS", marks)
    docs = spark.createDataFrame([(i, str(i)) for i in [*range(-50, 50), 2**62, 3, None]], "doc_id long, text string")
    ids = [-7, 3, 2**62, 999]
    left = common.sieved(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert sorted(r.text for r in left.where(F.col("doc_id").isin(ids)).collect()) == sorted(map(str, [-7, 3, 3, 2**62]))
    assert marks < 9 or left.count() < 9


def test_written_tables_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    texts = spark.range(0, 12_000, 1, 1).select("id", F.concat_ws(" ", *(F.sha2(F.concat_ws(" ", "id", F.lit(k)), 512) for k in range(31))).alias("text"))
    out = common.written(texts, "groups")
    assert out.count() == 12_000 and out.where("length(text) = 3998").count() == 12_000
    (at,) = out.inputFiles()
    told = pq.ParquetFile(at.removeprefix("file://")).metadata
    assert max(told.row_group(k).total_byte_size for k in range(told.num_row_groups)) <= 1.25 * common.ROW_GROUP


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b + " tail"), (9, c), (8, c), (8, c)]
    got = rows_of(minhash.near_duplicates(docs_of(spark, rows)), "doc_id", "component_id", "kept")
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True), (9, 8, False)]
    few = minhash.near_duplicates(docs_of(spark, rows), among=spark.createDataFrame([(7,), (9,), (5,)], "doc_id long"))
    assert rows_of(few, "doc_id", "component_id") == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 9)]


def test_hot_passage_among_unlike_documents(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 1)
    monkeypatch.setattr(minhash, "PIVOTS", 0)
    rows = []
    for p in range(4):
        passage = " ".join(f"p{p}x{k}" for k in range(60))
        rows += [(i, f"{passage} " + " ".join(f"d{i}x{k}" for k in range(8 if i % 400 in (150, 301) else 60))) for i in range(400 * p, 400 * p + 400)]
    got = minhash.near_duplicates(docs_of(spark, rows))
    assert rows_of(got.where(~F.col("kept")), "doc_id", "component_id") == sorted([(400 * p + 301, 400 * p + 150) for p in range(4)], key=repr)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(docs_of(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f")]))
    assert rows_of(got, "doc_id", "component_id", "kept") == [(4, 4, True), (5, 4, False), (5, 4, False), (None, None, True)]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_signature_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = pool[:1000], np.concatenate([pool[:857], pool[2000:2143]])
    one, two = (np.frombuffer(minhash.short(minhash.signature(np.sort(x))), np.uint8) for x in (a, b))
    assert minhash.agreement(one, two[None, :])[0] == pytest.approx(0.75, abs=0.13)


# --- 10: token counts -------------------------------------------------------------------------------


def brute_count(vocabulary, text):
    tokens = fallback = at = 0
    while at < len(text):
        best = max((n for n in range(1, len(text) - at + 1) if text[at : at + n] in vocabulary), default=0)
        tokens, fallback, at = (tokens + 1, fallback, at + best) if best else (tokens + len(text[at].encode()), fallback + 1, at + 1)
    return tokens, fallback


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc▁é", min_size=1, max_size=5), max_size=12), st.text("abcdé▁", max_size=20))
def test_automaton_is_greedy_longest_match(vocabulary, word):
    assert tokcount.PieceAutomaton(vocabulary, "▁").count(word) == brute_count(vocabulary, "▁" + word)


def test_token_counts(spark):
    make = lambda: tokcount.PieceAutomaton(["▁", "a", "ab", "abc", "bcd"], "▁")
    rows = [*ODD, (7, "abcd  abx\té"), (8, "a" * 100_000)]
    got = {(r["doc_id"], r["n_words"]): tuple(r)[2:] for r in tokcount.count_tokens(docs_of(spark, rows), make).collect()}
    assert got[7, 3] == (3 + 3 + 3, 1 + 1 + 1)
    assert got[8, 1] == (100_001, 0) and got[1, 0] == (0, 0)
    assert tokcount.count_tokens(docs_of(spark, []), make).count() == 0
