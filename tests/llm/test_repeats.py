"""Spelling variants, periodic runs and recurring passages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import passages, periodic, queries, variants

from .test_corpus_ops import DOCS, LOWER, odd_rows, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(ids, texts):
    counts = Counter()
    for key, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n > 1}


def brute_groups(words):
    near = defaultdict(list)
    by_hole = defaultdict(set)  # words that agree but for one place
    for w in words:
        for i in range(len(w)):
            by_hole[w[:i] + "*" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                by_hole[w, w[:i] + w[i + 1 :]] |= {w, w[:i] + w[i + 1 :]}
    for group in by_hole.values():
        for a in group:
            near[a] += [b for b in group if b != a]
    out, forms = {}, {}
    for w, n in words.items():
        mine = sorted(set(near[w]), key=lambda x: (-words[x], x))
        forms[w] = mine[0] if mine and words[mine[0]] >= 10 * n else None
        out[w] = [n, len(mine), words[forms[w]] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, forms[w], root, *out[w])
    return sorted(out.values(), key=repr)


def sorted_rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


GROUPED = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_variants_query(spark, docs):
    want = brute_groups(brute_words(docs.doc_id, docs.text))
    assert sorted_rows(queries.op11_spelling_variants(spark, SF), GROUPED) == want
    assert any(r[1] for r in want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcdeéß", min_size=4, max_size=6), min_size=2, max_size=40, unique=True))
def test_near_pairs_are_all_found(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    got = set()
    for n, left in by_length.items():
        for right in (left, by_length.get(n - 1, [])):
            if right:
                got |= {frozenset((left[i], right[j])) for i, j in zip(*variants.near_pairs(left, right, right is left))}
    assert got == {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}


def test_variants_of_a_hot_block(spark, monkeypatch):
    """All words have the same letters' groups; blocks of a few words."""
    monkeypatch.setattr(variants, "BLOCK", 8)
    rng = random.Random(5)
    words = {"".join(rng.choice("tdqz") for _ in range(7)) + "e" * rng.randrange(2): rng.randrange(1, 500) for _ in range(300)}
    words |= {"aaaaaaaa": 5, "aaaaaaab": 60, "aaaaaabb": 700, "aaaaabbb": 9000}
    got = variants.group(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted_rows(got, GROUPED) == brute_groups(words)
    assert {r.word: r.root for r in got.collect()}["aaaaaaaa"] == "aaaaabbb"


def test_variants_of_odd_rows(spark):
    long = "z" * 50_000
    rows = [(None, "Straßen straßen STRASSEN", 1), (1, None, 1), (2, "", 1), (3, f"{long} {long} {long}y {long}y", 1), (3, f"{long} {long} {long}y {long}y", 1), (4, "aaaaaaa×÷ aaaaaaa×÷ 1aaaaaaa2 aaaaaaa", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `word` long").withColumnsRenamed({"doc_id": "the `id`", "text": "the.text"})
    got = variants.group(variants.vocabulary(df, "the `id`", "the.text", edit=queries.drop_one))
    assert sorted_rows(got, GROUPED) == brute_groups(brute_words([r[0] for r in rows], [r[1] for r in rows]))
    assert variants.group(variants.vocabulary(df.limit(0), "the `id`", "the.text")).count() == 0


# Periodic runs


def brute_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if length >= max(least, exponent * q) and not any(q % r == 0 and all(words[a + k] == words[a + k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_repeated(doc_id, text):
    words = split(text)
    n = len(words)
    if doc_id is None or pd.isna(doc_id) or text is None:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_periodic(doc_id, text):
    words = brute_repeated(doc_id, text)
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), s, n, q, 1000 * n // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(kept))


def numbered_runs(texts):
    seen, codes = {}, []
    for k, words in enumerate(texts):
        codes += [seen.setdefault(w, len(seen)) for w in words] + [-1 - k]
    return periodic.runs(np.array(codes, np.int64), np.array([len(t) for t in texts], np.int64)).tolist()


def brute_batch(texts):
    out, at = [], 0
    for words in texts:
        out += [[at + s, n, q] for s, n, q in brute_runs(words)]
        at += len(words) + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=12), st.integers(1, 9)), max_size=4).map(lambda parts: list("".join(t * k for t, k in parts))), max_size=4))
def test_runs_of_periodic_texts(texts):
    assert numbered_runs(texts) == brute_batch(texts)


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_nested_repeats(seed):
    """Long periods made of shorter runs, cut at any place, in texts of several lengths."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        text = []
        for _ in range(rng.randrange(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 8) + [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))]
            text += (unit * rng.randrange(1, 7))[rng.randrange(0, 5) : len(unit) * 6 - rng.randrange(0, 9)]
        texts.append(text)
    assert numbered_runs(texts) == brute_batch(texts)


def test_periodic_runs_query(spark, docs):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_periodic(d, t) for d, t in zip(docs.doc_id.tolist(), docs.text)]
    assert sorted_rows(queries.op12_periodic_runs(spark, SF), columns) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 5


def test_periodic_runs_of_odd_rows(spark):
    rows = odd_rows() + [(9, "x " * 40_000 + "y", "en", "a", 1), (10, "a b  c\na b c\x0ba b c a b c", "en", "a", 1)]
    got = periodic.periodic_runs(table(spark, rows)).collect()
    want = [(r[0], len(split(r[1])), brute_runs(split(r[1])) if len(split(r[1])) < 100 else None) for r in rows]
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.id].append((r.n_words, [tuple(x) for x in r.runs], r.text))
    for key, n, found in want:
        assert any(n == m and (found is None or found == runs) for m, runs, _ in by_id[key])
    assert by_id[9][0][1:] == ([(0, 40_000, 1)], "x y") and by_id[10][0][1:] == ([(0, 12, 3)], "a b c")
    assert len(by_id[4][0][1]) == 1  # words in a cycle of 977
    named = table(spark, rows).selectExpr("doc_id as `a.b`", "text as `t``x`", "1 as id", "2 as runs", "3 as n_words")
    assert periodic.periodic_runs(named, "a.b", "t`x").count() == len(rows)
    assert periodic.periodic_runs(table(spark, []), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(0, np.int64), np.zeros(0, np.int64), exponent=3)


# Recurring passages


def brute_passages(texts, window):
    words = [split(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup_query(spark, docs):
    want = [(d, n, gone, sha(kept)) for d, (n, gone, kept) in zip(docs.doc_id.tolist(), brute_passages(docs.text, 35))]
    assert sorted_rows(queries.op13_substring_dedup(spark, SF), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 10


@pytest.mark.parametrize("window, longest, shard", [(5, 3, 40), (8, 512, 200_000), (20, 7, 300), (1, 4, 50)])
def test_passages_that_branch(spark, monkeypatch, window, longest, shard):
    """Texts pieced together from few parts, so passages meet, part, nest and repeat within
    texts; phrases are cut, shards are many and split."""
    monkeypatch.setattr(passages, "LONGEST", longest)
    monkeypatch.setattr(passages, "SHARD_WORDS", shard)
    monkeypatch.setattr(passages, "TASK_DOCS", 3)
    rng = random.Random(window)
    parts = [" ".join(rng.choice(["a", "b", "c"] if k < 3 else [f"w{i}" for i in range(60)]) for _ in range(rng.randrange(1, 3 * window + 2))) for k in range(10)]
    texts = ["  ".join(rng.choice(parts) if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(rng.randrange(0, 12))) for _ in range(40)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = passages.deduplicate(table(spark, rows), window)
    assert sorted(map(tuple, got.collect())) == [(i, *r) for i, r in enumerate(brute_passages(texts, window))]


def test_passages_of_odd_rows(spark):
    rows = odd_rows() + [(11, " ".join(f"w{i % 977}" for i in range(500, 700)), "en", "q", 1), (12, "z " * 200, "en", "q", 1)]
    want = sorted(((r[0], *x) for r, x in zip(rows, brute_passages([r[1] for r in rows], 35))), key=repr)
    assert sorted(map(tuple, passages.deduplicate(table(spark, rows)).collect()), key=repr) == want
    named = table(spark, rows).selectExpr("doc_id as `a.b`", "text as `t``x`", "1 as id", "2 as file", "3 as spans", "4 as __row")
    assert sorted(map(tuple, passages.deduplicate(named, 35, "a.b", "t`x").collect()), key=repr) == want
    assert passages.deduplicate(table(spark, [])).count() == 0


def test_a_chance_agreement_of_hashes_removes_nothing(spark, monkeypatch):
    """Hashes of windows that say next to nothing; words decide."""
    honest = passages.window_hashes
    monkeypatch.setattr(passages, "window_hashes", lambda h, n: honest(h, n) & np.uint64(7))
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (2, " ".join(f"b{i}" for i in range(60)), "en", "a", 1)]
    got = passages.deduplicate(table(spark, rows), 35).collect()
    assert sorted((r.id, r.n_removed) for r in got) == [(1, 0), (2, 0)]
