"""Toxicity, SimHash, decontamination, mixing and token output against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from tessera.llm import decontaminate, mixing, queries, simhash, token_output, toxicity

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one", None, None, 1), (4, long, "en", "b", 1), (5, long, "en", "b", 1), (6, long + " tail", "en", None, None), (6, long + " tail", "en", None, None), (None, "x y z", "en", "a", 1), (7, "  \t\n", "en", "c", 1), (8, "É É x <|endoftext|> 's  two", "fr", "c", 1)]


# SimHash


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, threshold=4, linked=None):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if linked(fps[i], fps[j]) if linked else (fps[i] ^ fps[j]).bit_count() <= threshold:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None and not pd.isna(d):
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_query_equals_brute_force(spark, docs):
    got = queries.op5_simhash(spark, SF).toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t, 4) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == brute_components(fps, docs.doc_id.tolist())


def test_simhash_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(table(spark, rows)).toPandas()
    fps = [brute_fingerprint(r[1], 4) for r in rows]
    want = brute_components(fps, [r[0] for r in rows])
    key = lambda rs: sorted((-1 if pd.isna(a) else int(a), b, -1 if pd.isna(c) else int(c)) for a, b, c in rs)
    assert key(zip(got.id, got.fp.map(lambda x: int(x) & (2**64 - 1)), got.component_id)) == key(zip([r[0] for r in rows], fps, want))
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = simhash.deduplicate(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len({i for i in ids}) and {1, 3, 4} <= set(ids) and 5 not in ids and 2 not in ids


@pytest.mark.parametrize("count", [1, 10**6, 10**12])
@pytest.mark.parametrize("threshold", [3, 4, 7])
def test_every_link_is_found_by_each_covering(spark, count, threshold):
    rng = np.random.default_rng(count % 97 + threshold)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(6):
            y = x
            for b in rng.choice(64, rng.integers(1, threshold + 3), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(table(spark, [(x,) for x in signed], "fp long"), count, threshold).collect()
    at = {x: i for i, x in enumerate(signed)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges:
        up[find(at[e.a])] = find(at[e.b])
    got = [find(i) for i in range(len(fps))]
    want = brute_components(fps, list(range(len(fps))), threshold)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_crowded_anchors_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 50)
    monkeypatch.setattr(simhash, "CHUNK", 200)
    test_simhash_large_groups_and_chains(spark)
    test_every_link_is_found_by_each_covering(spark, 1, 4)


def test_simhash_large_groups_and_chains(spark):
    rng = np.random.default_rng(5)
    centre, fps = int(rng.integers(0, 2**62)), set()
    while len(fps) < 3000:
        x = centre
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    chain = [int(rng.integers(0, 2**62))]
    for i in range(40):
        chain.append(chain[-1] ^ (0b111 << (i % 20 * 3)))
    signed = [x - 2**64 if x >= 2**63 else x for x in [*fps, *chain]]
    edges = simhash.links(table(spark, [(x,) for x in set(signed)], "fp long"), len(signed))
    from tessera.llm._graph import components

    found = components(edges).toPandas()
    roots = dict(zip(found.node, found.root))
    assert len({roots[x] for x in signed[: len(fps)]}) == 1
    want = brute_components([x & (2**64 - 1) for x in signed[len(fps) :]], list(range(len(chain))))
    assert len({roots[x] for x in signed[len(fps) :]}) == len(set(want))
    assert edges.count() < 20 * len(signed)


# Decontamination


def brute_contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w = word.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    named |= found
        out.append((len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return out


def test_decontaminate_query_equals_brute_force(spark, docs):
    got = queries.op9_decontaminate(spark, SF).toPandas().sort_values("doc_id")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = brute_contamination(docs.text, list(zip(items.item_id, items.text)))
    assert got.n_words.tolist() == [w[0] for w in want]
    assert got.n_hit.tolist() == [w[1] for w in want]
    assert got.n_items.tolist() == [len(w[2]) for w in want]
    assert got.items_sha256.tolist() == [hashlib.sha256(",".join(w[2]).encode()).hexdigest() for w in want]
    assert got.contaminated.tolist() == [w[1] > 0 for w in want] and got.contaminated.any()


def test_decontaminate_odd_rows(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "beta", "gamma", "Über", "4", "delta"]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 25])]
    items += [(20, items[9][1]), (20, items[9][1]), (None, "gamma gamma gamma gamma gamma gamma gamma"), (21, None)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 1, 3, 9, 30, 200)] + [None, "", items[9][1].upper() + "--" + items[10][1], "x " * 9000 + items[11][1]]
    items = [x for x in items if x[0] not in (1, 2)] + [(30, "nowhere")]
    rows = [(i // 2, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = decontaminate.contamination(table(spark, rows), table(spark, items, "item_id long, text string")).orderBy("row").collect()
    want = brute_contamination(texts, items)
    key = lambda rs: sorted((int(a), int(b), int(c), list(d)) for a, b, c, d in rs)
    assert key((r.id, r.n_words, r.n_hit, r["items"]) for r in got) == key((rows[i][0], *w) for i, w in enumerate(want))
    empty = table(spark, [], "item_id long, text string")
    assert decontaminate.contamination(table(spark, rows), empty).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(table(spark, []), empty).count() == 0
    assert decontaminate.clean(table(spark, rows), empty).count() == len(rows)


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, repeat=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, budget = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if budget * weight[s] / total >= repeat * sizes[s]}
        if not over:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = repeat * sizes[s]
        budget -= sum(target[s] for s in over)
        open_ -= over
    return target


def check_mix(got, docs):
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs}
    by = defaultdict(int)
    for r in docs:
        by[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target, taken = brute_targets(by), defaultdict(int)
    source_of = {r[0]: r[2] for r in docs}
    for r in got.itertuples():
        s = source_of[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == by[s] and r.taken <= 2 * r.size
        assert abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        taken[s] += r.taken
    return taken, target


def test_mixing_query(spark, docs):
    got, again = (queries.op4_mixing(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(got, again)
    taken, target = check_mix(got, list(zip(docs.doc_id, docs.text, docs.source)))
    assert all(abs(taken[s] - target[s]) <= 3 + 0.02 * target[s] for s in target)


def test_mixing_odd_rows(spark):
    rows = [(i, "w " * (i % 7), "en", None if i % 5 == 0 else f"s{i % 3}", 1) for i in range(300)] + [(300 + i, "a b c", "en", "s0", 1) for i in range(2500)] + [(9000, None, "en", "é", 1)]
    got = mixing.mixture(table(spark, rows)).toPandas().rename(columns={"id": "doc_id"})
    taken, target = check_mix(got, [(r[0], r[1], r[3]) for r in rows])
    assert all(abs(taken[s] - target[s]) <= 3 for s in target), (taken, target)
    assert mixing.mixture(table(spark, [])).count() == 0
    mixed = mixing.mix(table(spark, rows))
    assert mixed.columns == table(spark, []).columns
    assert mixed.count() == got.copies.sum()


def test_fit_budget_against_all_sums():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(1, 5, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 3))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= budget
        sums = {0}
        for x, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + i * x for s in sums for i in range(n + 1)}
        assert (lengths * take).sum() == max(s for s in sums if s <= budget)
    lengths = np.arange(1, 20_001)
    take = mixing.fit_budget(lengths, np.full(20_000, 3), 123_456_789)
    assert (lengths * take).sum() == 123_456_789


# Token output


def brute_tokens(rows, end=2):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_equals_the_library(spark, docs):
    got = queries.op7_token_output(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_tokens(list(zip(docs.doc_id.tolist(), docs.text)))


def test_token_odd_rows_and_selective_reads(spark):
    import public_tokenizers

    rows = odd_rows() + [(50 + i, t, "en", "s", 1) for i, t in enumerate([" a", "a ", "a  b", "a \n b", "\n\n x", "a  b", "a  b", "a\x1c b", "x's it'll  ", "1 22 333 ... !!", "a\r\n b\t c", "İ \U0001f600 z"])]
    path = token_output.encode(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    got = sorted((tuple(r) for r in token_output.checksums(token_output.read(spark, path)).collect()), key=lambda r: r[1])
    assert got == brute_tokens([r[:2] for r in rows])
    plan = token_output.index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan
    assert sorted(tuple(r)[1] for r in token_output.index(spark, path).collect()) == [r[1] for r in got]
    empty = token_output.encode(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, ids="delta")
    assert token_output.read(spark, empty).count() == 0


def test_special_tokens_are_the_library_s_or_text(spark):
    import public_tokenizers

    rows = [(1, "a <|endoftext|> b", "en", "s", 1), (2, "plain", "en", "s", 1)]
    ids = {}
    for as_text in (False, True):
        path = token_output.encode(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, special_as_text=as_text)
        ids[as_text] = {r.doc_id: list(r.token_ids) for r in token_output.read(spark, path).collect()}
    assert ids[False][1] == [64, 220, 50256, 275, 2] and 50256 not in ids[True][1] and len(ids[True][1]) > 5
    assert ids[False][2] == ids[True][2]


def test_starts_are_summed_over_groups_of_files(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_output, "FILES_A_GROUP", 2)
    monkeypatch.setattr(token_output, "BROADCAST_FILES", 0)
    rows = [(i, f"word {i} " * (i % 7), "en", "s", 1) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = token_output.encode(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).select("part").distinct().count() >= 3
    got = sorted((tuple(r) for r in token_output.checksums(token_output.read(spark, path)).collect()), key=lambda r: r[1])
    assert got == brute_tokens([r[:2] for r in rows])


def test_token_files_have_page_indexes(spark):
    import glob

    import public_tokenizers
    import pyarrow.parquet as pq

    path = token_output.encode(spark.read.parquet(f"{SF}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, row_group_bytes=64 << 10)
    file = max(glob.glob(path.removeprefix("file:").replace("//", "/") + "/*.parquet"))
    meta = pq.ParquetFile(file).metadata
    for i in range(meta.num_columns):
        column = meta.row_group(0).column(i)
        assert column.has_offset_index and column.has_column_index
        if column.path_in_schema in ("doc_id", "local_start"):
            assert "DELTA_BINARY_PACKED" in column.encodings
        if column.path_in_schema.startswith("token_ids"):
            assert any("DICTIONARY" in e for e in column.encodings)


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).toPandas()
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    out = both[both.held_out]
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit / max(1, (out.predicted == 1).sum()) > 0.95
    assert hit / (out.toxic == 1).sum() >= 0.9


def test_toxicity_odd_rows(spark):
    labels = table(spark, [(1, 0), (4, 1), (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    docs = table(spark, odd_rows())
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, table(spark, [], "doc_id long, toxic int")), toxicity.fit(table(spark, []), labels)):
        got = toxicity.score(docs, model, score_col="lang").collect()
        assert len(got) == 10 and all(0 <= r.lang <= 1 for r in got)
        assert toxicity.score(table(spark, []), model).count() == 0


def test_label_model_discounts_correlated_and_weak_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = np.stack([np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(4)], 1)
    weak = rng.random(4000) < 0.3
    x = np.column_stack([good, *[weak] * 6]).astype(float)
    gold = np.where(rng.random(4000) < 0.1, ~y, y).astype(float)
    q = toxicity.label_model(x, gold)
    assert ((q > 0.5) == y).mean() > 0.95


def test_mined_patterns_equal_plain_counts(spark, docs):
    """Of patterns with equal rows one stays; none beyond chance is left out."""
    import math
    from collections import Counter

    labels = pd.read_parquet(f"{SF}/labels.parquet").dropna()
    rows = docs.merge(labels, on="doc_id")[["doc_id", "text", "toxic"]].drop_duplicates("doc_id")
    rows = pd.concat([rows, pd.DataFrame([(9000 + i, f"fine zzgrump{'ab'[i % 2]} text {i}", 1) for i in range(30)], columns=rows.columns)])
    sample = toxicity.sample_rows(spark.createDataFrame(rows[["doc_id", "text"]]), spark.createDataFrame(rows[["doc_id", "toxic"]]), "doc_id", "text", "toxic", 10_000)
    n, positives = len(rows), int(rows.toxic.sum())
    got = toxicity.mine(sample, positives, n)
    where, pos = defaultdict(set), Counter()
    for d, t, y in rows.itertuples(index=False):
        for p in toxicity.found_in(t.encode()):
            where[p].add(d)
            pos[p] += y
    rate, strong = positives / n, {}
    for p, ids in where.items():
        r = pos[p] / len(ids)
        if pos[p] >= 4 and r > 2 * rate:
            evidence = len(ids) * (r * math.log(r / rate) + ((1 - r) * math.log((1 - r) / (1 - rate)) if r < 1 else 0))
            if round(evidence, 6) >= 13:
                strong.setdefault(frozenset(ids), []).append(p)
    want = [min(ps, key=lambda p: (len(p), p)) for ps in strong.values()]
    assert sorted(got) == sorted(want)
    assert len(got) > 2 and any(b"zzgrump" in p for p in got)


def test_posterior_equals_bayes_row_by_row():
    rng = np.random.default_rng(4)
    y = rng.random(800) < 0.2
    x = np.stack([np.where(y, rng.random(800) < 0.6, rng.random(800) < 0.02) for _ in range(5)] + [np.where(y, 0.1, 0.05) > rng.random(800)], 1)
    x = np.column_stack([x, x[:, 0], x[:, 0]])  # said three times
    gold = np.where(rng.random(800) < 0.08, ~y, y).astype(float)
    model = toxicity.fit_label_model(x, gold)
    q = model.posterior(x, gold)
    for i in range(0, 800, 7):
        odds = model.base / (1 - model.base)
        for j, v in enumerate(x[i]):
            odds *= (model.hit[j] / model.false[j] if v else (1 - model.hit[j]) / (1 - model.false[j])) ** model.share[j]
        odds *= model.label_hit / model.label_false if gold[i] else (1 - model.label_hit) / (1 - model.label_false)
        assert abs(q[i] - odds / (1 + odds)) < 1e-9
    assert model.share[0] < 0.45 and model.share[1] > 0.6  # correlations within a class
    outvoted = (q > 0.5) != (gold > 0)
    assert outvoted.sum() > 20 and ((q > 0.5) == y).mean() > ((gold > 0) == y).mean()
    # the classifier's weights are where the penalised likelihood is greatest
    w = toxicity.linear(x[:, :6].astype(float), q)
    a = np.column_stack([x[:, :6], np.ones(800)])
    penalty = np.array([0.1] * 6 + [1e-6])
    loss = lambda w: -(q * -np.logaddexp(0, -a @ w) + (1 - q) * -np.logaddexp(0, a @ w)).sum() + (penalty * w * w).sum() / 2
    assert all(loss(w) <= loss(w + d) for k in range(7) for d in (np.eye(7)[k] * 1e-3, np.eye(7)[k] * -1e-3))


def test_like_patterns_and_families_are_one():
    rng = np.random.default_rng(6)
    a = rng.random(500) < 0.3
    b, none = a.copy(), np.zeros(500, bool)
    b[np.flatnonzero(a)[:5]] = False
    c = rng.random(500) < 0.3
    assert toxicity.unlike(np.column_stack([a, b, none, c])) == [0, 3]
    assert toxicity.families([b"idiot$", b"idi", b"tra*2", b"tra", b"trash$", b"#bangs"]) == [0, 3, 5]


def test_voters_outvote_labels_and_no_voter_is_cut(spark):
    """Hundreds of rare patterns, each of a language of its own, and some wrong labels."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}xinsult" for i in range(500)]
    rows = [(k * 10_000 + i, f"some plain text {w} and {words[(i + 1) % 500]}", 1) for i, w in enumerate(words) for k in range(8)]
    rows += [(10**6 + i, f"some plain text number {i} and the weather {i % 97}", int(i % 50 == 0)) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.score(df, model).toPandas()
    assert len(model.weights) >= 500
    assert (got.predicted == (got.doc_id < 10**6)).all()


@pytest.mark.parametrize("as_text", [False, True])
def test_encoder_equals_the_library_on_odd_texts(as_text):
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = as_text
    encoder = token_output.Encoder(open(path).read(), as_text)
    piece = st.sampled_from(["a", "word", "It's", "'ll", "''s", "x'", "12ab3", ",", "...", "$$$", "é", "ß", "İ", "́", "漢", "\U0001f600", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "\x1c", "​", "<|endoftext|>", "<|endoftext|", "a<|endoftext|>b", "Ǆ", "ª", "\x02", "\x03", "a.", "b,", ".", "²", "½", "_"])
    text = st.lists(piece | st.characters(exclude_categories=["Cs"]), max_size=12).map("".join) | st.lists(piece, max_size=9).map(" ".join) | st.lists(piece, max_size=9).map("\n".join)

    @settings(max_examples=600, deadline=None)
    @given(st.lists(text, max_size=4))
    def check(batch):
        got = encoder.encode_all(batch)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in batch]

    check()
