"""Each stage of the pipeline against brute force on what its predecessor kept."""

import re
from collections import Counter

import pandas as pd
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from .test_corpus_ops import brute_components, brute_contamination, brute_tokens, check_mix, odd_rows
from .test_jaccard import brute_shingles, brute_similarity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    from tessera.llm import _common

    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        out.append(_common.written(stage(spark, out[-1], SF), "test-" + name.replace(" ", "-")))
    return [df.toPandas() for df in out]


def test_toxic_documents_go(spark, kept):
    from tessera.llm import toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from tessera.llm.queries import held_out

    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out()))).toPandas()
    assert sorted(kept[1].doc_id) == sorted(scored.doc_id[scored.score < 0.7])
    assert list(kept[1].columns) == COLUMNS


def test_one_of_each_group_stays(kept):
    """Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8."""
    before, after = kept[1], kept[2]
    sets = [brute_shingles(t) for t in before.text]
    component = brute_components(sets, before.doc_id.tolist(), linked=lambda a, b: brute_similarity(a, b) >= 0.8)
    assert sorted(after.doc_id) == sorted(set(component))
    assert list(after.columns) == COLUMNS


def test_contaminated_documents_go(kept):
    before, after = kept[2], kept[3]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    found = brute_contamination(before.text, list(zip(items.item_id, items.text)))
    assert sorted(after.doc_id) == sorted(d for d, f in zip(before.doc_id, found) if not f[1])
    assert len(after) < len(before) and list(after.columns) == COLUMNS


def test_sources_come_near_their_targets(kept):
    before, after = kept[3], kept[4]
    times = Counter(after.doc_id)
    rows = list(zip(before.doc_id, before.text, before.source))
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in rows}
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += words[d]
    got = pd.DataFrame([(d, words[d], sizes[s], 0.0, times[d] * words[d]) for d, _, s in rows], columns=["doc_id", "size", "source_size", "target", "taken"])
    from .test_corpus_ops import brute_targets

    target = brute_targets(dict(sizes))
    got["target"] = [target[s] for _, _, s in rows]
    taken, target = check_mix(got, rows)
    assert all(target[s] - max(words.values()) <= taken[s] <= target[s] + 1 for s in target)
    assert max(times.values()) <= 2 and list(after.columns) == COLUMNS


def test_tokens_of_what_is_left(kept):
    before, got = kept[4], kept[5]
    want = brute_tokens(list(zip(before.doc_id.tolist(), before.text)))
    assert sorted(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)


def test_run_and_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert pipeline.ORACLE_SQL is None and len(pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark):
    """Nulls in every column, null and repeated ids, repeated rows, a long text, extra columns of our own names
    and of names with dots and backticks."""
    rows = [(*r, "x") for r in odd_rows()] + [(None, None, None, None, None, None), (9, "an idiot and a moron, scum and trash", "en", "a", 5, "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string").withColumn("__toxic", F.lit(7)).withColumn("__copies", F.lit(None).cast("int")).withColumn("score", F.lit("s")).withColumn("x.y", F.lit(1)).withColumn("a`b", F.lit(2)).withColumn("doc.text", F.lit(3))
    before = Counter(map(tuple, docs.collect()))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        after = Counter(map(tuple, out.collect()))
        assert set(after) <= set(before), name
        if name == "toxicity":
            assert after == Counter({r: n for r, n in before.items() if r[0] != 9})
        if name == "simhash near-dedup":
            texts = [r[1] for r in rows]
            assert sum(after.values()) == len(set(brute_components([brute_shingles(t) for t in texts], list(range(len(texts))), linked=lambda a, b: brute_similarity(a, b) >= 0.8)))
        if name == "benchmark decontamination":
            assert after == before
    tokens = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == len(rows) and sum(r.n_tokens for r in tokens) == max(r.start + r.n_tokens for r in tokens)


def test_runs_in_other_folders_agree(spark, tmp_path):
    """The same rows in other files: the same documents, tokens and checksums."""
    runs = []
    for n in (1, 3):
        for t in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            (df.repartition(n) if n > 1 else df).write.parquet(f"{tmp_path}/{n}/{t}.parquet")
        runs.append(sorted(map(tuple, pipeline.run(spark, f"{tmp_path}/{n}").collect())))
    assert runs[0] == runs[1] and len(runs[0]) > 50
