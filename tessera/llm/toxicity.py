"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``MAX_SAMPLE``) is searched for word and word-stem
   patterns (found once, twice, three times) that occur in toxic texts beyond chance. Of
   patterns found in just the same rows one is kept, of those that nearly agree (``ALIKE``)
   the strongest, and each must tell something of rows that fewer than ``TIMES_TOLD``
   stronger ones tell of; there is no other bound on their number.
2. The voters of the label model are a small lexicon of insults, patterns of punctuation and
   mined patterns, one of each family (stems of one another). The generative model (two latent classes, EM)
   estimates each voter's rates in either class, starting from and held near those the labels
   show, and their correlations within a class: voters that say the same share their weight.
   The given label is one more voter; what it is right in is estimated by what the others
   say, so they can outvote it.
3. A linear classifier (logistic regression) over all kept patterns is trained on the
   posterior labels, each row's likelier class. The labels calibrate it: two numbers, scale and offset of its scores,
   are fitted on rows that a classifier trained without them scored.
4. Every whole text is scored by the classifier alone, in one pass without a shuffle.

Labels only enter through the sample; ids, sources and languages are never inputs.

Edge cases: null or empty text scores as a text without any hit; a very long text is read
whole, its patterns are counted as any other's; repeated rows are scored alike; an empty
table gives no rows; labels with null id or null label are skipped, and of contradicting
labels of one id the larger counts, of texts with one id the least; patterns of equal
evidence are taken in their bytes' order; without labels of both classes there are only the
lexicon's voters and the base rate. Extra columns pass through, and columns named like an
output are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import appended, column, fresh, map_arrow, map_arrow_stream, texts, with_columns

#: Labelled rows the model is fitted on, at most. Patterns whose rows overlap by more than
#: ``ALIKE`` (Jaccard) are one; voters this correlated within a class share their weight.
MAX_SAMPLE, ALIKE, CORRELATED = 12_000, 0.8, 0.2
#: Parts of the sample that calibrate each other's scores; patterns that tell of a row.
FOLDS, TIMES_TOLD = 5, 5
#: Nats of evidence a mined pattern needs (a bound for some 10^5 patterns tried), and rows.
MIN_EVIDENCE, MIN_ROWS = 13.0, 4
#: Scores from which a text counts as toxic.
THRESHOLD = 0.7
#: Words that vote for toxic without any mining.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "bastard", "imbecile")
#: Stems of words, in bytes of UTF-8; a pattern also counts as found twice, three times.
STEMS, TIMES = range(3, 10), (2, 3)

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()


def patterns_of(word: bytes) -> list[bytes]:
    """A word's patterns: the word (ending in $) and its stems."""
    return [word + b"$", *(word[:k] for k in STEMS if k < len(word))]


def style_of(text: bytes) -> list[bytes]:
    """Patterns that aren't words."""
    out = []
    if text.count(b"!!"):
        out.append(b"#bangs")
    if sum(text.count(c) for c in (b"$$", b"##", b"%%", b"&&", b"**")) > 3:
        out.append(b"#symbols")
    letters = sum(map(text.count, (b"A", b"E", b"I", b"N", b"R", b"T")))
    if letters * 8 > len(text) > 0:
        out.append(b"#capitals")
    return out


def found_in(text: bytes, bases: Callable[[bytes], Sequence[bytes]] = patterns_of) -> set[bytes]:
    """All patterns of a text; ``bases`` gives those of a word that matter."""
    times: dict[bytes, int] = {}
    for word, n in Counter(words_of(text)).items():
        for p in bases(word):
            times[p] = times.get(p, 0) + n
    out = set(times)
    for k in TIMES:
        out.update(p + b"*%d" % k for p, n in times.items() if n >= k)
    out.update(style_of(text))
    return out


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Known:
    """The patterns of a word that a set of patterns needs; remembers words."""

    def __init__(self, patterns: Iterable[bytes]) -> None:
        self.bases, self.seen = {p.split(b"*")[0] for p in patterns}, {}

    def __call__(self, word: bytes) -> Sequence[bytes]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 120_000:
                self.seen.clear()
            found = self.seen[word] = tuple(p for p in patterns_of(word) if p in self.bases)
        return found


class Scorer:
    def __init__(self, model: Model) -> None:
        self.w, self.bias, self.known = model.weights, model.bias, Known(model.weights)

    def __call__(self, text: bytes) -> float:
        z = self.bias + sum(self.w[p] for p in sorted(found_in(text, self.known)) if p in self.w)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(label, text, mark) of at most ``limit`` labelled ids, chosen by a hash of the id."""
    chosen = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    found = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `limit` pairs
    return found.groupBy("id", "label").agg(F.min("text").alias("text")).repartition(16, "id").select("label", "text", F.xxhash64("id").alias("mark"))


def mine(sample: DataFrame, positives: int, total: int) -> list[bytes]:
    """Patterns that occur in toxic texts beyond chance, strongest first; of those found in
    the same rows the shortest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, rows = Counter(), Counter(), {}

        def out() -> pa.RecordBatch:
            keys = list(rows)
            columns = [pa.array(keys, pa.binary()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64()), pa.array(list(rows.values()), pa.int64())]
            pos.clear(), neg.clear(), rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["pattern", "pos", "neg", "rows"])

        for batch in batches:
            for label, text, mark in zip(batch.column(0).to_pylist(), texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
                found = found_in(text)
                (pos if label else neg).update(found)
                for p in found:
                    rows[p] = rows.get(p, 0) ^ mark
                if len(rows) > 200_000:
                    yield out()
        yield out()

    rate = positives / total
    counts = map_arrow_stream(sample, run, T.StructType([T.StructField("pattern", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("pos", "neg", "rows"))]))
    both = counts.groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_xor("rows").alias("rows")).where(f"pos >= {MIN_ROWS}")
    p = F.col("pos") / (F.col("pos") + F.col("neg"))
    evidence = (F.col("pos") + F.col("neg")) * (p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    strong = both.withColumn("evidence", F.round(evidence, 6)).where((p > 2 * rate) & (F.col("evidence") >= MIN_EVIDENCE))
    best = strong.groupBy("rows", "pos", "neg").agg(F.min(F.struct(F.octet_length("pattern").alias("n"), "pattern")).alias("p"), F.max("evidence").alias("evidence"))
    return [bytes(r["pattern"]) for r in best.orderBy(F.desc("evidence"), "p").select("p.pattern").collect()]  # different subsets of a bounded sample


def votes(sample: DataFrame, voters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x voters) votes and labels of the bounded sample."""
    index = {v: i for i, v in enumerate(voters)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = Known(voters)
        hits = [sorted(index[p] for p in found_in(text, known) if p in index) for text in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], names=["label", "hits"])

    rows = map_arrow(sample, run, T.StructType([T.StructField("label", T.IntegerType()), T.StructField("hits", T.ArrayType(T.IntegerType()))])).collect()
    rows.sort(key=lambda r: (r["label"], r["hits"]))  # reruns agree
    x = np.zeros((len(rows), len(voters)), bool)
    for i, r in enumerate(rows):
        x[i, r["hits"]] = True
    return x, np.array([r["label"] for r in rows], np.float64)


def unlike(x: np.ndarray, alike: float = ALIKE) -> list[int]:
    """Columns, first ones preferred, without those that overlap a kept one too far."""
    packed, sizes, kept = np.packbits(x, axis=0).T.copy(), x.sum(0), []
    held = np.zeros_like(packed)
    for j in range(x.shape[1]):
        if not sizes[j]:
            continue
        both = np.bitwise_count(held[: len(kept)] & packed[j]).sum(1, dtype=np.int64)
        if len(kept) and (both >= alike * (sizes[kept] + sizes[j] - both)).any():
            continue
        held[len(kept)] = packed[j]
        kept.append(j)
    return kept


def needed(x: np.ndarray, gold: np.ndarray) -> list[int]:
    """Columns, first ones preferred, that tell something of rows which fewer than ``TIMES_TOLD``
    kept ones have spoken of. What is peculiar to a text and its copies is told by others."""
    told, rate, kept = np.zeros(len(x), np.int64), gold.mean(), []
    for j in range(x.shape[1]):
        rows = x[:, j] & (told < TIMES_TOLD)
        n, p = rows.sum(), gold[rows].mean() if rows.any() else 0.0
        evidence = n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0)) if p > rate else 0.0
        if evidence >= MIN_EVIDENCE / 2:
            kept.append(j)
            told[x[:, j]] += 1
    return kept


def families(patterns: Sequence[bytes]) -> list[int]:
    """Patterns found once, first ones preferred, none of which is a stem of another."""
    kept: list[bytes] = []
    out = []
    for j, p in enumerate(patterns):
        base = p.rstrip(b"$")
        if b"*" not in p and not any(base.startswith(k) or k.startswith(base) for k in kept):
            kept.append(base)
            out.append(j)
    return out


@dataclass
class LabelModel:
    """Rates of votes in the toxic and the other class, weights shared among correlated
    voters."""

    base: float
    hit: np.ndarray
    false: np.ndarray
    share: np.ndarray
    label_hit: float
    label_false: float

    def posterior(self, x: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of each row by its votes, and its label if that is given."""
        x = np.asarray(x, np.float64)
        z = math.log(self.base / (1 - self.base)) + x @ (np.log(self.hit / self.false) * self.share)
        z += (1 - x) @ (np.log((1 - self.hit) / (1 - self.false)) * self.share)
        if gold is not None:
            z += np.where(gold > 0, math.log(self.label_hit / self.label_false), math.log((1 - self.label_hit) / (1 - self.label_false)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(x: np.ndarray, gold: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over rows of votes (0 or 1) and labels. Rates of the labels count as much as those
    of the posterior, so the classes keep their meaning."""
    full = np.asarray(x, np.float64)
    on, off = gold.sum(), (1 - gold).sum()
    hit_0, false_0 = (gold @ full + 0.5) / (on + 1), ((1 - gold) @ full + 0.5) / (off + 1)
    q, hit, false, share = gold.astype(np.float64), hit_0, false_0, np.ones(full.shape[1])
    for step in range(rounds):
        if step in (4, 8, 12):  # what voters of one class still have in common
            c = np.zeros((full.shape[1],) * 2)
            for weight in (q, 1 - q):
                mass = weight.sum() + 1e-9
                d = (full - weight @ full / mass) * np.sqrt(weight)[:, None]
                cov = d.T @ d / mass
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                c = np.maximum(c, cov / sd[:, None] / sd[None, :])
            share = 1 / np.maximum(np.where(c > CORRELATED, c, 0).sum(0), 1)
        base = min(max(q.mean(), 1e-3), 1 - 1e-3)
        model = LabelModel(base, hit, false, share, 0.5, 0.5)
        by_votes = model.posterior(x)  # what the label is right in, by the voters alone
        model.label_hit = min(0.98, (by_votes @ gold + 9) / (by_votes.sum() + 10))
        model.label_false = max(0.005, ((1 - by_votes) @ gold + 0.2) / ((1 - by_votes).sum() + 10))
        q = model.posterior(x, gold)
        hit = np.clip((q @ full + on * hit_0) / (q.sum() + on), 1e-4, 1 - 1e-4)
        false = np.clip(((1 - q) @ full + off * false_0) / ((1 - q).sum() + off), 1e-5, 1 - 1e-4)
    return model


def label_model(x: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """P(toxic) of each row."""
    return fit_label_model(x, gold).posterior(x, gold)


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.1, rounds: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias of logistic regression on soft labels, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    if start is None:
        w[-1] = math.log(max(q.mean(), 1e-4) / max(1 - q.mean(), 1e-4))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = (q - p) @ a - penalty * w
        curve = (a * np.maximum(p * (1 - p), 1e-6).astype(a.dtype)[:, None]).T @ a
        step = np.linalg.solve(curve.astype(np.float64) + np.diag(penalty), gradient)
        w += step * min(1.0, 8 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrated(x: np.ndarray, q: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier, its scores calibrated by the labels of rows that
    weren't trained on: rows are dealt to ``FOLDS`` parts in their order."""
    whole = linear(x, q)
    part, z = np.arange(len(x)) % FOLDS, np.zeros(len(x))
    for k in range(FOLDS):
        w = linear(x[part != k], q[part != k], rounds=8, start=whole)
        z[part == k] = x[part == k] @ w[:-1] + w[-1]
    scale, offset = linear(z[:, None], gold, 1e-3)
    if scale <= 0:  # the scores say nothing
        scale, offset = 1.0, 0.0
    return np.round(whole[:-1] * scale, 9), round(float(whole[-1] * scale + offset), 9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_SAMPLE) -> Model:
    """The classifier, fitted on at most ``limit`` labelled rows."""
    sample = sample_rows(docs, labels, id_col, text_col, label_col, limit).persist()
    try:
        n, positives = sample.agg(F.count("label"), F.sum("label")).first()
        lexicon = [w.encode() + b"$" for w in LEXICON]
        if not n or not 0 < positives < n:
            rate = min(max((positives or 0) / n if n else 0.05, 0.01), 0.99)
            return Model({w: 4.0 for w in lexicon}, math.log(rate / (1 - rate)))
        patterns = list(dict.fromkeys([*lexicon, *mine(sample, positives, n)]))
        x, gold = votes(sample, patterns)
    finally:
        sample.unpersist()
    kept = unlike(x)
    kept = [kept[j] for j in needed(x[:, kept], gold)]
    if not kept:
        return Model({w: 4.0 for w in lexicon}, math.log(gold.mean() / (1 - gold.mean())))
    x, patterns = x[:, kept], [patterns[j] for j in kept]
    q = label_model(x[:, families(patterns)], gold)
    weights, bias = calibrated(x.astype(np.float32), (q > 0.5).astype(np.float64), gold)
    return Model(dict(zip(patterns, weights.tolist(), strict=True)), bias)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with a score from 0 to 1 and a 0/1 decision."""
    schema = appended(df, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            s = np.array([scorer(t) for t in texts(batch, text_col)], np.float64)
            yield with_columns(batch, schema, **{score_col: pa.array(s), predicted_col: pa.array((s >= threshold).astype(np.int32))})

    return map_arrow_stream(df, run, schema)


def clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows that count as toxic."""
    score_col, predicted = fresh(df, "__score"), fresh(df, "__toxic")
    return score(df, model, text_col, score_col, predicted, threshold).where(F.col(predicted) == 0).select(*map(column, df.columns))
