"""Toxic passages by maximum-scoring segments over token log-odds.

A word's token weights come from how often labelled toxic and other texts use it. A word is seen at
three grains: its first four bytes, its first six, and whole. Each grain's share of toxic uses has a
Dirichlet prior of ``PRIOR`` uses at the coarser grain's share, the coarsest one at the overall share;
so a rare word is weighted as its stem is, and an unseen stem as nothing.

A linear scan (Ruzzo and Tompa 1999) finds every maximal segment of a text whose weights, less a
drift for each word, sum highest. How high a clean text's best segment gets follows an extreme-value
law: P(max > x) = 1 - exp(-K n exp(-lambda x)) for n words. lambda solves E[exp(lambda * weight)] = 1
over clean words, K is fitted to clean texts' maxima. Segments of small E-value are significant; a
text's evidence is the sum over all its significant segments of -log10 of their E-values (or that of
the best one, where none is significant), its score a logistic function of the evidence.

Counts are kept by hash in a table of fixed size, so the model that is broadcast has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe_codec import pack_numbers, unpack_numbers
from cairn.llm.words import Words, portions, tidy
from cairn.session import bounded_batches, small_side, without

GRAINS, HASH_BITS = (4, 6, 1 << 30), 19
CELLS, BLOCKS = 1 << HASH_BITS, 64
PRIOR, DRIFT = 10.0, 1.0
#: Bins of word weights; and the range in which evidence counts: beyond it a text is no clearer.
WEIGHT_BINS, EVIDENCE = 400, (-3.0, 10.0)
#: Segments count, and are reported, up to this E-value.
E_VALUE = 0.1


def _cells(words: Words) -> Iterator[list[np.ndarray]]:
    """Block by block, each word's cell at each grain."""
    for hashes in words.by_block(*GRAINS):
        yield [(h & np.uint64(CELLS - 1)).astype(np.int64) for h in hashes]


@dataclass
class Model:
    """Toxic and all uses by grain and cell, the overall toxic share, and the fitted laws."""

    toxic: np.ndarray
    uses: np.ndarray
    share: float
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    middle: float = 3.0

    def weights(self, words: Words) -> np.ndarray:
        """Log-odds of each word against the overall share."""
        out = []
        for block in _cells(words):
            share = np.full(len(block[0]), self.share)
            for g, cells in enumerate(block):
                share = (self.toxic[g][cells] + PRIOR * share) / (self.uses[g][cells] + PRIOR)
            out.append(np.log(share / (1 - share)) - np.log(self.share / (1 - self.share)))
        return np.concatenate(out)

    def log_expected(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of 1 / (expected segments as good as ``best`` in clean texts of ``n`` words)."""
        return (self.decay * best - np.log(self.scale * np.maximum(n, 1))) / np.log(10)

    def evidence(self, weights: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float, float]]]]:
        """Each text's summed evidence; and by text its significant segments ``(start, end, sum, e_value)``.

        Only a text whose best segment is significant can have others that are.
        """
        n, least, found = np.diff(bounds), -np.log10(E_VALUE), {}
        total = self.log_expected(best_segments(weights, bounds), n)
        for k in np.flatnonzero(total >= least).tolist():
            own = maximal_segments(weights[bounds[k] : bounds[k + 1]])
            logs = self.log_expected(np.array([w for _, _, w in own]), n[k])
            found[k] = [(*segment, float(10.0 ** -min(e, 300))) for segment, e in zip(own, logs.tolist(), strict=True) if e >= least]
            total[k] = max(total[k], logs[logs >= least].sum())
        return total, found

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.slope * (np.clip(evidence, *EVIDENCE) - self.middle)))


def best_segments(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the best segment of each text, 0 where none is positive; linear in the words."""
    out = np.zeros(len(bounds) - 1)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            sums = np.concatenate([[0.0], np.cumsum(weights[a:b])])
            out[k] = max(0.0, float((sums[1:] - np.minimum.accumulate(sums)[:-1]).max()))
    return out


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, sum)``, in order: none can be extended, none overlap."""
    found: list[list] = []  # start, end, sum before, sum up to the end, the last one before that begins lower
    total = 0.0
    blocks = (weights[a : a + (1 << 16)].tolist() for a in range(0, len(weights), 1 << 16))
    for i, w in enumerate(chain.from_iterable(blocks)):
        if w <= 0:
            total += w
            continue
        new = [i, i + 1, total, total + w]
        total += w
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses by fold, grain and cell in one task's texts, packed by block of cells."""
    totals = {}
    for batch in batches:
        toxic, fold = (batch.column(k).to_numpy() for k in (1, 2))
        for i, j, words in portions(batch.column(0)):
            kind, done = np.repeat((2 * fold + toxic)[i:j].astype(np.int8), words.counts()), 0
            for block in _cells(words):
                own = kind[done : done + len(block[0])]
                done += len(own)
                for g, cells in enumerate(block):
                    for f, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
                        on = cells[own == 2 * f + label]
                        if len(on):
                            at = totals.setdefault((f, g, label), np.zeros(CELLS, np.uint32))
                            at += np.bincount(on, minlength=CELLS).astype(np.uint32)
    rows = []
    size = CELLS // BLOCKS
    for (f, g, label), counts in totals.items():
        for block in range(BLOCKS):
            own = counts[block * size : (block + 1) * size]
            at = np.flatnonzero(own)
            rows.append((f, g, label, block, at.astype(np.uint16).tobytes(), own[at].astype(np.int64).tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["fold", "grain", "label", "block", "cells", "counts"])


def _add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS // BLOCKS, np.int64)
    for batch in batches:
        for cells, counts in zip(batch.column("cells"), batch.column("counts"), strict=True):
            total[np.frombuffer(cells.as_py(), np.uint16)] += np.frombuffer(counts.as_py(), np.int64)
    fold, grain, label, block = (k.as_py() for k in key)
    yield pa.RecordBatch.from_pydict({"fold": [fold], "grain": [grain], "label": [label], "block": [block], "counts": [pack_numbers(total)]})


def _counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and all uses, by fold, grain and cell: a table of fixed size."""
    tallied = texts.mapInArrow(tidy(_tally), "fold long, grain long, label long, block long, cells binary, counts binary")
    summed = tallied.groupBy("fold", "grain", "label", "block").applyInArrow(_add_up, "fold long, grain long, label long, block long, counts binary")
    counts = np.zeros((2, 2, len(GRAINS), BLOCKS, CELLS // BLOCKS), np.float32)
    for row in summed.collect():  # at most 2 * 3 * 2 * 64 rows of some 10 kB
        counts[row.label, row.fold, row.grain, row.block] = unpack_numbers(row.counts)
    counts = counts.reshape(2, 2, len(GRAINS), CELLS)
    counts[0] += counts[1]
    return counts[1], counts[0]


def _model(toxic: np.ndarray, uses: np.ndarray) -> Model:
    n = float(uses[0].sum())
    share = min(max(float(toxic[0].sum()) / n if n else 0.0, 1e-4), 1 - 1e-4)
    return Model(toxic, uses, share)


def _decay(counts: np.ndarray, middles: np.ndarray) -> float:
    """The positive root of E[exp(decay * weight)] = 1, by bisection; 1 if weights are never positive."""
    p = counts / max(counts.sum(), 1)
    if not p[middles > 0].sum() or (p * middles).sum() >= 0:
        return 1.0
    low, high = 1e-6, 50.0 / middles[p > 0].max()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * middles, 500))).sum() < 1 else (low, mid)
    return low


def fit(texts: DataFrame) -> Model:
    """A model from ``texts`` (text, toxic, fold): fold 0 gives weights, fold 1 the laws that calibrate them.

    Fold 1 is scored with fold 0's weights, so that no text is judged by its own words; the final
    weights then use both folds. Without labelled texts of both kinds scores are all below one half.
    """
    spark = texts.sparkSession
    toxic, uses = _counted(texts)
    first = _model(toxic[0], uses[0])
    shared = spark.sparkContext.broadcast(first)
    middles = np.linspace(-10, 10, WEIGHT_BINS)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clean words' weights by bin; and clean texts' words and number by their best segment, in tenths."""
        model, by_weight, by_text = shared.value, np.zeros(WEIGHT_BINS, np.int64), {}
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, j, words in portions(batch.column(0)):
                weights = model.weights(words) - DRIFT
                clean = np.repeat(label[i:j] == 0, words.counts())
                by_weight += np.bincount(np.clip(np.round((weights[clean] + 10) / 20 * (WEIGHT_BINS - 1)), 0, WEIGHT_BINS - 1).astype(int), minlength=WEIGHT_BINS)
                of_clean = label[i:j] == 0
                best = np.round(np.minimum(best_segments(weights, words.bounds)[of_clean], 500) * 10).astype(int)
                for k, n in zip(best.tolist(), np.maximum(words.counts()[of_clean], 1).tolist(), strict=True):
                    had = by_text.get(k, (0, 0))
                    by_text[k] = had[0] + n, had[1] + 1
        rows = [(0, k, int(c), 0) for k, c in enumerate(by_weight) if c] + [(1, k, *v) for k, v in by_text.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["kind", "a", "n", "texts"])

    tallied = texts.where("fold = 1").select("text", "toxic").mapInArrow(tidy(profile), "kind long, a long, n long, texts long")
    rows = tallied.groupBy("kind", "a").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).collect()  # at most 400 + 5,001 rows
    shared.unpersist()
    by_weight = np.zeros(WEIGHT_BINS)
    for r in rows:
        if r.kind == 0:
            by_weight[r.a] = r.n
    clean = np.array([(r.a / 10, r.n, r.texts) for r in rows if r.kind == 1] or np.empty((0, 3)), float).reshape(-1, 3)
    first.decay = _decay(by_weight, middles)
    if len(clean):  # the mean of K n exp(-decay x) over clean maxima is 1 under the law
        first.scale = float(clean[:, 2].sum() / max((clean[:, 1] * np.exp(-first.decay * clean[:, 0])).sum(), 1e-300))
    shared = spark.sparkContext.broadcast(first)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts by label and evidence, in hundredths."""
        model, seen = shared.value, {}
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, j, words in portions(batch.column(0)):
                evidence = np.clip(model.evidence(model.weights(words) - DRIFT, words.bounds)[0], *EVIDENCE)
                for key in zip(label[i:j].tolist(), np.round(evidence * 100).astype(int).tolist(), strict=True):
                    seen[key] = seen.get(key, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(*k, c) for k, c in seen.items()], strict=True)], ["kind", "a", "n"])

    weighed = texts.where("fold = 1").select("text", "toxic").mapInArrow(tidy(weigh), "kind long, a long, n long")
    rows = weighed.groupBy("kind", "a").agg(F.sum("n").alias("n")).collect()  # at most 2 * 1301 rows
    shared.unpersist()
    table = np.array([(r.kind, r.a / 100, r.n) for r in rows] or np.empty((0, 3)), float).reshape(-1, 3)
    slope, middle = _logistic(table[:, 1], table[:, 0], table[:, 2])
    final = _model(toxic.sum(axis=0), uses.sum(axis=0))
    final.decay, final.scale, final.slope, final.middle = first.decay, first.scale, slope, middle
    return final


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic law with a weak pull towards slope 1; a middle beyond reach without both labels."""
    if not (n[y == 1].sum() and n[y == 0].sum()):
        return 1.0, EVIDENCE[1] + 10
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(n * (y - p)).sum(), (n * (y - p) * x).sum() - (b - 1)])
        hessian = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + step[0], max(b + step[1], 0.05)
        if np.abs(step).max() < 1e-8:
            break
    return float(b), float(-a / b)


def held_out_by(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training texts: rows whose crc32 of doc_id leaves 1, 2, 3 (fold 0) or 4 (fold 1) when divided by five.

    Where a document has several labels, toxic counts. Null labels are none.
    """
    part = held_out_by("doc_id", 5)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.where(part != 0).select(F.col("doc_id").alias("_label_of"), "toxic", F.when(part == 4, 1).otherwise(0).cast("long").alias("fold"))
    known = small_side(known, 40)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("_label_of")).select("text", "toxic", "fold")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", segments: bool = False) -> DataFrame:
    """``(doc_id, score, evidence)`` per row, and with ``segments`` the significant passages.

    A passage is ``(start, end, weight, e_value)``, in words. Null, empty and blank texts get the score
    of a text without evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, words in portions(batch.column(1)):
                weights = model.weights(words) - DRIFT
                evidence, found = model.evidence(weights, words.bounds)
                columns = {"doc_id": batch.column(0).slice(i, j - i), "score": pa.array(model.score(evidence)), "evidence": pa.array(evidence)}
                if segments:
                    passages = [[dict(zip(("start", "end", "weight", "e_value"), r, strict=True)) for r in found.get(k, [])] for k in range(j - i)]
                    columns["passages"] = pa.array(passages, kind)
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, score double, evidence double" + ", passages array<struct<start: long, end: long, weight: double, e_value: double>>" * segments
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, segments: bool = False) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` for every row of ``docs``.

    held_out rows (crc32 of doc_id as text divisible by five) are never learned from; a null
    doc_id has held_out null and is scored. Repeated rows score alike; an empty table gives no rows, and
    without labels of both kinds nothing is predicted toxic; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    scored = score(docs, fit(labelled(docs, labels)), segments=segments)
    rest = ["passages"] * segments
    return scored.select("doc_id", (held_out_by("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", *rest)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; all rows of such a doc_id go."""
    return without(docs, toxicity(docs, labels).where("predicted = 1"), "doc_id")
