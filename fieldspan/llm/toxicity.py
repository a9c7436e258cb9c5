"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of the word and of its first four and five letters, by
hash. Filters of widths 1, 2 and 3 slide over the words of the whole text; each filter's maximum goes
into a logistic output. Scores are set to the labelled share; decision thresholds are calibrated for
each language on rows kept out of the fit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut, table

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 12
#: Labelled rows of each class that the network is fitted on, at most about so many, drawn by a hash.
FIT_ROWS = 2000
#: Words that are convolved at once.
CHUNK = 1 << 15
MARKS = ".,;:!?*%$&#()\"'-"
PAD = max(WIDTHS) - 1


def word_buckets(word: str) -> tuple[int, int, int]:
    w = word.strip(MARKS) or word
    return tuple(zlib.crc32((tag + part).encode("utf-8", "replace")) % BUCKETS for tag, part in (("w", w), ("4", w[:4]), ("5", w[:5])))


class Words:
    """Bucket triples of words, remembered: word -> row of a table. Row 0 is padding.

    The caller clears it between groups of texts once it holds more than `keep` words."""

    def __init__(self, keep: int = 200_000):
        self.keep = keep
        self.clear()

    def clear(self):
        self.row: dict[str, int] = {}
        self.triples = [(0, 0, 0)]

    def rows(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        row, triples = self.row, self.triples
        for w in set(words).difference(row):
            row[w] = len(triples)
            triples.append(word_buckets(w))
        return np.fromiter(map(row.__getitem__, words), np.int32, len(words))


@dataclass
class Net:
    """emb (BUCKETS x DIM), filt (width -> offsets x DIM x FILTERS), bias, out, out_bias, thresholds by language."""

    emb: np.ndarray
    filt: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    @staticmethod
    def fresh(seed: int = 0) -> Net:
        r = np.random.default_rng(seed)
        k = FILTERS * len(WIDTHS)
        return Net((r.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32),
                   {w: (r.standard_normal((w, DIM, FILTERS)) * 0.3 / w**0.5).astype(np.float32) for w in WIDTHS},
                   np.zeros(k, np.float32), (r.random(k) * 0.2).astype(np.float32), 0.0)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Responses (rows x all filters) of windows that start at each row; PAD rows must follow."""
        parts = []
        for w in WIDTHS:
            y = x @ self.filt[w].transpose(1, 0, 2).reshape(DIM, -1)
            total = y[:, :FILTERS].copy()
            for o in range(1, w):
                total[:-o] += y[o:, o * FILTERS:(o + 1) * FILTERS]
            parts.append(total)
        return np.hstack(parts)

    def pool(self, docs: list[np.ndarray], vec: np.ndarray, where: bool = False):
        """Maxima (docs x filters), -inf for no word; where: also the words at which the windows start."""
        k = FILTERS * len(WIDTHS)
        best = np.full((len(docs), k), -np.inf, np.float32)
        place = np.zeros((len(docs), k), np.int64)
        at = 0
        while at < len(docs):
            group, size = [], 0
            while at + len(group) < len(docs) and (not group or size + len(docs[at + len(group)]) <= CHUNK):
                group.append(docs[at + len(group)])
                size += len(group[-1])
            if len(group) == 1 and size > CHUNK:  # one long text, in parts that overlap by PAD words
                for s in range(0, size, CHUNK):
                    part = np.concatenate([group[0][s:s + CHUNK + PAD], np.zeros(PAD, np.int32)])
                    y = self.convolve(vec[part])[:min(CHUNK, size - s)]
                    m = y.max(0)
                    up = m > best[at]
                    best[at, up] = m[up]
                    if where:
                        place[at, up] = s + y.argmax(0)[up]
            else:
                n = np.array([len(d) for d in group])
                start = np.cumsum(n + PAD) - (n + PAD)
                rows = np.zeros(int((n + PAD).sum()), np.int32)
                real = np.zeros(len(rows), bool)
                for d, s in zip(group, start.tolist(), strict=True):
                    rows[s:s + len(d)] = d
                    real[s:s + len(d)] = True
                y = self.convolve(vec[rows])
                y[~real] = -np.inf
                best[at:at + len(group)] = np.maximum.reduceat(y, start, axis=0)
                if where:
                    for j, s in enumerate(start.tolist()):
                        if n[j]:
                            place[at + j] = y[s:s + n[j]].argmax(0)
            at += len(group)
        return (best, place) if where else best

    def logit(self, best: np.ndarray) -> np.ndarray:
        hidden = np.where(np.isfinite(best), np.maximum(best + self.bias, 0), 0)
        return hidden @ self.out + self.out_bias

    def score(self, docs: list[np.ndarray], vec: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pool(docs, vec)), -60, 60)))

    def vectors(self, triples: np.ndarray) -> np.ndarray:
        """Word vectors of bucket triples; row 0 is padding and stays zero."""
        v = self.emb[triples].sum(1)
        v[0] = 0
        return v


def seed_embeddings(net: Net, docs: list[np.ndarray], triples: np.ndarray, y: np.ndarray, least: int = 3) -> None:
    """Start the first dimension from how much more often a bucket is in texts of class 1 (at least
    `least` of them), and let the first filter of each width look at it; the rest starts at random."""
    n = np.zeros((2, BUCKETS))
    for d, c in zip(docs, y, strict=True):
        n[int(c), np.unique(triples[np.unique(d)])] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    net.emb[:, 0] = np.where(n[1] >= least, np.clip(odds, 0, 4), 0) / 2
    for j, w in enumerate(WIDTHS):
        net.filt[w][:, :, 0] *= 0.1
        net.filt[w][:, 0, 0] = 1.0 / w
        net.out[j * FILTERS] = 1.0


def fit(docs: list[np.ndarray], triples: np.ndarray, y: np.ndarray, epochs: int = 12, steps: int = 1200, batch: int = 32, rate: float = 0.05, seed: int = 0) -> Net:
    """Adagrad on the logistic loss, both classes weighing the same; docs hold rows of triples.
    At least `steps` steps, so that few texts are gone through more often."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    seed_embeddings(net, docs, triples, y)
    epochs = max(epochs, -(-steps * batch // max(1, len(docs))))
    more = float((y == 0).sum() / max(1, (y == 1).sum()))
    weight = np.where(y == 1, more, 1).astype(np.float32)
    weight /= weight.mean()
    names = [*(("filt", w) for w in WIDTHS), "bias", "out"]
    get = lambda n: net.filt[n[1]] if isinstance(n, tuple) else getattr(net, n)
    seen = {n: np.full_like(get(n), 1e-2) for n in names}
    seen_emb, seen_b = np.full(BUCKETS, 1e-2, np.float32), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        step = rate / (1 + 2 * epoch / epochs)
        vec = net.vectors(triples)
        for s in range(0, len(order), batch):
            at = order[s:s + batch]
            group = [docs[i] for i in at]
            used = np.unique(np.concatenate([*group, np.zeros(1, np.int32)]))
            vec[used] = net.emb[triples[used]].sum(1)
            vec[0] = 0
            best, place = net.pool(group, vec, where=True)
            real = np.isfinite(best)
            hidden = np.where(real, np.maximum(best + net.bias, 0), 0)
            z = hidden @ net.out + net.out_bias
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[at]).astype(np.float32) * weight[at] / len(at)
            grads = {"out": hidden.T @ err + 1e-5 * net.out}
            g = np.where(real & (hidden > 0), err[:, None] * net.out[None, :], 0).astype(np.float32)
            grads["bias"] = g.sum(0)
            emb_rows, emb_grad = [], []
            padded = [np.concatenate([d, np.zeros(PAD, np.int32)]) if len(d) else np.zeros(PAD + 1, np.int32) for d in group]
            for j, w in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                grads["filt", w] = np.zeros_like(net.filt[w])
                for o in range(w):
                    rows = np.stack([p[place[i, cols] + o] for i, p in enumerate(padded)])
                    grads["filt", w][o] = np.einsum("bk,bkd->dk", g[:, cols], vec[rows])
                    emb_rows.append(rows.ravel())
                    emb_grad.append((g[:, cols, None] * net.filt[w][o].T[None]).reshape(-1, DIM))
            rows, grad = np.concatenate(emb_rows), np.concatenate(emb_grad)
            live = (rows > 0) & (np.abs(grad).sum(1) > 0)
            buckets, inv = np.unique(triples[rows[live]].ravel(), return_inverse=True)
            total = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(total, inv, np.repeat(grad[live], 3, axis=0))
            seen_emb[buckets] += (total**2).mean(1)
            net.emb[buckets] -= step * total / np.sqrt(seen_emb[buckets])[:, None]
            for n, v in grads.items():
                seen[n] += v**2
                p = get(n)
                p -= step * v / np.sqrt(seen[n])
            e = float(err.sum())
            seen_b += e * e
            net.out_bias -= step * e / seen_b**0.5
    net.out_bias -= float(np.log(more))
    return net


def best_threshold(score: np.ndarray, y: np.ndarray, around: float = 0.3) -> float:
    """Threshold with the best F1 (ties: nearest to `around`); between two scores it lies in the middle."""
    if not y.any():
        return around
    cuts = np.unique(score)
    cuts = np.concatenate([[around], (cuts[1:] + cuts[:-1]) / 2])
    hit = np.array([(y[score >= c]).sum() for c in cuts])
    said = np.array([(score >= c).sum() for c in cuts])
    f1 = 2 * hit / np.maximum(1, said + y.sum())
    good = cuts[f1 >= f1.max() - 1e-12]
    return float(good[np.argmin(np.abs(good - around))])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, lang_col: str, label_col: str, fit_rows: int) -> Net | float:
    """A fitted net, or a constant score where fewer than two classes are labelled."""
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 4) != 2)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    # only documents that exist count: labels may name others
    given = cut(given.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "labels")
    counts = {r.y: r.n for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return float(counts.get(1, 0) > 0) if counts else 0.0
    share = {k: min(1.0, fit_rows / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * (1 << 20)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                words = (r["text"] or "").lower().split()
                yield pa.RecordBatch.from_pylist([{"id": str(r["id"]), "lang": r["lang"], "y": r["y"], "t": np.array(
                    [word_buckets(w) for w in words], "<u2").tobytes()}], schema=pa.schema([("id", pa.string()), ("lang", pa.string()), ("y", pa.int32()), ("t", pa.binary())]))

    # the drawn labels are at most about 2 * fit_rows rows of two numbers, a bound that is a parameter
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).join(
        F.broadcast(given.where(draw)), "id")
    got = sample.select("id", "text", "lang", "y").mapInArrow(run, "id string, lang string, y int, t binary").collect()
    got.sort(key=lambda r: (r.id, r.t))
    y = np.array([r.y for r in got], np.float32)
    # distinct triples become rows of one table
    sizes = [len(r.t) // 6 for r in got]
    flat = np.concatenate([np.zeros((1, 3), np.int64)] + [np.frombuffer(r.t, "<u2").reshape(-1, 3).astype(np.int64) for r in got])
    code = flat[:, 0] << 32 | flat[:, 1] << 16 | flat[:, 2]
    code[0] = -1
    u, inv = np.unique(code, return_inverse=True)
    triples = np.stack([u >> 32 & 0xFFFF, u >> 16 & 0xFFFF, u & 0xFFFF], 1)
    triples[0] = 0
    ends = 1 + np.cumsum(sizes)
    texts = [inv[e - n:e].astype(np.int32) for e, n in zip(ends, sizes, strict=True)]
    del flat, code, inv
    kept_out = np.array([zlib.crc32(("v" + r.id).encode()) % 5 == 0 for r in got])
    if kept_out.all() or len(set(y[~kept_out])) < 2:
        kept_out[:] = False
    pick = np.flatnonzero(~kept_out)
    net = fit([texts[i] for i in pick], triples, y[pick])
    net.out_bias += float(np.log(share[0] / share[1]))
    score = net.score(texts, net.vectors(triples))
    judge = kept_out if kept_out.any() else ~kept_out
    langs = np.array([r.lang or "" for r in got], object)
    # the sample has more toxic rows than the corpus; only where a language has enough does it get its own threshold
    net.threshold = min(0.5, max(0.1, best_threshold(score[judge], y[judge])))
    for name in sorted(set(langs[judge])):
        own = judge & (langs == name)
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            net.thresholds[name] = min(0.5, max(0.1, best_threshold(score[own], y[own])))
    return net


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             label_col: str = "toxic", fit_rows: int = FIT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, held_out, score, toxic (the decision by language), then `keep` columns.

    The net learns only from labelled rows whose crc32(id) mod 4 is not 2, at most about fit_rows of each
    class; conflicting labels of an id count as toxic; null labels and labels without a document are left
    out. With one class labelled every score is 1 or 0, with none 0. A null or empty text has no window:
    its score is that of the output's bias. Texts of any length are read whole, in overlapping parts;
    repeated rows score alike; an empty table gives no rows; columns not named are not read.
    """
    net = train(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, label_col=label_col, fit_rows=fit_rows)
    # text and language are sent to Python once, also where they are kept
    base = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"),
                       (crc_mod(id_col, 4) == 2).alias("held_out"), F.col(id_col), *[F.col(c) for c in keep if c not in (text_col, lang_col)])

    def run(batches):
        words, vec = Words(), np.zeros((0, DIM), np.float32)
        for b in batches:
            texts, langs = b.column(0), b.column(1)
            for at in range(0, len(texts), 64):
                t, names = texts.slice(at, 64).to_pylist(), langs.slice(at, 64).to_pylist()
                if isinstance(net, float):
                    score, limit = np.full(len(t), net), np.full(len(t), 0.5)
                else:
                    if len(words.row) > words.keep:
                        words.clear()
                        vec = vec[:0]
                    rows = [words.rows(x) for x in t]
                    if len(vec) < len(words.triples):
                        new = net.emb[np.array(words.triples[len(vec):])].sum(1)
                        if not len(vec):
                            new[0] = 0
                        vec = np.concatenate([vec, new])
                    score = net.score(rows, vec).astype(np.float64)
                    limit = np.array([net.thresholds.get(n or "", net.threshold) for n in names])
                cols = [b.column(i).slice(at, 64) for i in sent]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array(score >= limit)], names=[f.name for f in schema.fields])

    plain = base.columns
    sent = [2, 3, *(0 if c == text_col else 1 if c == lang_col else plain.index(c, 3) for c in keep)]
    names = ["held_out", id_col, *keep]
    schema = T.StructType([*(T.StructField(n, base.schema.fields[i].dataType) for n, i in zip(names, sent, strict=True)),
                           T.StructField("score_", T.DoubleType()), T.StructField("toxic_", T.BooleanType())])
    return base.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), toxic_by_lang of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", F.col("score_").alias("score"), (F.col("score_") >= 0.3).cast("int").alias("predicted"),
                      F.col("toxic_").alias("toxic_by_lang"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
