"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Features of a text are rates and counts: hits in a lexicon, hits near a word in
the second person, capitals, punctuation, obfuscated words.  The lexicon is a
short fixed list and what the training sample teaches: words, and beginnings of
words, that stand in toxic documents far more often than in others.  Each half
of the sample gets its features under the lexicon that the other half teaches,
so no feature is fitted on the row that the trees learn it from; three quarters
of the rows train the trees, the rest the calibration.

The training sample is at most ``SAMPLE`` labelled rows, in the order of a hash
of their ids; only counts of words (bounded by the sample) and feature rows of
the sample come to the driver.  Every document is scored from its whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.llm import store, words

#: Labelled rows that are learned from, at most; they bound the learned lexicon and everything else that is fitted.
SAMPLE = 24_000
#: Parts that take turns in giving the scores to calibrate on.
FOLDS = 4
BEGINNING = 5
NEAR = 5
REMEMBER = 300_000

# Insults, and words in the second person.
INSULTS = frozenset("arsehole asshole bastard bitch clown crap cretin disgusting dumb fool garbage hate idiot imbecile jerk loser moron pathetic pig scum shit stupid trash ugly vermin worthless".split())
SECOND = frozenset("you your yours yourself ya u du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tus su".split())
# Characters that stand for letters.
LEET = str.maketrans("013457@$!|€", "oieastasile")

FEATURES = ("log_words", "fixed_rate", "fixed_hits", "learned_rate", "learned_hits", "learned_weight", "heaviest", "near_second", "second_rate", "capitals", "caps_words", "exclaims", "punctuation", "symbols", "obfuscated", "digits")
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»¿¡…“”„’‘"
_LEAD = _EDGE.replace("$", "").replace("@", "")


def plain(word: str) -> str:
    """A word in lower case, without marks around it, and with letters for what stands for them inside."""
    word = unicodedata.normalize("NFKC", word).lower().rstrip(_EDGE).lstrip(_LEAD)
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = word.translate(LEET)
        word = "".join(c for c in word if c.isalpha())
    return word


def entries(text: str) -> set[str]:
    """What the lexicon is learned from: distinct words and beginnings of longer words."""
    found = {plain(w) for w in set(text.split())} - {""}
    return found | {w[:BEGINNING] + "*" for w in found if len(w) > BEGINNING}


class Features:
    """Feature rows of texts under a lexicon (entry: weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def _code(self, word: str) -> int:
        """Bits: 0 fixed, 1 second person, 2 all capitals, 3 obfuscated; from 8 on the learned weight in sixteenths; from 16 on capitals beyond A to Z."""
        w = plain(word)
        weight = max(self.lexicon.get(w, 0.0), self.lexicon.get(w[:BEGINNING] + "*", 0.0) if len(w) > BEGINNING else 0.0)
        inner = word.strip(".,;:()\"'")
        odd = bool(w) and any(not c.isalpha() and c not in "-'’" for c in inner)
        return (w in INSULTS) | (w in SECOND) << 1 | (len(inner) > 1 and inner.isupper()) << 2 | odd << 3 | int(min(weight, 15) * 16) << 8 | (0 if word.isascii() else sum(c.isupper() and not c.isascii() for c in word)) << 16

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        rows = np.zeros((len(texts), len(FEATURES)))
        known = self.known
        for n, raw in enumerate(texts):
            own = raw.decode().split()
            if not own:
                continue
            try:
                codes = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            except KeyError:
                if len(known) > REMEMBER:
                    known.clear()
                for w in own:
                    if w not in known:
                        known[w] = self._code(w)
                codes = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            weight = (codes >> 8 & 255) / 16.0
            fixed, second, hit = codes & 1, (codes >> 1) & 1, (weight > 0) | (codes & 1 > 0)
            upto = np.concatenate(([0], np.cumsum(second)))
            at = np.flatnonzero(hit)
            near = (upto[np.minimum(at + NEAR + 1, len(own))] - upto[np.maximum(at - NEAR, 0)]) > 0
            k = len(own)
            rows[n, :9] = np.log1p(k), fixed.sum() / k, np.log1p(fixed.sum()), (weight > 0).sum() / k, np.log1p((weight > 0).sum()), weight.sum() / k, weight.max(), np.log1p(near.sum()), second.sum() / k
            rows[n, 9], rows[n, 10], rows[n, 14] = (codes >> 16).sum() / len(raw), ((codes >> 2) & 1).sum() / k, ((codes >> 3) & 1).sum() / k
        for a, b in words.blocks(texts):
            block = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
            begins = np.concatenate(([0], ends[:-1]))
            sizes = np.maximum(ends - begins - 1, 1)
            for column, table in _CLASSES.items():
                rows[a:b, column] += np.add.reduceat(table[block], begins, dtype=np.int64) / sizes
        return rows


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = {9: _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 11: _class("!?"), 12: _class(".,;:'\"()-"), 13: _class("#*$%&|<>@_^~"), 15: _class("0123456789")}


@dataclass
class Trees:
    """Boosted trees for a logistic loss, over values cut into bins; all trees are full to one depth."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)
        prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), prior)
        feature, threshold, leaf = np.zeros((n, 2**depth - 1), np.int32), np.full((n, 2**depth - 1), bins, np.int32), np.zeros((n, 2**depth))
        for t in range(n):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                width = 2**level
                gains = []
                for f in range(x.shape[1]):
                    key = node * bins + binned[:, f]
                    gl = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), 1)
                    hl = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), 1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
                    gains.append(np.where((hl >= least) & (hr >= least), gain, -1.0))
                gains = np.stack(gains, 1).reshape(width, -1)
                best = gains.argmax(1)
                own = slice(width - 1, 2 * width - 1)
                good = gains[np.arange(width), best] > 1e-9
                feature[t, own] = np.where(good, best // bins, 0)
                threshold[t, own] = np.where(good, best % bins, bins)
                node = 2 * node + (binned[np.arange(len(y)), feature[t, width - 1 + node]] > threshold[t, width - 1 + node])
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf[t] = rate * gs / (hs + ridge)
            score += leaf[t][node]
        return cls(cuts, feature, threshold, leaf, prior, depth)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1)
        score, rows = np.full(len(x), self.prior), np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (binned[rows, self.feature[t, at]] > self.threshold[t, at])
            score += self.leaf[t][node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of an increasing function, linear between them."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, pools[-1][2], high]
    knots, values = [], []
    for total, n, low, high in pools:
        for at in {low, high}:
            knots.append(at)
            values.append(min(max(total / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1)))
    order = np.argsort(knots, kind="stable")
    return np.array(knots)[order], np.maximum.accumulate(np.array(values)[order])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows), self.values[0])
        return np.clip(np.interp(self.trees(rows), self.knots, self.values), 0.0, 1.0)


def held_out(id_col: str):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that aren't held out.

    Null ids, labels and labels other than 0 and 1 are left out; a document's
    label counts once.  Without both labels the model gives one score to all:
    the labels' mean, 0 without any.
    """
    spark = docs.sparkSession
    place = store.folder(spark, "toxicity")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = known.withColumn("order", order).orderBy("order", "doc_id").limit(sample).withColumn("half", F.pmod(F.col("order"), F.lit(2)).cast("int"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = store.keep(texts.join(F.broadcast(chosen), "doc_id").repartition(store.partitions(spark)), f"{place}/sample")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model({}, None, np.zeros(1), np.array([float(1 in total)]))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(len(batch)):
                one = batch.slice(a, 1)
                own = pa.array(sorted(entries(one.column("text")[0].as_py())), pa.string())
                yield pa.RecordBatch.from_arrays([own, *[pa.array(np.full(len(own), one.column(c)[0].as_py(), np.int32)) for c in ("y", "half")]], names=["entry", "y", "half"])

    # Counts by half: the rows of a half have features under what the other half teaches; the lexicon in use is both's.
    sums = [F.sum(F.when(F.col("half") == h, F.lit(1)).otherwise(0) * (F.col("y") if c == "a" else 1 - F.col("y"))).alias(f"{c}{h}") for h in (0, 1) for c in ("a", "b")]
    n = rows.agg(*sums).first()
    counts = store.keep(rows.select("text", "y", "half").mapInArrow(words_of, "entry string, y int, half int").groupBy("entry").agg(*sums), f"{place}/counts")

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        of = lambda c: sum(F.col(f"{c}{h}") for h in halves)
        weight = F.log((of("a") + 0.5) / (sum(n[f"a{h}"] for h in halves) + 1)) - F.log((of("b") + 0.5) / (sum(n[f"b{h}"] for h in halves) + 1))
        sure = weight / F.sqrt(1 / (of("a") + 0.5) + 1 / (of("b") + 0.5))
        best = counts.filter(of("a") >= 2).select("entry", weight.alias("weight"), sure.alias("sure")).filter("weight > 1.5 and sure > 2.5")
        return {r["entry"]: r["weight"] for r in best.collect()}

    of_other = {0: lexicon((1,)), 1: lexicon((0,))}

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = {h: Features(x) for h, x in of_other.items()}
        for batch in batches:
            texts, half = words.as_bytes(batch.column("text")), batch.column("half").to_numpy()
            x = np.zeros((len(texts), len(FEATURES)))
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                if len(at):
                    x[at] = make[h]([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["order", "y", "x"])

    learned = rows.select("order", "text", "y", "half").mapInArrow(features_of, "order long, y int, x array<double>").toPandas().sort_values("order")
    x, y = np.stack(learned["x"]), learned["y"].to_numpy(float)
    # Each row is judged by trees that haven't seen it; the calibration of these scores serves the trees of all rows.
    fold, judged = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(min(FOLDS, len(y))):
        judged[fold == k] = Trees.fit(x[fold != k], y[fold != k])(x[fold == k])
    return Model(lexicon((0, 1)), Trees.fit(x, y), *isotonic(judged, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted (1 from 0.5 on) and the columns named in ``carry``, for every row.

    A null text is scored as empty.  Ids may be null or repeat.  An empty table
    gives an empty one.  Other columns of the input are not read; a carried
    column may not have the name of a column returned.
    """
    carry = list(carry or [])
    if clash := {"doc_id", "score", "predicted"} & set(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), *[F.col(c).alias("c_" + c) for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(model.lexicon)
        for batch in batches:
            s = model(make(words.as_bytes(batch.column("t"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())] + [batch.column("c_" + c) for c in carry], names=["doc_id", "score", "predicted", *carry])

    schema = "doc_id long, score double, predicted int" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, schema)
