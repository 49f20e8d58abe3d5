"""Hierarchical empirical-Bayes quality classifier.

Evidence comes from three levels. A document classifier, fitted on labelled rows, gives log-likelihood ratios: naive
Bayes over binned surface measurements for quality, and a lexicon of significant words for toxicity. Labelled rows
summed per host and per path (beta-binomial counts) give the sites' rates: a path's rate is shrunk toward its host's,
the host's toward the global rate, with prior strengths fitted by moments over the sites, so sparse sites move
little. The posterior of a document is its site's log-odds plus its own evidence.

Fitting reads at most SAMPLE labelled documents (those of smallest hashed id); the sites' counts use every label,
and every document is scored.

Defined results: a null or empty text has no evidence and is judged by its site alone; a null host or path is the
site of null; contradicting labels of one document each count; without labels the global rates are 1/2 and every
document is kept; an empty table gives an empty table; ties at exactly the threshold are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Words of the lexicon, at most; documents a word must be seen in among toxic ones; the least lower bound of its log-odds.
LEXICON, SUPPORT, SIGNIFICANT = 2_000, 5, 1.0
#: A text's lexicon score is the sum of its three weightiest words; its bins are halves.
HEAVIEST, SCORES = 3, 40
BINS = 12
MEASURES = ("symbols", "capitals", "exclaims", "stutters", "distinct", "lines", "word_length", "digits")
#: Evidence is capped at this many nats, and a site's log-odds may differ from the global ones by this many.
CAP, SITE_CAP = 8.0, 1.5
THRESHOLD = 0.5

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = ".,;:!?\"'()[]{}«»“”’*#$%&|<>"


def measure(text: str) -> tuple[list[float], set[str]]:
    """Surface measurements of one text, each from 0 to 1, and its distinct lower-case words."""
    raw = text.encode()
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES), set()
    letters = max(len(raw) - raw.count(b" "), 1)
    plain = set(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS)) + sum(raw.count(bytes((0xC3, b))) for b in (0x80, 0x87, 0x88, 0x89, 0x8A, 0x96, 0x9C))
    stutters = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    found = [
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / letters * 2,
        capitals / letters,
        raw.count(b"!") / n,
        stutters / n,
        1 - len(plain) / n,
        1 - len(set(lines)) / len(lines),
        letters / n / 20,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / letters,
    ]
    return [min(x, 1.0) for x in found], {w.strip(_PUNCTUATION).lower() for w in plain}


def _bin(values: np.ndarray) -> np.ndarray:
    """Bins of the measurements: square-root spaced, fine near zero."""
    return np.minimum((np.sqrt(values) * BINS).astype(np.int64), BINS - 1)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and the two labels of at most ``sample`` labelled documents, of smallest hashed id.

    The bound is a hash threshold found on the labels alone; documents are picked by a broadcast of those ids.
    """
    rows = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select("doc_id", "quality", "toxic")
    n = rows.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = rows.where(spread < F.lit(int((1 << 20) * min(1.0, 0.95 * sample / max(n, 1))) if n > sample else 1 << 20)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")


class Classifier:
    """Fitted log-likelihood ratios."""

    def __init__(self, bins: np.ndarray, lexicon: dict[str, float], scores: np.ndarray):
        self.bins, self.lexicon, self.scores = bins, lexicon, scores
        self.words = frozenset(lexicon)

    def score(self, words: set[str]) -> int:
        """Bin of the lexicon score of a text's distinct words."""
        weights = sorted((self.lexicon[w] for w in words & self.words), reverse=True)
        return min(int(2 * sum(weights[:HEAVIEST])), SCORES - 1)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Log-likelihood ratios of good against bad, and of toxic against not."""
        if not text or not text.strip():
            return 0.0, 0.0
        values, words = measure(text)
        good = float(self.bins[np.arange(len(MEASURES)), _bin(np.array(values))].sum())
        toxic = float(self.scores[self.score(words)])
        return max(-CAP, min(CAP, good)), max(-CAP, min(CAP, toxic))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier from a bounded sample; sums per bin and per word are made on the executors."""
    chosen = cut(_labelled(docs, labels, sample))

    def counted(batches):
        good = np.zeros((2, len(MEASURES), BINS), np.int64)
        for batch in batches:
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if quality is not None and text.strip():
                    good[1 if quality else 0, np.arange(len(MEASURES)), _bin(np.array(measure(text)[0]))] += 1
        at = np.nonzero(good)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*at, good[at])], ["label", "measure", "bin", "n"])

    rows = map_arrow(chosen.select("text", "quality"), counted, "label long, measure long, bin long, n long").groupBy("label", "measure", "bin").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((2, len(MEASURES), BINS))
    for r in rows:
        sums[r["label"], r["measure"], r["bin"]] = r["n"]
    rates = (sums + 2) / (sums.sum(axis=2, keepdims=True) + 2 * BINS)
    bins = np.log(rates[1]) - np.log(rates[0])
    if not sums[0].any() or not sums[1].any():
        bins[:] = 0.0

    def listed(batches):
        for batch in batches:
            words, toxic, halves = [], [], []
            for text, bad, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = measure(text)[1] - {""}
                words.extend(own)
                toxic.extend([bad] * len(own))
                halves.extend([part] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64()), pa.array(halves, pa.int64())], ["word", "toxic", "half"])

    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("long")
    parted = chosen.where("toxic is not null").select("text", F.when(F.col("toxic") != 0, 1).otherwise(0).alias("toxic"), half.alias("half"))
    size = {(r["half"], r["toxic"]): r["n"] for r in parted.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([size.get((0, k), 0), size.get((1, k), 0)] for k in (1, 0))
    if not sum(toxic) or not sum(clean):
        return Classifier(bins, {}, np.zeros(SCORES))
    hit = lambda h, t: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), 1).otherwise(0))
    words = map_arrow(parted, listed, "word string, toxic long, half long").groupBy("word").agg(hit(0, 1).alias("t0"), hit(0, 0).alias("c0"), hit(1, 1).alias("t1"), hit(1, 0).alias("c1"))

    def weight(t: Column, c: Column, n_toxic: int, n_clean: int) -> Column:
        """The lower bound of a word's log-odds; none below the support."""
        odds = F.log((t + 0.5) / F.lit(n_toxic + 1.0)) - F.log((c + 0.5) / F.lit(n_clean + 1.0))
        return F.when(t >= min(SUPPORT, max(2, n_toxic // 20)), odds - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))

    t0, c0, t1, c1 = map(F.col, ("t0", "c0", "t1", "c1"))
    views = [weight(t0, c0, toxic[0], clean[0]), weight(t1, c1, toxic[1], clean[1]), weight(t0 + t1, c0 + c1, sum(toxic), sum(clean))]
    weighed = words.select("word", *[v.alias(f"w{i}") for i, v in enumerate(views)])
    top = F.greatest(*[F.coalesce(f"w{i}", F.lit(-1.0)) for i in range(3)])
    found = weighed.where(top >= SIGNIFICANT).orderBy(top.desc(), "word").limit(3 * LEXICON).collect()
    lexicons = []
    for i in range(3):
        best = sorted(((r[f"w{i}"], r["word"]) for r in found if r[f"w{i}"] is not None and r[f"w{i}"] >= SIGNIFICANT), key=lambda x: (-x[0], x[1]))
        lexicons.append({w: float(x) for x, w in best[:LEXICON]})
    models = [Classifier(bins, lexicon, np.zeros(SCORES)) for lexicon in lexicons]

    def scored(batches):
        hist = np.zeros((2, SCORES), np.int64)
        for batch in batches:
            for text, bad, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hist[bad, models[1 - part].score(measure(text)[1])] += 1
        at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*at, hist[at])], ["toxic", "bin", "n"])

    # each half, scored by the other one's lexicon, says what a score is worth; a higher score never counts for less
    hist = np.zeros((2, SCORES))
    for r in map_arrow(parted, scored, "toxic long, bin long, n long").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r["toxic"], r["bin"]] = r["n"]
    near = hist + np.pad(hist, ((0, 0), (1, 0)))[:, :-1] + np.pad(hist, ((0, 0), (0, 1)))[:, 1:]
    near[:, 0] = hist[:, 0]
    ratio = np.log((near[1] + 0.25) / (hist[1].sum() + 1)) - np.log((near[0] + 0.25) / (hist[0].sum() + 1))
    models[2].scores = np.maximum.accumulate(ratio)
    return models[2]


def evidence(docs: DataFrame, model: Classifier, columns: list[Column]) -> DataFrame:
    """doc_id, the given site columns, ev_good and ev_toxic for every document; the model is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, "text")
    keys = picked.columns[:-1]

    def run(batches):
        for batch in batches:
            found = [shared.value.evidence(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], [*keys, "ev_good", "ev_toxic"])

    schema = ", ".join(f"`{n}` {k}" for n, k in [*picked.dtypes[:-1], ("ev_good", "double"), ("ev_toxic", "double")])
    return map_arrow(picked, run, schema)


def _strength(table: DataFrame, hits: str, n: str, rate: float) -> float:
    """Prior strength of a level by moments: how little the units' rates vary beyond binomial noise."""
    variance = rate * (1 - rate)
    if not 0 < variance:
        return 50.0
    excess = F.pow(F.col(hits) - F.col(n) * rate, 2) - F.col(n) * variance
    row = table.agg(F.sum(excess).alias("e"), F.sum(F.col(n) * (F.col(n) - 1)).alias("p")).first()
    if not row["p"] or row["e"] is None or row["e"] <= 0:
        return 500.0
    rho = min(row["e"] / (row["p"] * variance), 0.9)
    return float(min(max(1 / rho - 1, 5.0), 500.0))


def sites(labelled: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Shrunk rates per (host, path) and the global rates, from host, path, quality and toxic of all labels.

    Labels are first summed per path, then per host; only three totals reach the driver.
    """
    path = labelled.groupBy("host", "path").agg(
        F.count("quality").alias("qn"), F.coalesce(F.sum(F.when(F.col("quality") != 0, 1)), F.lit(0)).alias("qh"),
        F.count("toxic").alias("tn"), F.coalesce(F.sum(F.when(F.col("toxic") != 0, 1)), F.lit(0)).alias("th"))
    path = cut(path)
    host = path.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in ("qn", "qh", "tn", "th")])
    total = path.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("qn", "qh", "tn", "th")]).first()
    rates = {"quality": (total["qh"] + 1) / (total["qn"] + 2), "toxic": (total["th"] + 1) / (total["tn"] + 2)}
    found = path.join(host, path["host"].eqNullSafe(host["host"])).drop(host["host"])
    for name, n, h in (("quality", "qn", "qh"), ("toxic", "tn", "th")):
        rate = rates[name]
        a, b = _strength(host, f"h_{h}", f"h_{n}", rate), _strength(path, h, n, rate)
        of_host = (F.col(f"h_{h}") + a * rate) / (F.col(f"h_{n}") + a)
        found = found.withColumn(f"{name}_rate", (F.col(h) + b * of_host) / (F.col(n) + b))
    return found.select("host", "path", "quality_rate", "toxic_rate"), rates


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, ev_good, ev_toxic, p_good, p_toxic and kept for every document."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels, sample)
    scored = cut(evidence(docs, model, [host.cast("string").alias("host"), path.cast("string").alias("path")]))
    marked = scored.select("doc_id", "host", "path").join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"), "doc_id")
    rates, overall = sites(marked)
    rates = rates.withColumnsRenamed({"host": "_host", "path": "_path"})
    joined = scored.join(rates, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    for name, ev, out in (("quality", "ev_good", "p_good"), ("toxic", "ev_toxic", "p_toxic")):
        base = math.log(overall[name] / (1 - overall[name]))
        shift = _logit(F.coalesce(F.col(f"{name}_rate"), F.lit(overall[name]))) - base
        odds = F.lit(base) + F.greatest(F.lit(-SITE_CAP), F.least(F.lit(SITE_CAP), shift)) + F.col(ev)
        joined = joined.withColumn(out, 1 / (1 + F.exp(-odds)))
    kept = (F.col("p_good") >= THRESHOLD) & (F.col("p_toxic") <= THRESHOLD)
    return joined.select("doc_id", "host", "path", "ev_good", "ev_toxic", "p_good", "p_toxic", kept.alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; rows that share an id stay if one is kept, and
    rows without an id stay."""
    judged = classify(docs, labels).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
