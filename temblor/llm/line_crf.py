"""Text quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features come from the line and
from its neighbours; a transition weight per pair of labels ties neighbours
together. Training takes the documents' labels for all of their lines. The
forward-backward pass gives each line the probability of being good, and the
mean over the lines, weighted by their lengths, is the document's quality.

The model is fitted on the driver from a bounded sample: ``train_docs`` labelled
documents at most, of up to ``train_lines`` lines each (longer ones are passed
over), the first by hash of their id. Lines are turned into numbers in tasks; the
driver sees numbers only. Scoring runs over all documents whole, batch by batch.

Defined cases: a null or empty text is one empty line; each line weighs at least
one byte; without labels of both kinds every score is 0.5; rows with equal ids
are scored each; null labels and null ids teach nothing; conflicting labels of
one document count as bad; further columns are carried along, those with the
name of a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
SYMBOLS, MARKS = b"#*$%&|<>@^~=+_\\{}[]", b".,;:"
ASCII = bytes(range(128))
#: Features of a line itself, and those of them that neighbours see.
OWN = ["bias", "words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "marks", "distinct", "doubled",
       "pairs", "ends", "starts", "seen", "symbol_words", "single", "foreign", "blank"]
SEEN = [3, 5, 6, 7, 9, 10, 11, 14, 18]
WIDTH = len(OWN) + 2 * len(SEEN) + 2


def line_features(line: str, seen: set[str]) -> tuple[list[float], int]:
    """Numbers that describe a line, and its length in bytes."""
    raw = line.encode("utf-8")
    size = len(raw)
    words = line.split()
    if not words:
        return [1.0, *[0.0] * (len(OWN) - 2), 1.0], size
    n, again = len(words), line in seen
    seen.add(line)

    def share(chars: bytes, per: int) -> float:
        return (size - len(raw.translate(None, chars))) / per

    doubled = sum(map(str.__eq__, words, words[1:])) / n
    pairs = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0
    tail = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / n
    return [1.0, math.log1p(n) / 4, min(3.0, size / n / 8), share(UPPER, size), share(DIGITS, size),
            share(SYMBOLS, size) * 4, min(2.0, share(b"!", n)), min(1.0, share(b"|", n)), min(2.0, share(MARKS, n)),
            len(set(words)) / n, doubled, pairs, float(line.rstrip()[-1:] in ".!?"), float(words[0][:1].isupper()),
            float(again), tail, sum(len(w) == 1 for w in words) / n, len(raw.translate(None, ASCII)) / size, 0.0], size


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines of a text with their neighbours', and the lines' weights."""
    seen: set[str] = set()
    rows = [line_features(line, seen) for line in text.split("\n")]
    own = np.array([r[0] for r in rows])
    full = np.zeros((len(rows), WIDTH))
    k, m = len(OWN), len(SEEN)
    full[:, :k] = own
    full[1:, k:k + m] = own[:-1, SEEN]
    full[:-1, k + m:k + 2 * m] = own[1:, SEEN]
    full[0, -2] = full[-1, -1] = 1.0
    return full, np.array([max(1, r[1]) for r in rows], dtype=np.float64)


def marginals(emission: list[float], stay: tuple[float, float]) -> list[float]:
    """Probability of good per line by forward-backward.

    ``emission`` are log odds of good per line, ``stay`` the log weights of
    bad-bad and good-good steps against a change.
    """
    bad, good = math.exp(stay[0]), math.exp(stay[1])
    forward, a = [], None
    odds = [1 / (1 + math.exp(-max(-500.0, min(500.0, e)))) for e in emission]
    for p in odds:
        b0, b1 = (1.0, 1.0) if a is None else (a[0] * bad + a[1], a[0] + a[1] * good)
        x, y = b0 * (1 - p), b1 * p
        s = x + y or 1.0
        a = (x / s, y / s)
        forward.append(a)
    out, z = [0.0] * len(odds), (1.0, 1.0)
    for t in range(len(odds) - 1, -1, -1):
        x, y = forward[t][0] * z[0], forward[t][1] * z[1]
        out[t] = y / ((x + y) or 1.0)
        p = odds[t]
        u, v = z[0] * (1 - p), z[1] * p
        x, y = u * bad + v, u + v * good
        s = x + y or 1.0
        z = (x / s, y / s)
    return out


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def fit(documents: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3,
        ) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights and stay weights of the highest likelihood, by Adam on all documents at once.

    Each class of documents has the same total weight.
    """
    documents = sorted(documents, key=lambda d: -len(d[0]))
    labels = np.array([d[1] for d in documents])
    if len(set(labels.tolist())) < 2:
        return np.zeros(WIDTH), (0.0, 0.0)
    sizes = np.array([len(d[0]) for d in documents])
    longest, n = sizes[0], len(documents)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.concatenate([d[0] for d in documents])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], spread[0] = 0.0, 1.0
    x = (x - mean) / spread
    active = [int((sizes > t).sum()) for t in range(longest)]  # documents with a line t come first
    of = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    of = of / sizes  # a long document counts no more than a short one
    theta = np.zeros(WIDTH + 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        e = x @ theta[:WIDTH]
        stay = np.clip(theta[WIDTH:], -2, 2)
        f0, f1 = np.zeros((longest, n)), np.zeros((longest, n))
        for t in range(longest):
            m = active[t]
            here = e[starts[:m] + t]
            if t:
                p0, p1 = f0[t - 1, :m], f1[t - 1, :m]
                f0[t, :m] = _log_sum(p0 + stay[0], p1)
                f1[t, :m] = _log_sum(p0, p1 + stay[1]) + here
            else:
                f1[t, :m] = here
        b0, b1 = np.zeros((longest, n)), np.zeros((longest, n))
        good = np.zeros(len(x))
        same = np.zeros((2, n))
        end0, end1 = f0[sizes - 1, np.arange(n)], f1[sizes - 1, np.arange(n)]
        log_z = _log_sum(end0, end1)
        for t in range(longest - 1, -1, -1):
            m = active[t]
            more = active[t + 1] if t + 1 < longest else 0
            if more:
                nxt = e[starts[:more] + t + 1]
                b0[t, :more] = _log_sum(stay[0] + b0[t + 1, :more], nxt + b1[t + 1, :more])
                b1[t, :more] = _log_sum(b0[t + 1, :more], stay[1] + nxt + b1[t + 1, :more])
                same[0, :more] += np.exp(f0[t, :more] + stay[0] + b0[t + 1, :more] - log_z[:more])
                same[1, :more] += np.exp(f1[t, :more] + stay[1] + nxt + b1[t + 1, :more] - log_z[:more])
            good[starts[:m] + t] = np.exp(f1[t, :m] + b1[t, :m] - log_z[:m])
        want = np.repeat(labels, sizes)
        gradient = x.T @ ((want - good) * np.repeat(of, sizes)) - ridge * theta[:WIDTH]
        steps_of = sizes - 1
        turn = np.array([(of * (np.where(labels == k, steps_of, 0) - same[k])).sum() - ridge * theta[WIDTH + k]
                         for k in (0, 1)])
        g = np.concatenate([gradient, turn])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    weights = theta[:WIDTH] / spread
    weights[0] -= float((theta[1:WIDTH] * mean[1:] / spread[1:]).sum())
    stay = np.clip(theta[WIDTH:], -2, 2)
    return weights, (float(stay[0]), float(stay[1]))


def training_documents(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, train_docs: int,
                       train_lines: int) -> list[tuple[np.ndarray, int]]:
    """Line features and label of a bounded sample of labelled documents."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("label")))
    # ``train_docs`` rows at most, so small enough to send to every task.
    asked = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(train_docs)
    first = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .where(F.size(F.split("text", "\n")) <= train_lines).join(F.broadcast(asked), "id")
             .dropDuplicates(["id", "text"]).orderBy("h", F.xxhash64("text")).limit(train_docs))

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"h": frame["h"], "label": frame["label"], "x": [
                document_features(t)[0].astype("<f4").tobytes() for t in frame["text"]]})

    found = first.mapInPandas(numbers, "h bigint, label int, x binary").collect()
    return [(np.frombuffer(r["x"], dtype="<f4").reshape(-1, WIDTH).astype(np.float64), r["label"])
            for r in sorted(found, key=lambda r: (r["h"], bytes(r["x"])))]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
            train_docs: int = 4000, train_lines: int = 500) -> DataFrame:
    """Add ``score``, the length-weighted probability of good lines, learned from ``labels``."""
    weights, stay = fit(training_documents(docs, labels, id_col, text, label, train_docs, train_lines))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for body in texts:
            x, size = document_features(body)
            out.append(float(np.dot(marginals((x @ weights).tolist(), stay), size) / size.sum()))
        return pd.Series(out, dtype="float64")

    return docs.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))
