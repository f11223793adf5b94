"""Quality by Bradley-Terry ranking: a document beats another with the logistic of the difference of their scores.

Preference pairs join a document marked 1 with one marked 0; weights come from logistic loss on feature differences, so
only what tells the two apart matters and no class prior enters.  Every labelled document takes part: documents are dealt
to groups that hold both classes, pairs are formed inside a group, and Newton's steps add the groups' sums up.  The quantile
of all labelled documents' scores that separates them best becomes the threshold.  Features are shares and ratios of the whole text, the same in any language.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import by_arrow, columns, keep_rows, small_batches, text_of, written
from hiresift.llm.training import known_labels, labelled_rows, remainder

GROUP = 2048  # rows of the larger class in a group, on average
FEW = 32  # rows of the smaller class in a group, at least and on average
SYMBOL = re.compile(r"[^\w\s]")
ODD = re.compile(r"[^\w\s.,;:?'’\"()-]")
FEATURES = ("words", "upper", "symbols", "odd symbols", "word length", "digits", "repeats", "distinct", "top word", "short words", "sentence ends", "repeated lines", "not ascii", "single symbols", "empty")


def features(text: str) -> list[float]:
    """Numbers that describe a whole text; an empty text has zeros and the last one set."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    root = lambda part, whole: (part / max(whole, 1)) ** 0.5  # noqa: E731  small shares still count
    upper = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)), root(upper, n), root(len(SYMBOL.findall(text)), chars), root(len(ODD.findall(text)), chars), (chars - n) / n / 10, root(sum(map(str.isdigit, words)), n),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), len(counts) / n, root(counts.most_common(1)[0][1], n), sum(len(w) <= 3 for w in words) / n,
        root(text.count(".") + text.count("!") + text.count("?"), n), root(len(lines) - len(set(lines)), len(lines)), 0.0 if text.isascii() else root(chars - len(text.encode("ascii", "ignore")), chars), root(sum(len(w) == 1 and not w.isalnum() for w in words), n), 0.0,
    ]


@dataclass
class QualityModel:
    """score = logistic(weights . (x - mean) / spread - threshold + logit(at)): it is `at` on the threshold."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    at: float = 0.7

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = (x - self.mean) / self.spread @ self.weights - self.threshold + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in keep} | {"x": pa.array([features(t) for t in text_of(batch.column("text"))], pa.list_(pa.float64()))})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return by_arrow(docs.select(*dict.fromkeys([*keep, "text"])), apply, f"{kept}, x array<double>")


def grouped(data: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(group, y, x): each row of the larger class in one group; rows of the smaller class in as many as it takes for both to meet."""
    large = max(counts, key=lambda y: (counts[y], y))
    groups = -(-counts[large] // GROUP)
    copies = min(groups, max(1, -(-FEW * groups // counts[1 - large])))
    place = F.when(F.col("y") == large, F.sequence(F.lit(0), F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(copies - 1)))
    dealt = data.withColumn("_at", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    dealt = dealt.select("y", "x", "_at", F.explode(place).alias("_copy"))
    dealt = dealt.withColumn("group", F.pmod(F.pmod("_at", F.lit(groups)) + F.col("_copy"), F.lit(groups)))
    return dealt.repartition("group").sortWithinPartitions("group", "_at").select("group", "y", "x")


def pairs_of(group: int, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Better minus worse for pairs of a group: every row takes part, with partners from a generator with a fixed seed."""
    rng = np.random.default_rng((7, group))
    better, worse = z[y == 1], z[y == 0]
    if not len(better) or not len(worse):
        return np.zeros((0, z.shape[1]))
    n = 4 * max(len(better), len(worse))
    i = np.concatenate([rng.permutation(len(better)) for _ in range(-(-n // len(better)))])[:n]
    j = np.concatenate([rng.permutation(len(worse)) for _ in range(-(-n // len(worse)))])[:n]
    return better[i] - worse[j]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, y, x) of sorted rows, one group at a time."""
    now, ys, xs = None, [], []
    for batch in batches:
        group, y = batch.column("group").to_numpy(), batch.column("y").to_numpy()
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if ys and group[lo] != now:
                yield now, np.concatenate(ys), np.concatenate(xs)
                ys, xs = [], []
            now = int(group[lo])
            ys.append(y[lo:hi])
            xs.append(x[lo:hi])
    if ys:
        yield now, np.concatenate(ys), np.concatenate(xs)


def fit_pairs(groups: DataFrame, mean: np.ndarray, spread: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Bradley-Terry weights by Newton's method on the logistic loss of better minus worse, summed over all groups.

    A round is one pass over the groups; a task leaves one row with its sums.
    """
    k = len(mean)
    w = np.zeros(k)
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            n, gradient, hessian = 0, np.zeros(k), np.zeros((k, k))
            for group, y, x in groups_of(batches):
                d = pairs_of(group, y, (x - mean) / spread)
                p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
                n, gradient, hessian = n + len(d), gradient + d.T @ (1 - p), hessian + (d * (p * (1 - p))[:, None]).T @ d
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([[*gradient, *hessian.ravel()]], pa.list_(pa.float64()))})

        parts = sorted(tuple(r) for r in by_arrow(groups, sums, "n long, sums array<double>").collect())
        n, total = sum(p[0] for p in parts), np.sum([p[1] for p in parts], axis=0)
        move = np.linalg.solve(total[k:].reshape(k, k) / n + ridge * np.eye(k), total[:k] / n - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def quantile_threshold(scored: DataFrame) -> float:
    """The midpoint after the score quantile under which fewest marked rows stand on the wrong side; `scored` is (s, y).

    Scores are dealt by ranges; a range leaves its first score, what it adds to the errors, and its own best place.
    """
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, first, least = 0, None, None
        for batch in batches:
            for now, change in zip(batch.column("s").to_pylist(), batch.column("change").to_pylist(), strict=True):
                if least is not None and least[2] is None:
                    least = (*least[:2], now)
                first = now if first is None else first
                added += change
                if least is None or added < least[0]:
                    least = (added, now, None)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": [first], "added": pa.array([added], pa.int64()), "least": pa.array([least[0]], pa.int64()), "at": [least[1]], "next": pa.array([least[2]], pa.float64())})

    steps = scored.groupBy("s").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(-1)).alias("change"))
    dealt = steps.repartitionByRange("s").sortWithinPartitions("s")
    parts = sorted(tuple(r) for r in by_arrow(dealt, best, "first double, added long, least long, at double, next double").collect())
    before, found = 0, None
    for i, (_, added, least, at, after) in enumerate(parts):
        if found is None or before + least < found[0]:
            follows = after if after is not None else parts[i + 1][0] if i + 1 < len(parts) else at
            found = (before + least, (at + follows) / 2)
        before += added
    return found[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int | None = 4, held_out: int | None = 2) -> QualityModel:
    """Fit on every labelled document; only sums reach the driver.

    Without labels of both classes every document gets the one label there is (1 without any).
    """
    known = known_labels(labels, label, modulus, held_out)
    data = written(with_features(labelled_rows(docs, known), ["doc_id", "y"]), f"features-{label}")
    counts = {int(r["y"]): int(r["count"]) for r in data.groupBy("y").count().collect()}
    k = len(FEATURES)
    if len(counts) < 2:
        totals = {int(r["y"]) for r in known.select("y").distinct().collect()}
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(k), 20.0 if totals == {0} else -20.0)
    facts = data.agg(*[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(k)]).first()
    mean, spread = np.array(facts[:k]), np.array(facts[k:]) + 1e-6
    w = fit_pairs(written(grouped(data, counts), f"groups-{label}"), mean, spread)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_pydict({"s": ((x - mean) / spread * w).sum(axis=1), "y": batch.column("y")})

    return QualityModel(mean, spread, w, quantile_threshold(by_arrow(data.select("x", "y"), scores, "s double, y int")))


def score(docs: DataFrame, model: QualityModel, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns `keep` with score and predicted of every whole text; null is the empty text."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            p = model.score(np.array([features(t) for t in text_of(batch.column("scored_text"))]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in keep} | {"score": p, "predicted": (p >= threshold).astype(np.int32)})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return by_arrow(docs.select(*keep, F.col("text").alias("scored_text")), apply, f"{kept}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(columns(docs, "doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def reject_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that are predicted good, with the columns they came with."""
    model = train(docs, labels)
    return keep_rows(docs, lambda texts: (model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))) >= threshold).tolist())
