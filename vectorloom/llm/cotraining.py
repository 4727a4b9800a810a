"""Document quality by co-training two views: what a text says, and how its page is made and where it comes from.

The text view sees which words, stems of words and punctuation runs occur and a few shape numbers; the page view sees
source, language, size class and the layout: classes of the number and length of lines, of the share of lines that
repeat within the page, and of the shares of letters, digits and marks. Both are logistic regressions over
hashed features, fitted on labelled documents. In every round both views, calibrated on a fold that neither was fitted
on, score all documents on the executors; counts by score tell which are the surest ``share`` at either end of
each view, and these become pseudo-labels of the other view, which is fitted again. At the end the calibrated
log-odds are combined by a third regression on the fold.

A document is good if its label says quality 1 and toxic 0. A fit reads a bounded sample of labelled rows: at most
about ``labelled`` rows with labels and ``handed`` of either end that the other view labelled, chosen by a hash of the
id among all that are sure enough. What both views see of the documents is made in one pass over the texts and kept as a
table, some two bytes a feature, which every round and the last scoring read. A pseudo-label is the giving view's probability and counts ``TRUST`` times the
square of its distance from a guess. Everything else covers all documents.

Edge cases: null texts are empty; null metadata are a value of their own; labels of one document are
merged (lowest quality, highest toxicity; null counts as quality 1 and toxic 0); without labelled rows of
both kinds all scores are 0.5 and everything is kept; rows without id are scored but not handed on; a view whose
scores are all alike hands nothing on; repeated rows get equal scores; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.session import checkpoint, discard

BUCKETS = 1 << 18
SHAPES = 5
#: Rounds of exchange; share of all documents at either end that a view is surest of; how many of them a fit reads; weight of a pseudo-label.
ROUNDS, SHARE, HANDED, TRUST = 2, 0.05, 1000, 0.1
SCORED = "doc_id long, text_score double, page_score double, score double, kept boolean"
_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]+").findall


STEMS = (4, 5, 6, 7)


def text_tokens(text: str) -> set[str]:
    """Distinct lower-cased words and punctuation runs."""
    return set(_TOKENS(text.lower()))


def token_features(token: str) -> list[int]:
    """Buckets of a token and of its proper stems, so that inflected forms share evidence."""
    return [bucket(token), *(bucket(token[:k] + "*") for k in STEMS if len(token) > k)]


def text_shape(text: str) -> list[float]:
    """Shares of upper-case letters, punctuation and digits, log length, mean line length (scaled)."""
    codes = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(codes))
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    letters = int((((codes | 32) >= 97) & ((codes | 32) <= 122)).sum()) + int((codes >= 128).sum())
    spaces = int((codes <= 32).sum())
    lines = int((codes == 10).sum()) + 1
    return [upper / n, (n - letters - digits - spaces) / n if len(codes) else 0.0, digits / n, np.log1p(len(codes)) / 10, np.log1p(len(codes) / lines) / 10]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) & (BUCKETS - 1)


def page_tokens(source: str | None, lang: str | None, n_chars: int | None) -> list[str]:
    size = "none" if n_chars is None else str(int(np.log2(n_chars + 1))) if n_chars >= 0 else "negative"
    return [f"source={source}", f"lang={lang}", f"size={size}"]


def layout_tokens(text: str) -> list[str]:
    """Classes of a text's layout; none of them tells which words it has."""
    lines = text.split("\n")
    upper, marks, digits, _, _ = text_shape(text)
    repeated = 1 - len(set(lines)) / len(lines)
    long = max(map(len, lines))
    finely = lambda x: int(40 * min(x, 0.5))
    return [
        f"lines={int(np.log2(len(lines)))}", f"line_size={int(np.log2(1 + len(text) / len(lines)))}", f"longest={int(np.log2(1 + long))}",
        f"repeated={finely(repeated)}", f"upper={finely(upper)}", f"marks={finely(marks)}", f"digits={finely(digits)}",
    ]


def view_tokens(text: str, source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of the page view."""
    return [bucket(x) for x in page_tokens(source, lang, n_chars) + layout_tokens(text)]


@dataclass
class Linear:
    """Logistic regression: bias, weights of hashed features (dense array), weights of shape numbers."""

    bias: float
    weights: np.ndarray
    shape: np.ndarray

    def logits(self, sets: list[np.ndarray], shapes: np.ndarray) -> np.ndarray:
        return np.array([self.bias + self.weights[s].sum() for s in sets]) + shapes @ self.shape


def fit_linear(sets: list[np.ndarray], shapes: np.ndarray, y: np.ndarray, select: float, l2: float = 1.0, steps: int = 300, weight: np.ndarray | None = None) -> Linear:
    """Fit by Adam on features whose association with y has a chi-square of at least ``select``; rows may count by weight."""
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    total = weight.sum()
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    df, pos = np.bincount(flat, weights=weight[rows], minlength=BUCKETS), np.bincount(flat, weights=(weight * y)[rows], minlength=BUCKETS)
    p = (weight * y).sum() / total
    expected = df * p
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(df >= 4, (pos - expected) ** 2 / (df * p * (1 - p) * (1 - df / (total + 1))), 0)
    chosen = np.flatnonzero(np.nan_to_num(chi) >= select) if select else np.flatnonzero(df)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[flat] >= 0
    i, j = rows[keep], column[flat[keep]]
    spread = shapes.std(axis=0)
    spread[spread == 0] = 1
    centre, scaled = shapes.mean(axis=0), (shapes - shapes.mean(axis=0)) / spread
    theta = np.zeros(1 + len(chosen) + shapes.shape[1])
    theta[0] = np.log(p / (1 - p))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[0] + np.bincount(i, weights=theta[1 + j], minlength=n) + scaled @ theta[1 + len(chosen) :]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.concatenate([[error.sum()], np.bincount(j, weights=error[i], minlength=len(chosen)), scaled.T @ error])
        grad[1:] += l2 * theta[1:]
        grad /= total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[chosen] = theta[1 : 1 + len(chosen)]
    shape = theta[1 + len(chosen) :] / spread
    return Linear(float(theta[0] - centre @ shape), weights, shape)


def fit_plane(x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> np.ndarray:
    """Newton's method for a logistic regression on a few columns; (bias, slopes)."""
    a = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(a.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a @ theta, -35, 35)))
        hessian = (a * (q * (1 - q))[:, None]).T @ a + l2 * np.eye(len(theta))
        theta -= np.linalg.solve(hessian, a.T @ (q - y) + l2 * theta * (np.arange(len(theta)) > 0))
    return theta


@dataclass
class QualityModel:
    """Both views, their calibrations (bias, slope), the combination (bias, slope, slope), and how many pseudo-labels each got last."""

    text: Linear | None = None
    page: Linear | None = None
    text_scale: tuple[float, ...] = (0.0, 1.0)
    page_scale: tuple[float, ...] = (0.0, 1.0)
    joint: tuple[float, ...] = (0.0, 1.0, 1.0)
    text_given: int = 0
    page_given: int = 0


@dataclass
class Rows:
    """Documents as both views see them, with labels."""

    text: list[np.ndarray] = field(default_factory=list)
    shapes: np.ndarray = field(default_factory=lambda: np.zeros((0, SHAPES)))
    page: list[np.ndarray] = field(default_factory=list)
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def take(self, at: np.ndarray) -> Rows:
        return Rows([self.text[k] for k in at], self.shapes[at], [self.page[k] for k in at], self.y[at])

    def __add__(self, other: Rows) -> Rows:
        return Rows(self.text + other.text, np.concatenate([self.shapes, other.shapes]), self.page + other.page, np.concatenate([self.y, other.y]))


#: What the views hand on: rows labelled by the page view, for the text view, and the other way round.
Exchange = Callable[[QualityModel], tuple[Rows, Rows]]


def co_train(known: Rows, fold: np.ndarray, exchange: Exchange | None, rounds: int = ROUNDS, weight: float = TRUST) -> QualityModel:
    """Fit on the labelled rows outside the fold, exchange pseudo-labels in every round, calibrate on the fold."""
    own, held = known.take(np.flatnonzero(~fold)), known.take(np.flatnonzero(fold))
    if len(set(own.y)) < 2 or len(set(held.y)) < 2:
        return QualityModel()

    def trust(given: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(len(own.y)), weight * (2 * given - 1) ** 2])

    def fitted(for_text: Rows, for_page: Rows) -> QualityModel:
        more, most = own + for_text, own + for_page
        text = fit_linear(more.text, more.shapes, more.y, 15.0, weight=trust(for_text.y))
        page = fit_linear(most.page, np.zeros((len(most.y), 0)), most.y, 0.0, weight=trust(for_page.y))
        a, b = text.logits(held.text, held.shapes), page.logits(held.page, np.zeros((len(held.y), 0)))
        ta, tb = fit_plane(a[:, None], held.y), fit_plane(b[:, None], held.y)
        joint = fit_plane(np.column_stack([ta[0] + ta[1] * a, tb[0] + tb[1] * b]), held.y)
        return QualityModel(text, page, tuple(ta), tuple(tb), tuple(joint), len(for_text.y), len(for_page.y))

    none = own.take(np.zeros(0, int))
    model = fitted(none, none)
    for _ in range(rounds if exchange else 0):
        model = fitted(*exchange(model))
    return model


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def packed(features: list[int]) -> bytes:
    """Rising features as gaps of 16 bits; 65535 stands for a gap that goes on in the next."""
    gaps = np.diff(np.array(features, dtype=np.int64), prepend=0)
    more = gaps // 65535
    out = np.full(len(gaps) + int(more.sum()), 65535, dtype="<u2")
    out[np.cumsum(more + 1) - 1] = gaps % 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, dtype="<u2").astype(np.int64)
    return np.cumsum(gaps)[gaps != 65535]


class _Features(dict):
    """token -> its features, filled on demand up to a bounded size."""

    def __missing__(self, token: str) -> list[int]:
        found = token_features(token)
        if len(self) < 1 << 18:
            self[token] = found
        return found


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text, shape, page) of documents as both views see them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in batches:
            text, shape, page = [], [], []
            sources, langs, sizes = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for value, source, lang, size in zip(batch.column(1), sources, langs, sizes):
                t = value.as_py() or ""
                text.append(packed(sorted({b for found in map(known.__getitem__, text_tokens(t)) for b in found})))
                shape.append(text_shape(t))
                page.append(view_tokens(t, source, lang, size))
            made = [pa.array(text, pa.binary()), pa.array(shape, pa.list_(pa.float64())), pa.array(page, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "text", "shape", "page"])

    return _columns(docs).mapInArrow(run, "doc_id long, text binary, shape array<double>, page array<int>")


def _local(made: DataFrame, most: int, seed: int, *labels: str) -> tuple[Rows, dict[str, np.ndarray], list[int]]:
    """At most so many rows of features on the driver, in an order that does not depend on partitions."""
    rows = made.orderBy(_draw(seed), "doc_id", "page", "shape").limit(most).toArrow().sort_by("doc_id")
    text = [unpacked(x) for x in rows.column("text").to_pylist()]
    page = _sets_of(rows.column("page").combine_chunks())
    shapes = np.array(rows.column("shape").to_pylist(), dtype=float).reshape(-1, SHAPES)
    found = {c: np.array(rows.column(c).to_pylist(), dtype=float) for c in labels}
    return Rows(text, shapes, page, found[labels[0]]), found, rows.column("doc_id").to_pylist()


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))


def ends(scored: DataFrame, column: str, share: float) -> tuple[int, int] | None:
    """Hundredths of log-odds at and below which, and at and above which, the surest share of the rows lies.

    Counts of all rows by hundredth, at most 7,001 of them, go to the driver; None if both ends would meet.
    """
    at = F.least(F.greatest(F.floor(F.col(column) * 100), F.lit(-3500)), F.lit(3500))
    counts = sorted((r[0], r[1]) for r in scored.groupBy(at.alias("at")).count().collect())
    wanted = share * sum(n for _, n in counts)

    def reach(order: list[tuple[int, int]]) -> int:
        total = 0
        for value, n in order:
            total += n
            if total >= wanted:
                break
        return value

    low, high = (reach(counts), reach(counts[::-1])) if counts else (0, 0)
    return (low, high) if low < high else None


def surest(made: DataFrame, named: DataFrame, model: QualityModel, share: float = SHARE, handed: int = HANDED, seed: int = 6) -> tuple[Rows, Rows]:
    """Rows for the text view, labelled by the page view, and rows for the page view, labelled by the text view.

    All documents without a label are scored; those of either end are handed on, at most ``handed`` of each.
    """
    log_odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    clipped = lambda c: F.least(F.greatest(c, F.lit(1e-15)), F.lit(1 - 1e-15)).alias(c)
    scored = score_features(made.where("doc_id is not null"), model).select("doc_id", clipped("text_score"), clipped("page_score"))
    scored = checkpoint(scored.join(named.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", log_odds("text_score").alias("a"), log_odds("page_score").alias("b")))
    chosen = None
    for column, view in (("b", "for_text"), ("a", "for_page")):
        cuts = ends(scored, column, share)
        likely, at = 1 / (1 + F.exp(-F.col(column))), F.floor(F.col(column) * 100)
        for sure in (at <= cuts[0], at >= cuts[1]) if cuts else ():
            part = scored.where(sure).select("doc_id", *[(likely if v == view else F.lit(None).cast("double")).alias(v) for v in ("for_text", "for_page")]).distinct().orderBy(_draw(seed), "doc_id").limit(handed)
            chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        discard(scored)
        return Rows(), Rows()
    picked = checkpoint(chosen.groupBy("doc_id").agg(F.max("for_text").alias("for_text"), F.max("for_page").alias("for_page")))
    rows, labels, _ = _local(made.join(F.broadcast(picked), "doc_id"), 4 * handed, seed, "for_text", "for_page")  # picked is bounded
    for left in (scored, picked):
        discard(left)
    found = []
    for view in ("for_text", "for_page"):
        rows.y = labels[view]
        found.append(rows.take(np.flatnonzero(~np.isnan(rows.y))))
    return found[0], found[1]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 8000, seed: int = 5, rounds: int = ROUNDS, handed: int = HANDED) -> QualityModel:
    """Train on a bounded sample of labelled rows, chosen by a hash of the id, and on the views' pseudo-labels."""
    made = checkpoint(features(docs))
    model = fit_features(made, labels, labelled, seed, rounds, handed)
    discard(made)
    return model


def fit_features(made: DataFrame, labels: DataFrame, labelled: int = 8000, seed: int = 5, rounds: int = ROUNDS, handed: int = HANDED) -> QualityModel:
    """As ``fit``, from the features of all documents."""
    named = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    n_labels = named.count()
    if not n_labels:
        return QualityModel()
    picked = named.where(_draw(seed) < int((1 << 30) * min(1.0, labelled / n_labels))).groupBy("doc_id")
    picked = picked.agg(F.min(F.coalesce("quality", F.lit(1))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    picked = picked.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double").alias("y")).orderBy(_draw(seed), "doc_id").limit(2 * labelled)
    known, _, ids = _local(made.join(F.broadcast(picked), "doc_id"), 2 * labelled, seed, "y")  # picked is bounded
    fold = np.array([zlib.crc32(f"fold-{k}".encode()) % 4 == 0 for k in ids], dtype=bool)
    return co_train(known, fold, lambda model: surest(made, named, model, handed=handed), rounds)


def _sets_of(column: pa.ListArray) -> list[np.ndarray]:
    """One integer array per row."""
    if not len(column):
        return []
    return np.split(column.flatten().to_numpy(), column.offsets.to_numpy()[1:-1] - column.offsets[0].as_py())


def score_features(made: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """doc_id, both views' calibrated scores, their combination and whether the document stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        for batch in batches:
            n = batch.num_rows
            text = page = both = np.full(n, 0.5)
            if model.text is not None and n:
                shapes = np.array(batch.column(2).to_pylist(), dtype=float).reshape(-1, SHAPES)
                a = np.array([model.text.weights[unpacked(x)].sum() for x in batch.column(1).to_pylist()]) + model.text.bias + shapes @ model.text.shape
                b = np.array([model.page.weights[x].sum() for x in batch.column(3).to_pylist()]) + model.page.bias
                a, b = model.text_scale[0] + model.text_scale[1] * a, model.page_scale[0] + model.page_scale[1] * b
                text, page, both = squash(a), squash(b), squash(model.joint[0] + model.joint[1] * a + model.joint[2] * b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(page), pa.array(both), pa.array(both >= least)], names=["doc_id", "text_score", "page_score", "score", "kept"])

    return made.select("doc_id", "text", "shape", "page").mapInArrow(run, SCORED)


def score(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """Scores of documents in one pass over their texts."""
    return score_features(features(docs), model, least)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score all documents; their features are made once."""
    made = checkpoint(features(docs))
    return score_features(made, fit_features(made, labels))
