"""Language identification with a small byte-level convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum
over the window is kept and a softmax gives the language. All widths run as one matrix product over
the widest receptive field. A text is scored on all of its windows and the windows' log-probabilities
are averaged, so the whole text decides.

Training reads a bounded sample: per language the labelled documents whose hash falls below a threshold
set from the language's count (about ``per_language`` of them), and of each a slice of at most
``slice_chars`` characters at a hashed place; with very many languages fewer of each, so that there are
about ``most_rows`` in all. Every language is learned. The held-out fifth (crc32 of the id, mod 5, equal to 0) is never read for training.

``accept`` takes that network as a start only: ``refine`` goes on over all windows of every labelled text that is not held
out, in the tasks that read them, and takes the mean of the tasks' networks, weighted by their windows.

A share of the network says which learned language is nearest, not whether the text is in any. ``accept``
therefore also asks how likely the text's bytes are under the trigrams of its nearest languages, and how
many of them are letters. Trigrams are counted in all labelled texts that are not held out, and the marks are quantiles over all
that are. Tables take 256 KB a language.

Edge cases: a text that is null or has no letter is ``und`` with score 0; repeated rows get equal
answers; without any labelled row everything is ``und``, and ``accept`` can tell no language from another
and keeps every text with a letter; an empty table gives an empty result; lang, source
and doc_id are not inputs of a prediction and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.memory import releasing

WINDOW = 256
WIDTHS = (2, 3, 4)
#: The network's arrays that are learned.
WEIGHTS = ("embed", "filters", "bias", "out", "out_bias")
#: A text of a rare language counts at most so many times as one of the mean language.
MOST_WEIGHT = 10.0
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class ByteConvNet:
    """Weights of the network; ``classes`` are the learned labels."""

    classes: list[str]
    embed: np.ndarray  # 256 + 1 x d, the last row is padding and stays 0
    filters: np.ndarray  # widest * d x (F * number of widths), zero outside each filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    widest: int

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of the filters for windows (n x WINDOW of byte ids), where they are, and the fields."""
        n, length = windows.shape
        d = self.embed.shape[1]
        padded = np.full((n, length + self.widest - 1), 256, dtype=windows.dtype)
        padded[:, :length] = windows
        flat = self.embed[padded].reshape(n, -1)
        fields = np.lib.stride_tricks.sliding_window_view(flat, self.widest * d, axis=1)[:, ::d]
        responses = (np.ascontiguousarray(fields).reshape(n * length, -1) @ self.filters).reshape(n, length, -1)
        return responses, fields, padded

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        responses, _, _ = self.pooled(windows)
        hidden = np.maximum(responses.max(axis=1) + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def cut_windows(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one padded with the id 256."""
    size = -(-len(data) // length) * length
    ids = np.full(size, 256, dtype=np.int16)
    ids[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return ids.reshape(-1, length)


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 4, least_steps: int = 600, filters: int = 16, dim: int = 8, rate: float = 0.01, batch: int = 64) -> ByteConvNet:
    """Fit the network by Adam on the windows of the labelled texts; small samples are passed over more often."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    widest, total = max(WIDTHS), filters * len(WIDTHS)
    mask = np.zeros((widest * dim, total), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * dim, k * filters : (k + 1) * filters] = 1
    net = ByteConvNet(
        classes,
        rng.normal(0, 0.5, (257, dim)).astype(np.float32),
        (rng.normal(0, 1, mask.shape) * mask / np.sqrt(widest * dim / 2)).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(classes))).astype(np.float32),
        np.zeros(len(classes), np.float32),
        widest,
    )
    net.embed[256] = 0
    parts = [(cut_windows(t.encode("utf-8", "replace")), classes.index(label)) for t, label in zip(texts, labels) if t]
    if not parts or len(classes) < 1:
        return net
    x = np.concatenate([p for p, _ in parts])
    y = np.concatenate([np.full(len(p), c) for p, c in parts])
    adam, epochs = Adam(net, mask), max(epochs, -(-least_steps // -(-len(x) // batch)))
    decay = 0.1 ** (1 / epochs)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            adam.step(x[take], y[take], rate)
        rate *= decay
    return net


class Adam:
    """Steps that change a network in place."""

    def __init__(self, net: ByteConvNet, mask: np.ndarray):
        self.net, self.mask, self.steps = net, mask, 0
        self.first, self.second = ({k: np.zeros_like(getattr(net, k)) for k in WEIGHTS} for _ in range(2))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, weights: np.ndarray | None = None) -> None:
        grads = _gradients(self.net, x, y, self.mask, weights)
        self.steps += 1
        for k in WEIGHTS:
            self.first[k] = 0.9 * self.first[k] + 0.1 * grads[k]
            self.second[k] = 0.999 * self.second[k] + 0.001 * grads[k] ** 2
            change = rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            setattr(self.net, k, (getattr(self.net, k) - change).astype(np.float32))
        self.net.embed[256] = 0


def _gradients(net: ByteConvNet, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
    responses, fields, padded = net.pooled(x)
    n, dim = len(x), net.embed.shape[1]
    where = responses.argmax(axis=1)
    top = np.take_along_axis(responses, where[:, None], axis=1)[:, 0] + net.bias
    hidden = np.maximum(top, 0)
    logits = hidden @ net.out + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    if weights is not None:
        p *= weights[:, None]
    back = (p @ net.out.T) * (top > 0)
    chosen = fields[np.arange(n)[:, None], where]  # n x filters x widest * dim
    g_filters = np.einsum("nf,nfk->kf", back, chosen, optimize=True) * mask
    g_fields = back[:, :, None] * net.filters.T[None]  # n x filters x widest * dim
    g_embed = np.zeros_like(net.embed)
    for j in range(net.widest):
        np.add.at(g_embed, padded[np.arange(n)[:, None], where + j].ravel(), g_fields[:, :, j * dim : (j + 1) * dim].reshape(-1, dim))
    g_embed[256] = 0
    return {"embed": g_embed, "filters": g_filters, "bias": back.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0)}


def held_out():
    """The fifth of the documents that training never reads."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, held: bool, per_language: int = 500, slice_chars: int = 1024, most_rows: int = 100_000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Texts and labels of a bounded sample of the labelled documents, held out or not."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = own.where(F.col("lang").isNotNull() & (held_out() if held else ~held_out()))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row per language
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003))
    if not counts:
        return [], []
    per_language = max(1, min(per_language, most_rows // len(counts)))
    marks = docs.sparkSession.createDataFrame([(r["lang"], int(1_000_003 * min(1.0, per_language / r["n"])) + 1) for r in counts], "lang string, below int")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.lit(1), F.length("text") - slice_chars)).cast("int") + 1
    chosen = labelled.join(F.broadcast(marks), "lang").where((draw < F.col("below")) & F.col("text").rlike(r"\p{L}"))
    rows = chosen.select("doc_id", "lang", F.substring("text", start, F.lit(slice_chars)).alias("part"), draw.alias("draw"))
    rows = rows.orderBy("draw", "lang", "doc_id", "part").limit(2 * per_language * len(counts)).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["part"]))
    return [r["part"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, per_language: int = 500, slice_chars: int = 1024, most_rows: int = 100_000, seed: int = 7) -> ByteConvNet:
    """Train on a bounded sample of the labelled documents that are not held out."""
    return train(*_sample(docs, False, per_language, slice_chars, most_rows, seed), seed)


def labelled(docs: DataFrame, held: bool) -> DataFrame:
    """(lang, text) of every document with a label and a letter, held out or not."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own.where(F.col("lang").isNotNull() & (held_out() if held else ~held_out()) & F.col("text").rlike(r"\p{L}")).select("lang", "text")


def refine(docs: DataFrame, net: ByteConvNet, rate: float = 0.0005, batch: int = 64, together: int = 4096, groups: int = 32) -> ByteConvNet:
    """The network after all windows of every labelled text that is not held out.

    Each task goes on from the given network over its own texts, ``together`` windows or one text shuffled at a time, and puts out
    its weights, some 20 KB and 200 bytes a language; the mean is weighted by windows. A text weighs less the more its language has.
    """
    if not net.classes:
        return net
    texts = labelled(docs, False)
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    mean = sum(counts.values()) / max(1, len(counts))
    place = {name: k for k, name in enumerate(net.classes)}
    worth = np.array([min(MOST_WEIGHT, mean / counts.get(name, mean)) for name in net.classes], dtype=np.float32)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = replace(net, **{k: getattr(net, k).copy() for k in WEIGHTS}), TaskContext.get().partitionId()
        adam, rng = Adam(own, (net.filters != 0).astype(np.float32)), np.random.default_rng(7)
        parts, owners, waiting, seen = [], [], 0, 0

        def run() -> None:
            x, y = np.concatenate(parts), np.repeat(owners, [len(p) for p in parts])
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                adam.step(x[take], y[take], rate, worth[y[take]])

        for rows in batches:
            for name, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                if name not in place:  # none of its texts was drawn for the start
                    continue
                parts.append(cut_windows(text.as_py().encode("utf-8", "replace")))
                owners.append(place[name])
                waiting += len(parts[-1])
                if waiting >= together:
                    run()
                    seen += waiting
                    parts, owners, waiting = [], [], 0
        if waiting:
            run()
            seen += waiting
        if seen:
            weights = np.concatenate([getattr(own, k).ravel() for k in WEIGHTS]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([task % groups], pa.int32()), pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["part", "task", "n", "weights"])

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = sum(np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n.as_py() for n, w in zip(rows.column("n"), rows.column("weights")))
        return pa.table({"n": pa.array([pc.sum(rows.column("n")).as_py()], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})

    each = texts.mapInArrow(releasing(passed), "part int, task int, n long, weights binary")
    sums = each.groupBy("part").applyInArrow(summed, "n long, weights binary").collect()  # at most ``groups`` rows
    if not sums:
        return net
    shapes = [getattr(net, k).shape for k in WEIGHTS]
    mean = sum(np.frombuffer(r["weights"]) for r in sums) / sum(r["n"] for r in sums)
    cut = np.split(mean.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return replace(net, **{k: part.reshape(s) for k, part, s in zip(WEIGHTS, cut, shapes)})


def _fold() -> np.ndarray:
    """64 kinds of bytes: letters without case, space, digit, punctuation, other signs, high bytes in fours."""
    kinds = np.empty(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        low = ord(c.lower()) - 97 if b < 128 and c.isalpha() else 26 if c in " \t\n\v\f\r" else 27 if b < 128 and c.isdigit() else 28 if c in ".,;:!?'\"-()" else 30
        kinds[b] = low if b < 128 else 31 + ((b - 128) >> 2)
    return kinds


KINDS = _fold()
PART = 1 << 18


@dataclass
class Typicality:
    """Trigram tables by language (bits in eighths) with the least likelihood and share of letters of each.

    A text passes as a language's if its bits a byte are at most 2 above those of the worst hundredth of the
    held-out texts (8 / sqrt(bytes) more for short ones), and its share of letters at least half of theirs.
    A language with fewer than ``enough`` held-out texts takes the marks of all languages together.
    """

    tables: dict[str, np.ndarray]
    marks: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, docs: DataFrame, classes: list[str], enough: int = 10) -> Typicality:
        """Tables from every labelled text of the classes that is not held out, marks from every one that is."""
        own = cls({r["lang"]: np.frombuffer(r["bits"], np.uint8) for r in trigram_tables(docs, classes).collect()}, {})
        if not own.tables:
            return own
        of = F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("of")
        values = own.measured(docs).select(of, "bits", "letters").groupBy("of")
        found = {r["of"]: r for r in values.agg(F.count("*").alias("n"), F.percentile("bits", 0.99).alias("bits"), F.percentile("letters", 0.01).alias("letters")).collect()}
        for name in own.tables:
            used = found[name] if name in found and found[name]["n"] >= enough else found.get(None)
            if used and used["n"] >= enough:
                own.marks[name] = (used["bits"] + 2, used["letters"] / 2)
        return own

    def measured(self, docs: DataFrame) -> DataFrame:
        """(lang, bits, letters) of the held-out texts, in steps of 1 / 1024 and 1 / 4096, so that quantiles hold few values."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if name in self.tables:
                        data = text.as_py().encode("utf-8", "replace")
                        rows.append((name, round(self.bits(data, name) * 1024) / 1024, round(letter_share(data) * 4096) / 4096))
                names, bits, letters = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bits, pa.float64()), pa.array(letters, pa.float64())], names=["lang", "bits", "letters"])

        return labelled(docs, True).mapInArrow(releasing(run), "lang string, bits double, letters double")

    def bits(self, data: bytes, name: str) -> float:
        """Mean bits a byte of the text under a language."""
        total = sum(int(self.tables[name][_trigrams(data[at : at + PART])].sum(dtype=np.int64)) for at in range(0, len(data), PART))
        return total / 8 / max(1, len(data))

    def passes(self, data: bytes, names: list[str]) -> bool:
        """Whether the text is typical of any of the languages; one without marks accepts all."""
        for name in names:
            if name not in self.marks:
                return True
            most, letters = self.marks[name]
            if letter_share(data) >= letters and self.bits(data, name) <= most + 8 / np.sqrt(len(data)):
                return True
        return False


def _trigrams(data: bytes) -> np.ndarray:
    k = KINDS[np.frombuffer(b" " + data + b" ", np.uint8)]
    return k[:-2] * 4096 + k[1:-1] * 64 + k[2:]


def trigram_tables(docs: DataFrame, classes: list[str], most: int = 16) -> DataFrame:
    """(lang, bits): the table of each class, from the trigrams of all its labelled texts that are not held out.

    A task holds the counts of at most ``most`` languages at a time and puts out those that are not 0.
    """
    wanted = set(classes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def add(name: str) -> None:
            sums[name] += np.bincount(np.concatenate(waiting[name]), minlength=64**3)
            waiting[name], size[name] = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for name in list(sums):
                if waiting[name]:
                    add(name)
                cells = np.flatnonzero(sums[name])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(sums.pop(name)[cells], pa.int64())], names=["lang", "cell", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in wanted:
                    continue
                if name not in sums:
                    if len(sums) >= most:
                        yield from out()
                    sums[name], waiting[name], size[name] = np.zeros(64**3, np.int64), [], 0
                data = text.as_py().encode("utf-8", "replace")
                for at in range(0, len(data), PART):
                    waiting[name].append(_trigrams(data[at : at + PART]))
                    size[name] += len(waiting[name][-1])
                    if size[name] >= PART:
                        add(name)
        yield from out()

    def table(group: pa.Table) -> pa.Table:
        n = np.zeros(64**3)
        n[group.column("cell").to_numpy()] = group.column("n").to_numpy()
        n = n.reshape(64, 64, 64)
        one = n.sum((0, 1)) + 1
        two = (n.sum(0) + 20 * one / one.sum()) / (n.sum((0, 2))[:, None] + 20)
        three = (n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20)
        bits = np.minimum(-8 * np.log2(three), 255).astype(np.uint8)
        return pa.table({"lang": group.column("lang").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    cells = labelled(docs, False).mapInArrow(releasing(counted), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    return cells.groupBy("lang").applyInArrow(table, "lang string, bits binary")


def letter_share(data: bytes) -> float:
    """Share of letters, or bytes of any sign beyond ASCII, among the bytes that are not white space."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = counts[(KINDS < 26) | (KINDS > 30)].sum()
    return float(letters / max(1, counts[KINDS != 26].sum()))


def predict(docs: DataFrame, net: ByteConvNet, block: int = 128) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(net.classes) > 0
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            sums = np.zeros((batch.num_rows, max(1, len(net.classes))), dtype=np.float64)
            windows_of = np.zeros(batch.num_rows, dtype=np.int64)
            held: list[np.ndarray] = []
            owners: list[int] = []
            count = 0

            def run() -> None:
                values = net.log_probabilities(np.concatenate(held))
                np.add.at(sums, np.repeat(owners, [len(h) for h in held]), values)

            for i, (text, letters) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                if not letters or not known:
                    continue
                windows = cut_windows(text.as_py().encode("utf-8", "replace"))
                windows_of[i] = len(windows)
                for at in range(0, len(windows), block):
                    held.append(windows[at : at + block])
                    owners.append(i)
                    count += len(held[-1])
                    if count >= block:
                        run()
                        held, owners, count = [], [], 0
            if held:
                run()
            means = sums / np.maximum(windows_of, 1)[:, None]
            shares = np.exp(means - means.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            best = means.argmax(axis=1)
            for i in range(batch.num_rows):
                names.append(net.classes[best[i]] if windows_of[i] else "und")
                scores.append(float(shares[i, best[i]]) if windows_of[i] else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    inputs = inputs.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return inputs.mapInArrow(releasing(scored), PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents' own labels and predict all of them."""
    return predict(docs, fit(docs))


def accept(docs: DataFrame, least_lead: float = 0.1) -> DataFrame:
    """The documents, all columns, that are typical of a learned language and told apart from the others; the rest go.

    least_lead: how far the best share must be from a guess (1 by the number of languages, 0) to certainty (1).
    """
    net = refine(docs, fit(docs))
    typical = Typicality.fit(docs, net.classes)
    least = (1 - least_lead) / max(1, len(net.classes)) + least_lead
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    return _accept_rows(keyed, net, typical, columns, least)


def _accept_rows(rows: DataFrame, net: ByteConvNet, typical: Typicality, columns: list[str], least: float) -> DataFrame:
    whole = rows.schema["row"].dataType
    doc_id, text = F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _keep(batch, net, typical, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["row"])

    inputs = rows.select("row", doc_id.alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return inputs.mapInArrow(releasing(filtered), f"row {whole.simpleString()}").select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def _keep(batch: pa.RecordBatch, net: ByteConvNet, typical: Typicality, least: float) -> pa.Array:
    keep = []
    for text, letters in zip(batch.column(2), batch.column(3).to_pylist()):
        if not letters or not net.classes:
            keep.append(bool(letters))
            continue
        data = text.as_py().encode("utf-8", "replace")
        windows = cut_windows(data)
        total = sum(net.log_probabilities(windows[at : at + 128]).sum(axis=0) for at in range(0, len(windows), 128)) / len(windows)
        share = np.exp(total - total.max())
        told = bool(share.max() / share.sum() >= least - 1e-9)
        keep.append(told and typical.passes(data, [net.classes[k] for k in np.argsort(-share)[:3]]))
    return pa.array(keep, pa.bool_())
