"""Mixing to target weights with soft membership.

Domains are the classes of a labelled table: quality times toxicity. A softmax classifier on words and a few shares
is fitted to at most `sample` labelled documents, chosen by a hash of their id, and gives every document its posterior
over the domains. A document's rate is how often it is taken. Rates w >= 0 minimise

    sum over domains d of (sum_i w_i n_i p_id - T_d)^2 / (2 S_d)  +  ridge/2 * sum_i n_i (w_i - 1)^2

where n_i is the number of tokens of a document in a public vocabulary, p its posterior, T the target totals and
S_d = sum_i n_i p_id. Projected gradient descent with momentum: each iteration sums the expected totals over all
documents and steps all rates against the domains' residuals, until the rates move by less than `tolerance` a token;
`iterations` without that are an error. A document's rate is a function of its posterior and of the residuals so
far, so an iteration carries nothing but these few numbers. Documents are summed once before, by cells of the simplex
of posteriors (`grid` steps a side): a cell has the tokens of its documents and their mean posterior. The final rates
are those of each document's own posterior.

The totals come as near to the targets as rates by posterior can bring them: where posteriors overlap, a domain of
target 0 keeps what the others' documents hold of it.

Null and empty texts: no tokens; they have the posterior of a text without features and take no part in the totals.
Very long texts are read whole. Repeated rows and copies: the same rate. Ties in choosing words or labelled documents
go by the word or the id. Labels: of rows with one doc_id the least count; of documents with one doc_id the least text
is fitted to; null labels are left out. Rows of null doc_id: rates as any row. Without any labels there is one domain
and all rates are its target weight. Empty table: no rows. Other columns, whatever their names, are kept by `mixed` and
ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_words, fresh_name, materialise, release, small_batches, table, word_bpe

#: Target totals as shares of what there is, by (quality, toxic).
TARGETS = {(1, 0): 1.0, (0, 0): 0.75, (1, 1): 0.0, (0, 1): 0.0}
DENSE = 5
#: Words that a worker keeps the ids of.
KNOWN = 400_000
_SIGNS = b".,;:!?\"'()[]#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def bare(word: bytes) -> bytes:
    """A word without signs around it, A-Z as a-z."""
    return word.strip(_SIGNS).lower()


def dense(text: str, distinct: int, words: int) -> list[float]:
    """Shares that don't depend on which words there are."""
    data = text.encode()
    n = max(len(data), 1)
    letters, upper = len(data) - len(data.translate(None, _LETTERS)), len(data) - len(data.translate(None, _UPPER))
    lines = text.split("\n")
    return [1.0, upper / max(letters, 1), min(1.0, 8 * sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!"))) / n), len(set(lines)) / len(lines), distinct / max(words, 1)]


class Softmax:
    """Softmax on the presence of chosen words and on dense shares."""

    def __init__(self, words: list[bytes], weights: np.ndarray, path: str):
        self.place, self.weights, self.path = {w: i for i, w in enumerate(words)}, weights, path

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Features and numbers of tokens."""
        lists, coded = coded_words(texts)
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        place = np.fromiter((self.place.get(bare(w), -1) for w in words), np.int32, len(words))
        size = np.fromiter(map(len, word_bpe(self.path, KNOWN).of_words(words)), np.int64, len(words)) // 2
        codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        of = np.repeat(np.arange(len(texts)), np.diff(ends))
        x = np.zeros((len(texts), len(self.place) + DENSE), np.float32)
        at = place[codes]
        x[of[at >= 0], at[at >= 0]] = 1
        for i, t in enumerate(texts):
            a, b = ends[i], ends[i + 1]
            x[i, len(self.place) :] = dense(t.as_py() or "", len(np.unique(codes[a:b])), b - a)
        tokens = np.zeros(len(texts), np.int64)
        np.add.at(tokens, of, size[codes])
        return x, tokens

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True)).astype(np.float64)


def fit(model: Softmax, x: np.ndarray, y: np.ndarray, classes: int, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Softmax:
    """The model with weights fitted by gradient descent to features and classes."""
    model.weights = np.zeros((x.shape[1], classes), np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    speed = np.zeros_like(model.weights)
    for _ in range(steps):
        grad = x.T @ (model.posterior(x).astype(np.float32) - target) / max(len(y), 1) * 4 + decay * model.weights
        speed = 0.9 * speed - rate * grad
        model.weights = model.weights + speed
    return model


def _distinct_words(batches):
    """mapInArrow over (class, text): (class, word) once for each text."""
    for batch in batches:
        for c, t in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist()):
            words = sorted({bare(w) for w in (t or "").encode().split()})
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(words), pa.int32()), pa.array(words, pa.binary())], ["class", "word"])


def _sample_features(model: Softmax):
    def run(batches):
        for batch in batches:
            x, _ = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("class"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "class", "x"])

    return run


def classifier(docs: DataFrame, labels: DataFrame, path: str, sample: int = 4096, words: int = 512) -> tuple[Softmax, list[tuple[int, int]]]:
    """A model fitted to at most `sample` labelled documents, and its classes. The driver sees no texts, only their features."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "l.quality", "l.toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    rows = materialise(rows, "sample")
    sizes = {(r["quality"], r["toxic"]): r["n"] for r in rows.groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()}
    classes = sorted(sizes, reverse=True) or [(1, 0)]
    number = F.coalesce(*(F.when((F.col("quality") == q) & (F.col("toxic") == t), i) for i, (q, t) in enumerate(classes))).cast("int")
    rows = rows.select("doc_id", "text", number.alias("class"))
    # the words that tell the classes apart best by chi-square
    total = max(sum(sizes.values()), 1)
    seen = rows.select("class", "text").mapInArrow(_distinct_words, "class int, word binary").groupBy("word").agg(*(F.sum((F.col("class") == i).cast("double")).alias(f"c{i}") for i in range(len(classes))))
    held = sum(F.col(f"c{i}") for i in range(len(classes)))
    chi = F.lit(0.0)
    for i, c in enumerate(classes):
        expected = held * (sizes.get(c, 0) / total)
        chi = chi + F.pow(F.col(f"c{i}") - expected, 2) / F.greatest(expected, F.lit(0.5))
    best = sorted(bytes(r["word"]) for r in seen.orderBy(chi.desc(), "word").limit(words).select("word").collect())
    model = Softmax(best, np.zeros((len(best) + DENSE, len(classes)), np.float32), path)
    got = sorted((r["doc_id"], r["class"], bytes(r["x"])) for r in rows.mapInArrow(_sample_features(model), "doc_id long, class int, x binary").collect())
    release(rows)
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), len(best) + DENSE)
    return fit(model, x, np.array([r[1] for r in got], np.int64), len(classes)), classes


class Descent:
    """Projected gradient with momentum, as a function of posteriors and of the residuals so far."""

    def __init__(self, ridge: float):
        self.ridge, self.pace = ridge, 1 / (1 + ridge)
        q = (ridge / (1 + ridge)) ** 0.5
        self.momentum = (1 - q) / (1 + q)

    def rates(self, p: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates after the steps, the point at which the next residuals are taken, and the last move."""
        w = y = np.ones(len(p))
        move = np.full(len(p), np.inf)
        for g in steps:
            new = np.maximum(0.0, y - self.pace * (p @ g + self.ridge * (y - 1)))
            move = np.abs(new - y)
            y = new + self.momentum * (new - w)
            w = new
        return w, y, move


def _posteriors(model: Softmax, p_name: str, n_name: str, block: int = 1000):
    """mapInArrow: the rows with posterior and number of tokens added."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            blocks = [model.features(texts.slice(i, block)) for i in range(0, max(len(texts), 1), block)]
            p = np.concatenate([model.posterior(x) for x, _ in blocks])
            n = np.concatenate([n for _, n in blocks])
            yield batch.append_column(p_name, pa.array(list(p), pa.list_(pa.float64()))).append_column(n_name, pa.array(n))

    return run


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _cells(d: int, grid: int):
    """mapInArrow over (posterior, n): for each cell of a task (cell, tokens, tokens by domain)."""

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            p, n = _matrix(batch.column("p"), d), batch.column("n").to_numpy()
            cells, of = np.unique(np.rint(p * grid).astype(np.uint8), axis=0, return_inverse=True)
            sums = np.zeros((len(cells), d + 1))
            np.add.at(sums, of.ravel(), np.column_stack([n, n[:, None] * p]))
            for c, s in zip(cells, sums):
                key = c.tobytes()
                held[key] = held[key] + s if key in held else s
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([held[k][i] for k in keys], pa.float64()) for i in range(d + 1))], ["cell", "n", *(f"t{i}" for i in range(d))])

    return run


def _totals(descent: Descent, steps, d):
    """mapInArrow over cells: expected totals by domain at the next point, then tokens times move."""

    def run(batches):
        out = np.zeros(d + 1)
        for batch in batches:
            n = batch.column("n").to_numpy()
            t = np.column_stack([batch.column(f"t{i}").to_numpy() for i in range(d)])
            _, y, move = descent.rates(t / np.maximum(n, 1e-9)[:, None], steps)
            out[:d] += y @ t
            out[d] += move @ n if steps else 0.0
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(out)], ["d", "total"])

    return run


def descend(known: DataFrame, classes: list, targets: dict, iterations: int, ridge: float, tolerance: float, grid: int) -> tuple[Descent, list[np.ndarray]]:
    """The steps that bring the expected totals of known(p, n) to the targets."""
    d, descent = len(classes), Descent(ridge)
    cells = known.mapInArrow(_cells(d, grid), "cell binary, n double, " + ", ".join(f"t{i} double" for i in range(d))).groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(d)))
    cells = materialise(cells.where("n > 0"), "cells")
    points = cells.drop("cell")
    tokens = points.agg(F.sum("n")).first()[0] or 0.0
    steps: list[np.ndarray] = []
    size = target = None
    for _ in range(iterations):
        got = {r["d"]: r["total"] for r in points.mapInArrow(_totals(descent, steps, d), "d int, total double").groupBy("d").agg(F.sum("total").alias("total")).collect()}
        total = np.array([got.get(k, 0.0) for k in range(d)])
        if size is None:
            size = np.maximum(total, 1e-9)
            target = size * np.array([targets.get(c, 1.0) for c in classes])
        if not tokens or (steps and got[d] < tolerance * tokens):
            break
        steps.append((total - target) / size)
    else:
        raise RuntimeError(f"rates still move by {got[d] / tokens:.2g} a token after {iterations} iterations")
    release(cells)
    return descent, steps


def mix_rates(docs: DataFrame, labels: DataFrame, path: str, targets: dict = TARGETS, sample: int = 4096, iterations: int = 500, ridge: float = 0.03, tolerance: float = 1e-4, grid: int = 64) -> DataFrame:
    """doc_id, n_tokens, posterior, rate of every row of docs(doc_id, text)."""
    model, classes = classifier(docs, labels, path, sample)
    d = len(classes)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        known = ids.mapInArrow(_posteriors(model, "p", "n"), "doc_id long, text string, p array<double>, n long")
        known = materialise(known.select("doc_id", "p", "n"), "posteriors")
    descent, steps = descend(known.select("p", "n"), classes, targets, iterations, ridge, tolerance, grid)

    def final(batches):
        for batch in batches:
            w, _, _ = descent.rates(_matrix(batch.column("p"), d), steps)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("p"), pa.array(np.round(w, 6))], ["doc_id", "n_tokens", "posterior", "rate"])

    return known.mapInArrow(final, "doc_id long, n_tokens long, posterior array<double>, rate double")


def mixed(docs: DataFrame, labels: DataFrame, path: str, targets: dict = TARGETS, sample: int = 4096, iterations: int = 500, ridge: float = 0.03, tolerance: float = 1e-4, grid: int = 64) -> DataFrame:
    """docs, all columns, each row as often as its rate says: the whole part, and the fraction by a hash of doc_id and text.

    So the totals taken are those of the rates, but for chance. Texts are written once with their posteriors and don't
    move between tasks.
    """
    model, classes = classifier(docs, labels, path, sample)
    d = len(classes)
    p, n, u = (fresh_name(docs, x) for x in ("posterior_", "tokens_", "chance_"))
    chance = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0).alias(u)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    with small_batches(docs.sparkSession):
        known = materialise(docs.select(*(F.col(f"`{c}`") for c in docs.columns), chance).mapInArrow(_posteriors(model, p, n), f"{kinds}, `{u}` double, `{p}` array<double>, `{n}` long"), "posteriors")
    descent, steps = descend(known.select(F.col(p).alias("p"), F.col(n).alias("n")), classes, targets, iterations, ridge, tolerance, grid)
    columns = docs.columns

    def taken(batches):
        for batch in batches:
            w, _, _ = descent.rates(_matrix(batch.column(p), d), steps)
            copies = np.floor(np.round(w, 6) + batch.column(u).to_numpy()).astype(np.int64)
            yield batch.select(columns).take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    return known.mapInArrow(taken, docs.schema)


def op8_soft_mixing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), public_tokenizers.path("word_bpe_49k.json"))
