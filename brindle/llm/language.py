"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features of a word are its byte n-grams (2 to 5, with word-boundary marks), hashed into buckets.
A text's vector is the mean of the embeddings of all its features, and a linear softmax sits on
top; both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``sample`` of them, chosen by a hash of doc_id and text: a documented bound). Scores are calibrated on rows
that training does not see, each fifth of the sample under a model of the other four: a temperature
of at least 1 (a smaller one would push every score to 1, strange texts' too), and as rejection
threshold the score below which a thousandth of these rows' rightly predicted texts lie.

After training, embedding and softmax fold into one table of a few numbers a bucket, so that
prediction is a sum over words, computed once for each distinct word of a slice.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.0 and rejected;
rows with a null language teach nothing; with no labelled row every text is ``und``; with fewer than
20, or a single language, no text with a letter is rejected; repeated rows are
predicted as often as they occur; columns other than doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import mix, rolling, slices, split_words

ORDERS = (2, 3, 4, 5)
#: Byte values of the word-boundary marks; they don't occur in UTF-8.
BEGIN, END = 0xFE, 0xFF
#: Sampling keys are below this number.
_KEYS = 1 << 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that is kept from training."""
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def _buckets(words: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of distinct words, and which word each belongs to."""
    array = words.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    flat = np.empty(len(data) + 2 * len(array), dtype=np.uint8)
    begins = offsets[:-1] + 2 * np.arange(len(array))
    flat[begins] = BEGIN
    flat[begins + lengths + 1] = END
    body = np.ones(len(flat), dtype=bool)
    body[begins] = body[begins + lengths + 1] = False
    flat[body] = data
    owner = np.repeat(np.arange(len(array)), lengths + 2)
    hashes = _BYTE[flat]
    found, owners = [], []
    for n in ORDERS:
        if len(flat) >= n:
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            found.append((rolling(hashes, n)[inside] % np.uint64(n_buckets)).astype(np.int64))
            owners.append(owner[: len(owner) - n + 1][inside])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class LanguageModel:
    """The folded model: logits of a text are the mean of its features' rows of ``table``, plus ``bias``."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        codes, offsets, words = split_words(texts)
        buckets, owner = _buckets(words, len(self.table))
        per_word = np.stack([np.bincount(owner, weights=self.table[buckets, k], minlength=len(words)) for k in range(len(self.labels))])
        features = np.bincount(owner, minlength=len(words)).astype(float)
        sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[codes])])[offsets])
        count = np.maximum(sums(features), 1)
        return np.stack([sums(row) / count for row in per_word], axis=1) + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best label's index and its calibrated probability."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: pa.Array, n_buckets: int) -> np.ndarray:
    """Feature counts of each text, one dense row each, scaled down where they would not fit into 16 bits."""
    codes, offsets, words = split_words(texts)
    buckets, owner = _buckets(words, n_buckets)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(words) + 1))
    buckets = buckets[order]
    out = np.zeros((len(texts), n_buckets), dtype=np.uint16)
    for i in range(len(texts)):
        used, times = np.unique_counts(codes[offsets[i] : offsets[i + 1]])
        n = begin[used + 1] - begin[used]
        if n.sum():
            at = np.repeat(begin[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            counts = np.bincount(buckets[at], weights=np.repeat(times, n), minlength=n_buckets)
            out[i] = counts // max(1, -(-counts.max() // 0xFFFF))
    return out


def _descend(bags: np.ndarray, y: np.ndarray, learn: np.ndarray, n_labels: int, dim: int, epochs: int, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on the rows ``learn``: the folded table and the bias."""
    n_buckets = bags.shape[1]
    scale = float(n_buckets) ** 0.5  # evens out that a mean over many features is small
    embedding = rng.normal(0, 1, (n_buckets, dim)).astype(np.float32) / scale
    weights = np.zeros((dim, n_labels), dtype=np.float32)
    bias = np.zeros(n_labels, dtype=np.float32)
    share = np.bincount(y[learn], minlength=n_labels).astype(np.float32)
    balance = (share.sum() / np.maximum(share, 1) / n_labels)[y]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 32)):
            x = bags[at] * scale
            hidden = x @ embedding
            error = softmax(hidden @ weights + bias).astype(np.float32)
            error[np.arange(len(at)), y[at]] -= 1
            error *= balance[at][:, None] / len(at)
            back = error @ weights.T
            weights -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            embedding -= step * (x.T @ back)
    return (embedding * scale @ weights).astype(np.float64), bias.astype(np.float64)


def train(bags: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 20, rate: float = 0.2, seed: int = 0) -> LanguageModel:
    """The model of four fifths of the rows (mean feature counts), calibrated on every fifth under the model of the others."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_cal = len(y) // 5 if len(y) >= 20 else 0
    folds = np.split(order, n_cal * np.arange(1, 5)) if n_cal else [order[:0]]
    logits = np.zeros((len(y), len(labels)))
    model = None
    for fold in folds:
        table, bias = _descend(bags, y, order[~np.isin(order, fold)], len(labels), dim, epochs, rate, rng)
        logits[fold] = bags[fold] @ table + bias
        model = model or LanguageModel(labels, table, bias, 1.0, 0.0)
    if n_cal:
        grid = np.geomspace(1, 20, 60)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            model.threshold = float(np.quantile(p.max(axis=1)[right], 0.001))
    return model


def fit(docs: DataFrame, sample: int = 2000, n_buckets: int = 4096, seed: int = 0) -> LanguageModel | None:
    """Train on at most ``sample`` labelled rows outside the held-out fold.

    Whole texts become feature counts where they lie; the driver gets ``sample`` rows of ``n_buckets`` small numbers, compressed.
    """

    def bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            rows = [zlib.compress(row.tobytes(), 1) for part in slices(pa.RecordBatch.from_arrays([whole], names=["text"]), "text") for row in _bags(part["text"], n_buckets)]
            yield pa.array(rows, pa.binary())

    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_KEYS))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()).select("doc_id", "text", "lang", key.alias("_key"))
    # the smallest keys are the sample
    last = labelled.select("_key").orderBy("_key").limit(sample).agg(F.max("_key")).first()[0]
    if last is None:
        return None
    some = labelled.filter(F.col("_key") <= last).select("_key", "doc_id", "lang", F.arrow_udf(bags, "binary")("text").alias("bag"))
    chosen = some.orderBy("_key", "doc_id", "lang").limit(sample).toArrow()
    counts = np.frombuffer(b"".join(map(zlib.decompress, chosen["bag"].to_pylist())), dtype=np.uint16).reshape(-1, n_buckets).astype(np.float32)
    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return train(counts, chosen["lang"].to_pylist(), seed=seed)


def predicted(text: Column, model: LanguageModel | None) -> Column:
    """(lang_pred, score, rejected) of a text. Texts alone reach Python, a slice at a time; other columns stay where they are.

    The folded model (labels, one small table of fixed size) travels with the task.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole, letters in batches:
            batch = pa.RecordBatch.from_arrays([whole, letters], names=["text", "letters"])
            parts = [_verdicts(part["text"], part["letters"], model) for part in slices(batch, "text")]
            yield pa.concat_arrays(parts) if parts else pa.array([], _VERDICT)

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


_VERDICT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _verdicts(texts: pa.Array, has_letter: pa.Array, model: LanguageModel | None) -> pa.Array:
    letters = has_letter.to_numpy(zero_copy_only=False)
    labels, score = np.full(len(letters), "und", dtype=object), np.zeros(len(letters))
    if model is not None:
        best, p = model.predict(texts)
        labels = np.where(letters, np.array(model.labels, dtype=object)[best], "und")
        score = np.where(letters, p, 0.0)
    rejected = ~letters | (score < (model.threshold if model is not None else 1.0))
    return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(score), pa.array(rejected)], fields=list(_VERDICT))


def predict(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then lang_pred, score and rejected of every row; a kept column of such a name is left out."""
    kept = [c for c in dict.fromkeys(("doc_id", *keep)) if c not in ("lang_pred", "score", "rejected")]
    marked = docs.select(*(F.col(c).alias(f"_keep_{c}") for c in kept), predicted(F.col("text"), model).alias("_verdict"))
    return marked.select(*(F.col(f"_keep_{c}").alias(c) for c in kept), "_verdict.lang_pred", "_verdict.score", "_verdict.rejected")
