"""Language identification: multinomial logistic regression on TF-IDF character n-grams, learnt by FTRL-proximal.

Corpus statistics (document frequencies, languages) cover every training row; the weights are fitted on a bounded sample of them
and calibrated with a temperature on other rows; every document is then scored over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.shared import send

UNKNOWN = "und"
PIECE_CHARS = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Parameters of a fit.

    ``fit_rows`` and ``fit_chars`` bound the labelled sample that weights and temperature are learnt from: at most so many rows
    for each language, chosen by a hash of the id, and at most so many rows in all. Nothing else is bounded.
    """

    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    rows_per_language: int = 1000
    fit_rows: int = 4000
    calibration_share: float = 0.2
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    seed: int = 17


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (bucket x language), biases and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings = field(default_factory=Settings)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages for one count vector."""
        index, value = weigh(counts, self.idf)
        logits = value @ self.weights[index] + self.bias
        return softmax(logits / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); a text that is null or has no letter is ``und`` with 0."""
        if text is None or not any(map(str.isalpha, text)) or not self.languages:
            return UNKNOWN, 0.0
        p = self.scores(ngram_counts(text, self.settings))
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _letters() -> np.ndarray:
    """By code point, whether it is a letter; the rest counts as a gap between words."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


class _Letters:
    """The letter table, made once in each process that needs it."""

    def __init__(self) -> None:
        self.table: np.ndarray | None = None

    def get(self) -> np.ndarray:
        if self.table is None:
            self.table = _letters()
        return self.table

    def __getstate__(self) -> dict:
        return {"table": None}


LETTERS = _Letters()


def ngram_counts(text: str, settings: Settings, letters: _Letters = LETTERS) -> np.ndarray:
    """How often each bucket of the hashed n-grams occurs in the whole text.

    Lower-cased; each run of other characters than letters is one gap. The text is read in pieces that overlap by the longest
    n-gram, so memory is bounded. The count vector has a fixed length.
    """
    counts = np.zeros(settings.buckets, np.int64)
    longest = max(settings.orders)
    table = letters.get()
    tail = np.zeros(0, np.uint32)
    for start in range(0, len(text), PIECE_CHARS):
        points = np.frombuffer(text[start : start + PIECE_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(table[points], points, 32)
        first = start == 0
        joined = np.concatenate((np.array([32], np.uint32) if first else tail, points))
        if start + PIECE_CHARS >= len(text):
            joined = np.append(joined, np.uint32(32))
        joined = joined[np.insert((joined[1:] != 32) | (joined[:-1] != 32), 0, True)]
        known = 0 if first else len(tail)
        tail = joined[len(joined) - longest + 1 :] if longest > 1 else joined[:0]
        wide = joined.astype(np.uint64)
        for n in settings.orders:
            size = len(wide) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for i in range(n):
                h = (h ^ wide[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            # N-grams wholly inside the overlap were counted with the piece before.
            counts += np.bincount((h[max(0, known - n + 1) :] % np.uint64(settings.buckets)).astype(np.int64), minlength=settings.buckets)
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF vector of unit length: buckets and values, with logarithmic term frequencies."""
    index = np.flatnonzero(counts)
    value = (1 + np.log(counts[index])) * idf[index]
    norm = np.sqrt(value @ value)
    return index, value / norm if norm else value


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def document_frequencies(train: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(bucket, df) over every row: each task counts into one vector, the vectors are summed by bucket."""

    def run(batches):
        found, rows = np.zeros(settings.buckets, np.int64), 0
        for batch in batches:
            for t in _texts(batch.column(0)):
                if t is not None:
                    found += ngram_counts(t, settings) > 0
                    rows += 1
        index = np.flatnonzero(found)
        # Bucket -1 carries the number of rows.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(index, -1), pa.int32()), pa.array(np.append(found[index], rows), pa.int64())], names=["bucket", "df"]
        )

    parts = train.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, df long")
    return parts.groupBy("bucket").agg(F.sum("df").alias("df"))


def sample_rows(train: DataFrame, id: str, text: str, lang: str, settings: Settings) -> DataFrame:
    """(lang, text, calibrate): the bounded labelled sample, the same rows at every run.

    The choice is made on hashes alone. Equal rows (same id, text and language) count as one: they are merged inside the tasks before
    their hashes are shuffled, and again before the chosen texts are. The limit of each language is applied inside the tasks, too.
    """
    chance = F.xxhash64(F.lit(settings.seed), F.col(id), F.xxhash64(F.col(text)))
    ranked = train.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), chance.alias("chance"))
    by_language = Window.partitionBy("lang").orderBy("chance")
    different = ranked.groupBy("lang", "chance").agg(F.count("*").alias("n")).select("lang", "chance")
    # A language of more rows is first cut by the hash itself: twice as many as wanted are expected below the cut, so that no task
    # sorts more than a few thousand hashes of a language.
    many = different.groupBy("lang").agg(F.count("*").alias("rows"))
    cut = F.lit(-(2.0**63)) + F.lit(2.0**64) * (2 * settings.rows_per_language + 100) / F.col("rows")
    chosen = (
        different.join(many, "lang").where(F.col("chance") <= cut).select("lang", "chance")
        .withColumn("place", F.row_number().over(by_language))
        .where(F.col("place") <= settings.rows_per_language)
        .orderBy("place", "lang")
        .limit(settings.fit_rows)
        .select("lang", "chance")
    )
    # At most ``fit_rows`` short rows: a proven bound.
    rows = ranked.join(F.broadcast(chosen), ["lang", "chance"], "left_semi").dropDuplicates(["lang", "chance"])
    return rows.withColumn(
        "calibrate", F.pmod(F.xxhash64(F.lit(settings.seed + 1), "chance"), F.lit(1000)) < int(1000 * settings.calibration_share)
    )


def _vectors(sample: DataFrame, settings: Settings) -> list:
    """The sample's count vectors, as sparse arrays."""

    def run(batches):
        for batch in batches:
            index, value = [], []
            for t in _texts(batch.column(1)):
                counts = ngram_counts(t, settings)
                at = np.flatnonzero(counts)
                index.append(at.astype("<u4").tobytes())
                value.append(np.minimum(counts[at], 1 << 30).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                names=["lang", "chance", "calibrate", "at", "counts"],
            )

    rows = sample.select("lang", "text", "chance", "calibrate").mapInArrow(
        run, "lang string, chance long, calibrate boolean, at binary, counts binary"
    )
    table = rows.toArrow()
    order = np.argsort(np.array(table["chance"].to_pylist(), np.int64), kind="stable")
    columns = [table[c].to_pylist() for c in ("lang", "calibrate", "at", "counts")]
    return [[c[i] for c in columns] for i in order]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the elastic-net multinomial regression, one row at a time.

    FTRL-proximal: each weight follows the leader of all gradients so far, with its own learning rate; weights whose summed
    gradient stays within ``l1`` are exactly zero. The bias is a weight without penalty.
    """
    size = settings.buckets
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    l1 = np.full(size + 1, settings.l1)[:, None]
    l1[size] = 0

    def leader(at: np.ndarray) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -pull / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2 * (l1[at] > 0))

    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            index, value, y = rows[i]
            at, x = np.append(index, size), np.append(value, 1.0)
            w = leader(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = leader(np.arange(size + 1))
    return w[:size], w[size]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, step = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(train: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """A model from the rows with a language and a text. No such rows: a model without languages, which predicts ``und``."""
    labelled = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    frequencies = {r.bucket: r.df for r in document_frequencies(labelled, text, settings).collect()}
    total = frequencies.pop(-1, 0)
    df = np.zeros(settings.buckets)
    df[list(frequencies)] = list(frequencies.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = _vectors(sample_rows(labelled, id, text, lang, settings), settings)
    languages = sorted({r[0] for r in rows})
    number = {v: i for i, v in enumerate(languages)}
    ready: list[list] = [[], []]
    for name, calibrate, at, counts in rows:
        full = np.zeros(settings.buckets, np.int64)
        full[np.frombuffer(at, "<u4")] = np.frombuffer(counts, "<u4")
        ready[calibrate].append((*weigh(full, idf), number[name]))
    learn, check = ready
    if not learn:
        learn, check = check, []
    weights, bias = ftrl(learn, len(languages), settings) if languages else (np.zeros((settings.buckets, 0)), np.zeros(0))
    heat = 1.0
    if check and len(languages) > 1:
        logits = np.array([v @ weights[i] + bias for i, v, _ in check])
        heat = temperature(logits, np.array([y for _, _, y in check]))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), heat, settings)


def _model(settings: dict, **parts) -> Model:
    return Model(settings=Settings(**settings), **parts)


def identify(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the predicted language and its calibrated probability.

    The model has a fixed size (buckets x languages of the bounded sample), so it is broadcast. Null texts and texts without a
    letter give ``und`` and 0; of equal probabilities the language that comes first by name wins; columns that are named like the new
    ones are replaced; empty tables stay empty.
    """
    made = send(docs.sparkSession, _model, **vars(model) | {"settings": vars(model.settings)})
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in into}]

    @F.pandas_udf("lang string, score double")
    def guess(texts):
        import pandas as pd

        model = made()
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn("__guess", guess(F.col(text).cast("string"))).select(
        *kept, F.col("__guess.lang").alias(into[0]), F.col("__guess.score").alias(into[1])
    )


def held_out(id: str = "doc_id") -> Column:
    """True for the rows kept out of learning: crc32 of the id as text leaves 2 modulo 4. A row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.5, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is predicted with a probability of ``least`` or more; unreadable and null texts go."""
    model = fit(docs.where(~held_out(id)), id, text, lang)
    judged = identify(docs, model, text, ("__lang", "__score"))
    return judged.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)
