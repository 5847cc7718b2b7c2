"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import chunks
from .common import bounded_sample, documents, map_texts

BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)  # lengths of the hashed subwords, in bytes, of a word between two marks
WIDTH = 16
UNKNOWN = "und"
PIECES = (1, 3, 10, 30, 100, 300)  # words of the held-back pieces that calibrate, besides whole texts
EDGES = (16, 64, 256, 1024, 4096)  # numbers of subwords at which a class of lengths begins
CLASS_ROWS = 50  # a class of fewer pieces is calibrated on all of them
ALPHA = 0.002  # share of the right pieces that rejection loses
ERROR = 0.01  # wrong pieces among the accepted, as far as losing no more than LOST of the right gives it
LOST = 0.01


# ---- features -----------------------------------------------------------------------
def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of all words, and how many each word has."""
    raw = [b"<" + w.encode() + b">" for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    n = int(length.sum())
    word = np.repeat(np.arange(len(raw)), length)
    room = np.repeat(np.cumsum(length), length) - np.arange(n)  # bytes up to the word's end
    found, owner, h = [], [], np.zeros(n, np.uint64)
    for k in range(max(GRAMS)):
        h = (h * np.uint64(1099511628211)) ^ (flat[k : k + n] + np.uint64(1))
        if k + 1 in GRAMS:
            ok = room > k
            mixed = (h[ok] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
            owner.append(word[ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(raw))


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


# ---- training --------------------------------------------------------------------------
class Model:
    """Class scores of each bucket (embedding times softmax weights), bias, temperature
    and, for each class of lengths, the confidence below which a prediction is rejected."""

    def __init__(self, langs, scores, bias, temperature):
        self.langs, self.scores, self.bias, self.temperature = langs, scores, bias, temperature
        self.thresholds = np.zeros(len(EDGES) + 1)

    def probabilities(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def accepts(self, score: np.ndarray, count: np.ndarray) -> np.ndarray:
        return score >= self.thresholds[np.searchsorted(EDGES, count, "right")]

    def calibrate(self, texts: list[tuple[list[str], int]], rng: np.random.Generator) -> None:
        """Thresholds of the predicted language's probability, from pieces of texts (words,
        language) of all lengths."""
        total, count, y = [], [], []
        for words, lang in texts:
            for size in {min(k, len(words)) for k in (*PIECES, len(words))} - {0}:
                at = rng.integers(len(words) - size + 1)
                buckets, _ = subwords(words[at : at + size])
                total.append(self.scores[buckets].sum(axis=0, dtype=np.float64))
                count.append(len(buckets))
                y.append(lang)
        if not y:
            return
        count = np.array(count)
        p = self.probabilities(np.stack(total), count)
        score, right = p.max(axis=1), p.argmax(axis=1) == np.array(y)
        kind = np.searchsorted(EDGES, count, "right")
        for c in range(len(self.thresholds)):
            mine = kind == c if (kind == c).sum() >= CLASS_ROWS else np.ones(len(kind), bool)
            self.thresholds[c] = threshold(score[mine], right[mine]) - 1e-6  # rounding of the sums


def threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The ALPHA quantile of the right scores; more, if more than ERROR of what it accepts
    is wrong, up to the LOST quantile. With no right score nothing is accepted."""
    if not right.any():
        return np.inf
    low, high = (float(np.quantile(score[right], a)) for a in (ALPHA, LOST))
    for t in np.append(np.unique(score[(score > low) & (score < high)]), high):
        if (~right[score >= low]).mean() <= ERROR:
            break
        low = float(t)
    return low


def train(rows: list[tuple[str, str]], segment: int = 40, rounds: int = 2, rate: float = 0.5) -> Model:
    """Stochastic gradient descent on labelled texts; every fifth text only calibrates.

    Whole texts are used, cut into segments of some words, so that short documents are
    seen as well. The temperature minimises the loss on the calibration part, and the
    rejection thresholds come from pieces of it (see ``threshold``). Fewer than five texts
    leave none for it: then those that the model is fitted on calibrate.
    """
    rng = np.random.default_rng(5)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0)
    samples: list[list[tuple[np.ndarray, int]]] = [[], []]
    whole: list[tuple[list[str], int]] = []
    for number, (text, lang) in enumerate(rows):
        words = [w for w in text.lower().split() if has_letter(w)]
        if number % 5 == 4 or len(rows) < 5:
            whole.append((words, langs.index(lang)))
        for k in range(0, len(words), segment):
            buckets, _ = subwords(words[k : k + segment])
            samples[number % 5 == 4].append((buckets, langs.index(lang)))
    fit, hold = samples
    emb = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    out, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    steps = rounds * max(1, len(fit))
    for step in range(steps):
        if step % len(fit or [0]) == 0:
            order = rng.permutation(len(fit))
        if not fit:
            break
        buckets, y = fit[order[step % len(fit)]]
        lr = rate * (1 - step / steps)
        mean = emb[buckets].mean(axis=0)
        z = mean @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = out @ p
        out -= lr * np.outer(mean, p)
        bias -= lr * 0.1 * p
        np.subtract.at(emb, buckets, lr * back / len(buckets) * 4)
    scores = emb @ out
    model = Model(langs, scores.astype(np.float32), bias, 1.0)
    if hold:
        total = np.stack([scores[b].sum(axis=0) for b, _ in hold])
        count, y = np.array([len(b) for b, _ in hold]), np.array([y for _, y in hold])

        def loss(t):
            model.temperature = t
            return -np.log(model.probabilities(total, count)[np.arange(len(y)), y] + 1e-12).mean()

        model.temperature = min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=loss)
    model.calibrate(whole, rng)
    return model


# ---- prediction -----------------------------------------------------------------------------
WORDS = 10_000  # distinct words whose subwords are hashed at a time
STEP = 4 << 20  # bytes of text whose distinct words are scored at a time


class Scorer:
    """Sums of class scores over texts' words; each distinct word of some megabytes of text is
    scored once, and nothing is kept for the next."""

    def __init__(self, model: Model):
        self.model = model

    def table(self, words: list[str]) -> np.ndarray:
        """For each word: class score sums, number of subwords, whether there is a letter."""
        out = np.zeros((len(words), self.model.scores.shape[1] + 2), np.float32)
        some = [i for i, w in enumerate(words) if has_letter(w)]
        for k in range(0, len(some), WORDS):
            at = some[k : k + WORDS]
            buckets, count = subwords([words[i].lower() for i in at])
            ends = np.cumsum(count)
            out[at, :-2] = np.add.reduceat(self.model.scores[buckets], ends - count, axis=0)
            out[at, -2], out[at, -1] = count, 1
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class score sums, numbers of subwords, and whether there is a letter."""
        rows, words = chunks(pc.utf8_split_whitespace(texts))
        table = self.table(words.to_pylist())
        total = np.zeros((len(texts), table.shape[1]))
        for c in range(table.shape[1] if len(texts) else 0):
            total[:, c] = np.add.reduceat(table[:, c][rows.values], rows.starts[:-1], dtype=np.float64)
        return total[:, :-2], total[:, -2], total[:, -1] > 0


def sample_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> list[tuple[str, str]]:
    """At most ``rows`` labelled rows, those whose id hashes lowest: the bounded sample
    that the model is fitted on. Null texts among them teach nothing."""
    found = bounded_sample(df.filter(F.col(lang_col).isNotNull()), [text_col, lang_col], F.col(id_col), rows)
    return [(r[0], r[1]) for r in found if r[0] is not None]


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (probability of it) and accepted (score not below the
    threshold calibrated for texts of that length). Texts that are null or have no letter give ``und``, 0.0 and
    false. Only the text decides. Other columns pass through; those of the same names
    are replaced; repeated rows stay; an empty table gives none.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the input

    def make():
        scorer = Scorer(shared.value)

        def run(texts):
            total, count, letter = scorer(texts)
            p = scorer.model.probabilities(total, count)
            best = p.argmax(axis=1)
            score = np.where(letter, p[np.arange(len(best)), best], 0.0)
            names = [scorer.model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            return [pa.array(names, pa.string()), pa.array(score), pa.array(letter & scorer.model.accepts(score, count))]

        return run

    return map_texts(df, text_col, fields, make, STEP)


TRAIN_ROWS = 1500  # bound of the labelled sample


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(df: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled documents that are not held out (a null doc_id is)."""
    known = df.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return train(sample_rows(known, "doc_id", "text", "lang", rows))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fitted(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
