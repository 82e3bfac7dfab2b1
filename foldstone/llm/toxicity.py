"""Toxicity (operator 2): support vector machine on a gappy subsequence kernel with Nystroem landmarks.

The kernel of two words is the gap-weighted count of their common subsequences of three letters, normalised, so inserted,
dropped and exchanged letters cost only some similarity. A text is compared with a landmark by the sum of the kernel values
of its words, by the square root of their number. Words are runs of letters between spaces with all other signs taken out
and their start as a letter of its own; runs of single letters count as a word, too, so spelled-out and dotted insults
are seen. So do two and three neighbouring words of a sentence with a short one among them, which finds insults with gaps
in them. Only words of one letter have no unit of their own. The landmarks are parts of words of the labelled texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.labelled import labelled_texts, remainder
from foldstone.llm.words import STEP, Words, mix, slices

PARTS, HELD_OUT = 3, 1
SAMPLE_PER_CLASS = 1000
SAMPLE_CHARS = 20_000
# Landmarks at most. Occurrences of a letter run in a document count up to CAP; the log-likelihood ratio of its counts in the
# two classes must exceed the logarithm of the number of runs by MARGIN, which no run is expected to do by chance.
LANDMARKS, CAP, MARGIN = 96, 5, 1.0
# A landmark serves so many documents of label 1 that have fewer than COVER landmarks; no two are more alike than this.
SUPPORT, COVER, ALIKE = 4, 12, 0.6
SLICES = 8  # of the letter runs that are counted at a time
PENALTY, SHRINK = 1e-3, 1e-5
SIZE_SCALE = 0.1
THRESHOLD = 0.7
# Folds of the calibration, and how many false alarms weigh as much as a missed text there.
FOLDS, MISSED = 4, 3

LETTERS = 34  # a-z, six kinds of bytes of other characters, and the start of a word
START = 33
SPAN = 6  # three letters lie within so many places
DECAY = 0.6  # for each place that a subsequence spans
NEAR = 0.33  # kernel values below count as zero
PIECE = 16  # longer words are compared in overlapping pieces
LEAST_NORM = (2 + 2 * DECAY**2) ** 0.5  # of four codes, such as the start and three letters; more have no less
SHORT, JOINED = 3, 12  # letters of a short word, and of neighbours that are read as one word, at most

CODES = np.full(256, 255, np.uint8)
CODES[97:123] = np.arange(1, 27)
CODES[65:91] = np.arange(1, 27)
CODES[0x80:0xC0] = 27 + np.arange(0x80, 0xC0) % 6  # the first byte of a character carries little
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


class Units:
    """Pieces of words as rows of letter codes; unit u belongs to sentence ``sentence[u]``, which is in text ``text_of[s]``."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        codes = CODES[words.data]
        is_letter = codes != 255
        self.letters = codes[is_letter]
        before = np.concatenate([[0], np.cumsum(is_letter)])
        begin, end = before[words.starts], before[words.ends]
        text = np.repeat(np.arange(len(words.counts)), words.counts)
        total = len(begin)
        lines = np.concatenate([[0], np.cumsum(words.data == 10)])
        stop = np.isin(words.data[words.ends - 1], np.frombuffer(b".!?", np.uint8)) if total else np.zeros(0, bool)
        breaks = np.ones(total, bool)
        if total:
            breaks[1:] = stop[:-1] | (text[1:] != text[:-1]) | (lines[words.starts[1:]] > lines[words.ends[:-1]])
        sentence = np.cumsum(breaks) - 1
        self.text_of = text[breaks]
        # Runs of at least three words of one letter each, within a sentence.
        single = end - begin == 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        spelled = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 3]
        if spelled:
            first, last = np.array(spelled).T
            begin, end = np.concatenate([begin, begin[first]]), np.concatenate([end, end[last - 1]])
            sentence = np.concatenate([sentence, sentence[first]])
        own = len(begin)
        # Two and three neighbouring words of a sentence that a gap may have made of one: two with a short one, or three short ones.
        short = (end[:total] - begin[:total] <= SHORT) & (end[:total] > begin[:total])
        written = end[:total] > begin[:total]
        for count in (2, 3):
            last = np.arange(count - 1, total)
            first = last - count + 1
            joins = (sentence[first] == sentence[last]) & (end[last] - begin[first] <= JOINED) & (end[last] - begin[first] > SHORT)
            if count == 2:
                joins &= (short[first] | short[last]) & written[first] & written[last]
            else:
                joins &= short[first] & short[first + 1] & short[last]
            begin, end, sentence = np.concatenate([begin, begin[first[joins]]]), np.concatenate([end, end[last[joins]]]), np.concatenate([sentence, sentence[first[joins]]])
        size = end - begin
        plain = np.arange(len(size)) < own
        long_enough = size >= 2
        begin, size, sentence, plain = begin[long_enough], size[long_enough], sentence[long_enough], plain[long_enough]
        room = PIECE - 1
        pieces = np.where(size > room, (size - room + 7) // 8 + 1, 1)
        owner = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        shift = np.minimum(nth * 8, np.maximum(size[owner] - room, 0))
        self.first = shift == 0
        self.begin, self.size, self.sentence, self.plain = begin[owner] + shift, np.minimum(size[owner], room), sentence[owner], plain[owner]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the distinct units, and which of them each unit is."""
        column = np.arange(PIECE - 1)
        at = np.minimum(self.begin[:, None] + column, max(len(self.letters) - 1, 0))
        rows = np.zeros((len(self.begin), PIECE), np.uint8)
        rows[:, 1:] = np.where(column < self.size[:, None], self.letters[at], 0) if len(self.letters) else 0
        rows[self.first, 0] = START
        rows[~self.first] = np.roll(rows[~self.first], -1, axis=1)
        key = rows.view(np.uint64)
        _, one, which = np.unique(mix(key[:, 0] * STEP + mix(key[:, 1])), return_index=True, return_inverse=True)
        by_size = np.argsort(self.size[one], kind="stable")  # neighbours of one size need the fewest columns
        position = np.empty(len(one), np.int64)
        position[by_size] = np.arange(len(one))
        return rows[one[by_size]], position[which.ravel()]


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences of three letters within the span (0 where there is none), and the weight of each column."""
    width = int(np.flatnonzero(rows.any(0)).max(initial=0)) + 1
    padded = np.zeros((len(rows), width + SPAN), np.int32)
    padded[:, :width] = rows[:, :width]
    pairs = [(padded[:, : width] * LETTERS + padded[:, i : i + width]) * LETTERS for i in range(SPAN - 1)]
    is_pair = [(padded[:, :width] > 0) & (padded[:, i : i + width] > 0) for i in range(SPAN - 1)]
    codes, weights = np.zeros((len(rows), len(GAPS) * width), np.int32), np.empty(len(GAPS) * width, np.float32)
    for k, (i, j) in enumerate(GAPS):
        part, last = slice(k * width, (k + 1) * width), padded[:, j : j + width]
        np.multiply(pairs[i] + last, is_pair[i] & (last > 0), out=codes[:, part])
        weights[part] = DECAY ** (j - 2)
    used = np.flatnonzero(codes.any(0))
    return np.ascontiguousarray(codes[:, used]), weights[used]


def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths of the feature vectors, equal subsequences taken together."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered = np.take_along_axis(codes, order, 1)
    heavy = np.where(ordered > 0, weights[order], 0).astype(np.float64)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    starts = np.flatnonzero(new.ravel())
    if not len(starts):
        return np.zeros(len(codes))
    sums = np.add.reduceat(heavy.ravel(), starts) ** 2
    return np.sqrt(np.bincount(starts // ordered.shape[1], weights=sums, minlength=len(codes)))


class Table:
    """The subsequences of some landmarks with their weights, by code."""

    def __init__(self, landmarks: np.ndarray):
        codes, weights = subsequences(landmarks)
        row, column = np.nonzero(codes)
        key, at = np.unique(codes[row, column].astype(np.int64) * len(landmarks) + row, return_inverse=True)
        weight = np.bincount(at.ravel(), weights[column], len(key))
        self.count, self.of = len(landmarks), key % max(1, len(landmarks))
        norm = np.sqrt(np.bincount(self.of, weight**2, len(landmarks)))
        self.entry = weight / np.maximum(norm, 1e-9)[self.of]
        self.bounds = np.searchsorted(key // max(1, len(landmarks)), np.arange(LETTERS**3 + 1))
        self.known = np.diff(self.bounds) > 0

    def vectors(self) -> np.ndarray:
        """The landmarks as explicit feature vectors of length one."""
        dense = np.zeros((self.count, LETTERS**3), np.float32)
        dense[self.of, np.repeat(np.arange(LETTERS**3), np.diff(self.bounds))] = self.entry
        return dense

    def near(self, rows: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, kernel value) of all pairs that are near."""
        found = []
        for begin in range(0, len(rows), step):
            part = rows[begin : begin + step]
            codes, weights = subsequences(part)
            row, column = np.nonzero(self.known[codes])
            code = codes[row, column]
            first = self.bounds[code]
            times = self.bounds[code + 1] - first
            at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pair = np.repeat(row, times) * self.count + self.of[at]
            sums = np.bincount(pair, self.entry[at] * np.repeat(weights[column], times), len(part) * self.count).reshape(len(part), self.count)
            # Most words are settled by the least norm that a word can have.
            least = NEAR * np.where(np.count_nonzero(part, axis=1) > 3, LEAST_NORM, 1.0)
            maybe = np.flatnonzero(sums.max(1, initial=0) >= least)
            if len(maybe):
                values = sums[maybe] / np.maximum(norms(codes[maybe], weights), 1e-9)[:, None]
                w, k = np.nonzero(values >= NEAR)
                found.append((maybe[w] + begin, k, values[w, k]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))


@dataclass
class Model:
    """Landmarks, the weight of each in the decision, the weight of a text's size, the offset, and the calibration."""

    landmarks: np.ndarray
    beta: np.ndarray
    size: float
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    table: Table = field(init=False, repr=False)

    def __post_init__(self):
        self.table = Table(self.landmarks)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.table = Table(self.landmarks)

    def scores(self, column: pa.Array) -> np.ndarray:
        units = Units(column)
        rows, which = units.distinct()
        word, landmark, value = self.table.near(rows)
        of_word = np.bincount(word, value * self.beta[landmark], len(rows))
        text = units.text_of[units.sentence]
        total = np.bincount(text, of_word[which], len(column))
        root = np.sqrt(np.maximum(np.bincount(text[units.plain], minlength=len(column)), 1))
        decision = total / root + self.size * SIZE_SCALE * root + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -40, 40)))


def _letter_runs(rows: np.ndarray, n: int) -> np.ndarray:
    """Codes of the runs of n letters, 0 where there is none."""
    a = rows.astype(np.int64)
    code = np.zeros((len(rows), PIECE - n + 1), np.int64)
    for k in range(n):
        code = code * LETTERS + a[:, k : PIECE - n + 1 + k]
    return np.where(a[:, n - 1 :] > 0, code, 0)


class Sample:
    """Units of the labelled texts: occurrences as (text, distinct unit), and how often each pair occurs."""

    def __init__(self, texts: list[str]):
        units = Units(pa.array(texts, pa.large_string()))
        self.rows, self.which = units.distinct()
        self.text, self.count = units.text_of[units.sentence], len(texts)
        self.words = np.bincount(self.text[units.plain], minlength=len(texts))
        pairs, self.times = np.unique(self.text[units.plain] * np.int64(len(self.rows)) + self.which[units.plain], return_counts=True)
        self.doc, self.unit = pairs // max(1, len(self.rows)), pairs % max(1, len(self.rows))

    def features(self, table: Table) -> np.ndarray:
        """Sums of kernel values with each landmark and the size, both by the root of the size, and a one."""
        word, landmark, value = table.near(self.rows)
        kernel = np.zeros((len(self.rows), table.count), np.float32)
        kernel[word, landmark] = value
        some = kernel.any(1)[self.which]
        sums = np.zeros((self.count, table.count))
        np.add.at(sums, self.text[some], kernel[self.which[some]])
        root = np.sqrt(np.maximum(self.words, 1))[:, None]
        return np.hstack([sums / root, SIZE_SCALE * root, np.ones((self.count, 1))])


def _contrasts(sample: Sample, y: np.ndarray, used: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log-likelihood ratio, letter run, its documents of label 1) of the runs that are significantly more in label 1."""
    found, looked_at = [], 1
    part = used[sample.doc]
    doc, unit, times = sample.doc[part], sample.unit[part], sample.times[part]
    share = times[y[doc] == 1].sum() / max(1, times.sum())
    for n in range(3, 11):
        codes = _letter_runs(sample.rows, n)
        if n == 3:  # whole words of two letters only
            codes[(sample.rows[:, 0] == START) & (sample.rows[:, 3] > 0)] *= np.arange(codes.shape[1]) > 0
        for s in range(SLICES):
            row, column = np.nonzero((codes > 0) & (codes % SLICES == s))
            flat, first, at = np.unique(codes[row, column], return_index=True, return_inverse=True)
            by_row = np.searchsorted(row, np.arange(len(codes) + 1))
            runs_of = by_row[unit + 1] - by_row[unit]
            place = np.repeat(by_row[unit] - (np.cumsum(runs_of) - runs_of), runs_of) + np.arange(runs_of.sum())
            pairs, inverse = np.unique(at.ravel()[place] * np.int64(len(y)) + np.repeat(doc, runs_of), return_inverse=True)
            capped = np.minimum(np.bincount(inverse.ravel(), np.repeat(times, runs_of), len(pairs)), CAP)
            number, owner = pairs // len(y), pairs % len(y)
            one = y[owner] == 1
            ones, zeros = np.bincount(number[one], capped[one], len(flat)), np.bincount(number[~one], capped[~one], len(flat))
            holders = np.bincount(number[one], minlength=len(flat))
            expected = np.maximum((ones + zeros) * share, 1e-9)
            rest = np.maximum(ones + zeros - expected, 1e-9)
            ratio = ones * np.log(np.maximum(ones, 1e-9) / expected) + np.where(zeros > 0, zeros * np.log(np.maximum(zeros, 1e-9) / rest), 0)
            bounds = np.searchsorted(number, np.arange(len(flat) + 1))
            looked_at += len(flat)
            for g in np.flatnonzero((ratio > np.log(looked_at) + MARGIN) & (ones > expected) & (holders >= SUPPORT)).tolist():
                w, k = row[first[g]], column[first[g]]
                of_run = owner[bounds[g] : bounds[g + 1]]
                found.append((float(ratio[g]), np.pad(sample.rows[w, k : k + n], (0, PIECE - n)), of_run[y[of_run] == 1]))
    return [f for f in found if f[0] > np.log(looked_at) + MARGIN]


def choose_landmarks(sample: Sample, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Letter runs by falling contrast, unlike each other, so that every document of label 1 has some of them."""
    candidates = sorted(_contrasts(sample, y, used), key=lambda c: (-c[0], c[1].tobytes()))
    lacking, chosen, vectors = np.where(y == 1, COVER, 0), [], np.zeros((LANDMARKS, LETTERS**3), np.float32)
    for _, run, holders in candidates:
        if len(chosen) >= LANDMARKS or (lacking[holders] > 0).sum() < SUPPORT:
            continue
        vector = Table(run[None]).vectors()[0]
        if not (vectors[: len(chosen)] @ vector > ALIKE).any():
            vectors[len(chosen)] = vector
            chosen.append(run)
            lacking[holders] -= 1
    return np.array(chosen, np.uint8).reshape(-1, PIECE)


def fit(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps over the rows that are short of the margin."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9  # the last column is the offset
    short = np.ones(len(x), bool)
    for _ in range(steps):
        part = x[short] * weight[short][:, None]
        w = np.linalg.solve(ridge + part.T @ x[short], part.T @ target[short])
        now = target * (x @ w) < 1
        if (now == short).all():
            break
        short = now
    return w


def learn(sample: Sample, y: np.ndarray, used: np.ndarray) -> tuple[Model, np.ndarray] | None:
    """The machine learnt from the used texts, and its decisions on all of them."""
    landmarks = choose_landmarks(sample, y, used)
    if not len(landmarks):
        return None
    table = Table(landmarks)
    vectors = table.vectors()
    values, basis = np.linalg.eigh((vectors @ vectors.T).astype(np.float64))
    whiten = basis / np.sqrt(np.maximum(values, 1e-2)) @ basis.T
    x = sample.features(table)
    x = np.hstack([x[:, :-2] @ whiten, x[:, -2:]])
    target = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, 1 / max(1, (y[used] == 1).sum()), 1 / max(1, (y[used] == 0).sum()))
    w = fit(x[used], target[used], weight[used], PENALTY)
    return Model(landmarks, whiten @ w[:-2], float(w[-2]), float(w[-1])), x @ w


def train(rows: list[tuple[str, int]], share: float) -> Model | None:
    """The machine of all rows, calibrated on decisions for rows that it was not learnt from."""
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    sample = Sample([text for text, _ in rows])
    learnt = learn(sample, y, np.ones(len(y), bool))
    if learnt is None:
        return None
    model, decisions = learnt
    nth = np.zeros(len(y), np.int64)
    for label in (0, 1):
        nth[y == label] = np.arange((y == label).sum())
    for fold in range(FOLDS):
        apart = learn(sample, y, nth % FOLDS != fold)
        if apart is not None:
            decisions = np.where(nth % FOLDS == fold, apart[1], decisions)
    weight = np.where(y == 1, MISSED * share / y.sum(), (1 - share) / (len(y) - y.sum()))
    model.slope, model.shift = _calibrated(decisions, y, weight)
    return model


def _calibrated(decision: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels to decisions, a little shrunk, by Newton's method."""
    x = np.stack([decision, np.ones(len(decision))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - SHRINK * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + SHRINK * np.eye(2)
        theta = theta + np.linalg.solve(hessian, gradient)
    return max(float(theta[0]), 1e-3), float(theta[1])


def _scored(model: Model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            arrays = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_arrays([*[a for c, a in arrays.items() if c != "text"], pa.array(model.scores(arrays["text"]), pa.float64())], [*[c for c in arrays if c != "text"], "score"])

    return of


def _fitted(share: float):
    def of(sample: pa.Table) -> pa.Table:
        model = train(list(zip(sample["text"].to_pylist(), sample["y"].to_pylist())), share)
        return pa.table({"model": pa.array([pickle.dumps(model)] if model else [], pa.binary())})

    return of


def trained(documents: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> tuple[Model | None, float]:
    """The model and the share of label 1. It is learnt in one task from the bounded sample; only the model reaches the driver."""
    sample, share = labelled_texts(documents, labels, "toxic", PARTS, HELD_OUT, per_class, max_chars)
    found = sample.orderBy("doc_id", "text").select("text", "y").groupBy().applyInArrow(_fitted(share), "model binary").collect()
    return (pickle.loads(found[0][0]) if found else None), share


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Trained on a bounded sample of labelled documents (``per_class``, ``max_chars``) whose crc32 remainder is not the
    held-out one; scored on whole texts only. ``predicted`` is 1 from a score of 0.7. Null and empty texts have the score of
    one word that resembles nothing. Without labels of both classes, or without letter runs that set them apart, every score is
    the share of label 1 that was seen. Repeated rows are scored alike, an empty table gives an empty result, and other
    columns are ignored.
    """
    model, share = trained(documents, labels, per_class, max_chars)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scored(model), "doc_id long, score double") if model else rows.select("doc_id", F.lit(float(share)).alias("score"))
    return scored.select("doc_id", (remainder(PARTS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; they pass through one scan without a shuffle."""
    model, share = trained(documents, labels, per_class, max_chars)
    if model is None:
        return documents if share < THRESHOLD else documents.where("false")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.scores(batch.column("text")) < THRESHOLD))

    return documents.mapInArrow(kept, documents.schema)
