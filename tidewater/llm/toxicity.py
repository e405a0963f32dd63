"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of itself and its byte 3- to 6-grams, a segment the average of
``SEGMENT`` words of the text in a row, and a linear softmax on that average says how toxic the
segment is. Embeddings and softmax start from noise and are trained jointly in numpy, so a spelling
that never occurred shares the vectors of its character n-grams. Labels are
per document; training first gives every segment its document's label, then
keeps, of toxic documents, only the segments that stand out against clean ones.

A document's score comes from the margins of its ``TOP`` most toxic segments,
calibrated by a logistic curve on labelled documents that training did not see,
weighted to the class shares of the label table. Every segment of the whole
text is looked at.

The fit uses a bounded sample: at most ``MAX_PER_CLASS`` labelled documents of
each class (in a hash order), of at most ``MAX_CHARS`` characters each, and takes
equal segments of a document once. It runs in one task, so the driver sees no text
and a lost executor repeats it. Scoring is linear in a word's n-grams: each
distinct word of a slice of texts is one number, and a worker remembers nothing.

Defined cases: null or blank text has no segment and gets the score of a typical
clean document; without labels of both classes every score is the share
of toxic labels (0.0 without labels); a null doc_id is not held out; of several
texts under one id the fit takes one, by its hash; a very long text is a slice of
its own; repeated rows are scored alike; other columns are never read.
"""

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import boxed, materialise, read, release, schema, ship, unboxed
from tidewater.llm.tokens import forget, slices

SEGMENT = 4
LEAST_WORDS = 4
TOP = 3
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 16
DIM = 8
MAX_PER_CLASS = 2500
MAX_CHARS = 40_000
#: Training rounds; each takes as many hard and as many other clean segments at most.
ROUNDS = 4
LEADERS = 2
CLEAN_SEGMENTS = 20_000
CALIBRATION_SHARE = 4  # one labelled document in so many calibrates
WORDS_AT_ONCE = 5_000  # distinct words whose n-grams are spelt out at a time
SEGMENTS_AT_ONCE = 50_000  # segments whose margins are found at a time
FIRST_EPOCHS, RATE = 3, 0.5
SCORE = "__tw_score"
THRESHOLD = 0.3
EDGES = ".,;:!?#$%&*|<>\"'()[]{}-_"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the word each belongs to."""
    bare = [f"<{w.strip(EDGES) or w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"\n".join(bare) + b"\n", np.uint8)
    breaks = np.cumsum(data == 10)
    wide = data.astype(np.uint64)
    # The whole word is one of its n-grams.
    ids = [np.fromiter(map(zlib.crc32, bare), np.int64, len(bare)) % BUCKETS]
    owners = [np.arange(len(bare))]
    for n in GRAMS:
        if len(data) <= n:
            continue
        m = len(data) - n + 1
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ wide[i : i + m]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        owner = np.concatenate([[0], breaks])[:m]
        inside = breaks[n - 1 : n - 1 + m] == owner
        ids.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[inside])
    return np.concatenate(ids), np.concatenate(owners)


class Words:
    """The words of whole texts, in order, as often as they occur: distinct words, their numbers, and words per text."""

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        real = pc.binary_length(flat).to_numpy() > 0
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.numbers = coded.indices.to_numpy()
        self.counts = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each segment of ``SEGMENT`` words begins, its number of words and its text."""
        parts = -(-self.counts // SEGMENT)
        owner = np.repeat(np.arange(len(parts)), parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(self.counts) - self.counts, parts) + SEGMENT * place
        return begin, np.minimum(SEGMENT, self.counts[owner] - SEGMENT * place), owner


def as_texts(texts) -> pa.Array:
    return pa.array(texts, pa.string())


@dataclass
class Model:
    """Per-bucket margins and what turns a margin into a probability."""

    margins: np.ndarray | None
    bias: float
    slopes: np.ndarray | None
    shift: float
    prior: float
    floor: tuple[float, ...] = (0.0,) * TOP

    def word_margins(self, words: list[str]) -> np.ndarray:
        """The mean margin of a word's n-grams, for each word."""
        out = [np.zeros(0)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            ids, owners = gram_ids(words[at : at + WORDS_AT_ONCE])
            n = min(WORDS_AT_ONCE, len(words) - at)
            out.append(np.bincount(owners, self.margins[ids], n) / np.maximum(np.bincount(owners, minlength=n), 1))
        return np.concatenate(out)

    def tops(self, texts: pa.Array) -> np.ndarray:
        """The margins of each text's ``TOP`` most toxic segments; missing ones count as a clean document's."""
        words = Words(texts)
        out = np.tile(np.array(self.floor), (len(texts), 1))
        begin, sizes, owner = words.segments()
        if len(begin):
            values = self.word_margins(words.distinct)[words.numbers]
            margins = np.add.reduceat(values, begin) / np.maximum(sizes, LEAST_WORDS) + self.bias
            order = np.lexsort((-margins, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner, owner)  # ``owner`` is ascending
            best = rank < TOP
            out[owner[best], rank[best]] = margins[order][best]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.margins is None:
            return np.full(len(texts), self.prior)
        tops = [self.tops(texts.slice(a, b - a)) for a, b in slices(texts)]
        z = np.concatenate([np.zeros((0, TOP)), *tops]) @ self.slopes + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sums(values: np.ndarray, picked: np.ndarray, at: np.ndarray, at_once: int) -> np.ndarray:
    """The sum of ``values[picked]`` between each two neighbours of ``at``; so many sums are spelt out at a time."""
    out = [np.zeros(0, values.dtype)]
    for k in range(0, len(at) - 1, at_once):
        ends = at[k : k + at_once + 1]
        out.append(np.add.reduceat(values[picked[ends[0] : ends[-1]]], ends[:-1] - ends[0]))
    return np.concatenate(out)


class _Bags:
    """Segments as word numbers, words as n-gram buckets; only a batch is ever spelt out."""

    def __init__(self, vocabulary: list[str], words: np.ndarray, sizes: np.ndarray):
        grams, counts = [], []
        for k in range(0, len(vocabulary), WORDS_AT_ONCE):
            ids, owners = gram_ids(vocabulary[k : k + WORDS_AT_ONCE])
            grams.append(ids[np.argsort(owners, kind="stable")].astype(np.int32))
            counts.append(np.bincount(owners, minlength=min(WORDS_AT_ONCE, len(vocabulary) - k)))
        self.grams = np.concatenate(grams)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.sizes, self.words = sizes, words
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.n = len(sizes)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of these words, and each one's place in ``words``."""
        counts = self.at[words + 1] - self.at[words]
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return self.grams[self.at[words][owner] + inner], owner

    def margins(self, table: np.ndarray, soft: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Every segment's margin."""
        u = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        per_word = _sums(u, self.grams, self.at, WORDS_AT_ONCE) / np.diff(self.at)
        return _sums(per_word, self.words, self.begin, SEGMENTS_AT_ONCE) / np.maximum(self.sizes, LEAST_WORDS) + (bias[1] - bias[0])


def _train(bags: _Bags, pick: np.ndarray, labels: np.ndarray, state, rng, epochs: int, rate: float):
    """Joint AdaGrad steps on embeddings and softmax over the segments in ``pick``."""
    table, soft, bias, memory = state
    for _ in range(epochs):
        order = rng.permutation(pick)
        for at in range(0, len(order), 2048):
            batch = order[at : at + 2048]
            sizes = bags.sizes[batch]
            seg = np.repeat(np.arange(len(batch)), sizes)
            place = np.repeat(bags.begin[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            words, which = np.unique(bags.words[place], return_inverse=True)
            grams, owner = bags.grams_of(words)
            per = np.bincount(owner, minlength=len(words)).astype(float)
            share = 1.0 / np.maximum(sizes, LEAST_WORDS)[seg]
            vectors = np.stack([np.bincount(owner, table[grams, d], len(words)) for d in range(DIM)], 1) / per[:, None]
            bag = np.stack([np.bincount(seg, share * vectors[which, d], len(batch)) for d in range(DIM)], 1)
            logits = bag @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            back = p @ soft.T
            of_word = np.stack([np.bincount(which, share * back[seg, d], len(words)) for d in range(DIM)], 1) / per[:, None]
            used, where = np.unique(grams, return_inverse=True)
            grad = np.stack([np.bincount(where, of_word[owner, d], len(used)) for d in range(DIM)], 1)
            memory[0][used] += (grad**2).sum(1)
            table[used] -= rate * grad / np.sqrt(memory[0][used] + 1e-10)[:, None]
            step = bag.T @ p
            memory[1] += step**2
            soft -= 0.1 * rate * step / np.sqrt(memory[1] + 1e-10)
            bias -= 0.1 * rate * p.sum(0)
    return table, soft, bias, memory


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps with a small ridge; no slope is negative."""
    use = list(range(z.shape[1]))
    while True:
        center, spread = z[:, use].mean(0), z[:, use].std(0) + 1e-9
        x = np.concatenate([(z[:, use] - center) / spread, np.ones((len(z), 1))], 1)
        beta = np.zeros(x.shape[1])
        ridge = np.diag([1.0] * len(use) + [1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (weight * (p - y)) + ridge @ beta
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(h, g)
            beta -= step
            if abs(step).max() < 1e-8:
                break
        worst = int(np.argmin(beta[:-1]))
        if beta[worst] >= 0 or len(use) == 1:
            slopes = np.zeros(z.shape[1])
            slopes[use] = np.maximum(beta[:-1], 1e-6) / spread
            return slopes, float(beta[-1] - (slopes[use] * center).sum())
        del use[worst]


def _distinct_segments(words: Words, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, sizes and texts of the segments of the texts to ``use``; equal segments of a text count once."""
    begin, sizes, owner = words.segments()
    own = use[owner]
    begin, sizes, owner = begin[own], sizes[own], owner[own]
    rows = np.full((len(begin), 1 + SEGMENT), -1, np.int32)
    rows[:, 0] = owner
    for k in range(SEGMENT):
        there = sizes > k
        rows[there, 1 + k] = words.numbers[begin[there] + k]
    rows = np.unique(rows, axis=0)
    inside = rows[:, 1:]
    return inside[inside >= 0], (inside >= 0).sum(1), rows[:, 0]


def fit(texts: list[str], labels: list[int], prior: float, seed: int = 7) -> Model:
    """Train on texts with labels 0/1; ``prior`` is the share of label 1 in the whole label table."""
    y = np.asarray(labels, np.int64)
    nothing = Model(None, 0.0, None, 0.0, prior)
    if len(set(labels)) < 2:
        return nothing
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % CALIBRATION_SHARE == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(texts), bool)

    column = as_texts(texts)
    words = Words(column)
    numbers, sizes, seg_doc = _distinct_segments(words, ~held)
    seg_label = y[seg_doc]
    clean = np.flatnonzero(seg_label == 0)
    if not len(clean) or len(clean) == len(seg_label):
        return nothing
    vocabulary = words.distinct
    del words
    release()  # else each step runs beside what the one before has freed
    bags = _Bags(vocabulary, numbers, sizes)
    del vocabulary
    release()
    # From noise: embeddings and softmax learn everything together.
    table = rng.normal(0, 0.05, (BUCKETS, DIM))
    soft = rng.normal(0, 0.5, (DIM, 2))
    state = (table, soft, np.zeros(2), [np.zeros(BUCKETS), np.zeros((DIM, 2))])
    n = len(seg_label)
    for k in range(ROUNDS):
        chosen = np.zeros(n, bool)
        if k == 0:
            chosen[seg_label == 1] = True
            chosen[rng.choice(clean, min(len(clean), 2 * CLEAN_SEGMENTS), replace=False)] = True
        else:  # of toxic documents, what stands out against clean ones or leads its document
            z = bags.margins(*state[:3])
            bar = np.quantile(z[clean], 0.998)
            order = np.lexsort((-z, seg_doc))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n) - np.searchsorted(seg_doc, seg_doc)  # ``seg_doc`` is ascending
            chosen[(seg_label == 1) & ((z > bar) | (rank < LEADERS))] = True
            chosen[clean[np.argsort(-z[clean], kind="stable")[:CLEAN_SEGMENTS]]] = True
            chosen[rng.choice(clean, min(len(clean), CLEAN_SEGMENTS), replace=False)] = True
        state = _train(bags, np.flatnonzero(chosen), seg_label, state, rng, FIRST_EPOCHS if k == 0 else 1, RATE)
    table, soft, bias, _ = state
    model = Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), None, 0.0, prior)
    del bags
    proof = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    z = model.tops(column.take(pa.array(proof)))
    yy = y[proof].astype(float)
    full = z[(yy == 0) & (z[:, -1] != model.floor[-1])]
    if len(full):
        model.floor = tuple(np.median(full, 0).tolist())
        z = model.tops(column.take(pa.array(proof)))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(yy == 1, prior / max(yy.mean(), 1e-9), (1 - prior) / max(1 - yy.mean(), 1e-9))
    model.slopes, model.shift = _calibrate(z, yy, weight)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled, not held-out documents."""
    sample, prior = labelled_sample(docs, labels, per_class)
    return _fitted(materialise(sample, "toxicity-sample"), prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> tuple[DataFrame, float]:
    """``doc_id, toxic, text`` of at most ``per_class`` documents of each class, and the share of label 1 among all labels."""
    known = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), "toxic").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    mixed = F.xxhash64("__id", F.lit(11))
    sample = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(mixed, "__id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= MAX_CHARS)
    # The sample has a fixed number of ids at most, and each gives one text: of an id's several texts that with the least hash.
    met = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "toxic")
    return met.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), prior


def fitted_rows(parts: Iterator[pa.RecordBatch], prior: float) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows; the worker gives up the vocabulary of an earlier task."""
    forget()
    release()
    rows = [r for batch in parts for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    rows.sort(key=lambda r: ((r[0] * 2654435761) % 2**32, r[0], r[1]))
    made = pickle.dumps(astuple(fit([r[2] for r in rows], [r[1] for r in rows], prior)))
    del rows
    release()
    yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["model"])


def _fitted(sample: DataFrame, prior: float) -> Model:
    """The model of the rows ``doc_id, toxic, text``, trained in one task that reads them all."""
    ship(sample.sparkSession)

    made = sample.select("doc_id", "toxic", "text").coalesce(1).mapInArrow(lambda parts: fitted_rows(parts, prior), schema("model binary")).first()
    return Model(None, 0.0, None, 0.0, prior) if made is None else Model(*pickle.loads(made[0]))


def scored(model: Model, parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The scores of columns of texts; the worker gives up the vocabulary of an earlier task and what each column frees."""
    forget()
    for texts in parts:
        yield pa.array(model.scores(texts), pa.float64())
        del texts
        release(collect=False)


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score``: one row per input row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.margins, model.bias, model.slopes, model.shift, model.prior, model.floor))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return scored(Model(*shared.value), parts)

    score = F.arrow_udf(run, "double")
    return docs.select(*[F.col(f"`{c}`") for c in keep], score(F.coalesce("text", F.lit(""))).alias(SCORE))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, training: DataFrame | None = None) -> DataFrame:
    """The documents whose score is below ``threshold``, with their columns.

    ``training`` has the labelled texts, if ``docs`` hasn't.
    """
    model = fit_toxicity(docs if training is None else training, labels)
    scored = score_toxicity(boxed(docs, "text"), model, ("__tw_doc",))
    return unboxed(scored.where(F.col(SCORE) < threshold))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
    score = F.col(SCORE)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
