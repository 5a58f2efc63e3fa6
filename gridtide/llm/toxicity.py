"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on toxic text (the words that toxic training
texts use in many more contexts than ordinary ones) and one on ordinary text.  Both stand
on the same ordinary base, so that ordinary text costs the same either way.  A text is cut
into windows of a few words; each window is compressed with either dictionary, and the
difference in bytes says how much better the toxic one knows it.  The histogram of these
differences over all windows of a text goes through a logistic calibration.

What is bounded: the dictionaries learn from at most ``per_class`` labelled rows of each
class and the calibration from at most ``calibration`` labelled rows, chosen by a hash of
their id.  The calibration measures whole texts, in tasks.  The driver gets the texts of
the first whole as long as they have ``train_bytes`` together; beyond that the longest are
thinned to runs of words from all their parts.  Of ordinary text the dictionary trainer
takes lines drawn from all parts of all texts, ``LINE_BYTES`` together.  Scoring reads every
window of every text, where the row lies, without a shuffle; the model that is broadcast
has a fixed size (about 40 KB).  A task remembers the differences of ``CACHE`` windows: it
numbers up to about ``WORDS`` words, and the numbers of a window's words are its key, so
that no two windows are taken for each other.

Defined cases: NULL text is empty; texts without words get the calibrated score of no
windows; labels that are NULL, or whose document or text is missing, teach nothing; with
labelled rows of one class only (or none) the score is the smoothed share of toxic ones
for every text, a third without any; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridtide.llm.batches import values

WINDOW = 3  # words of a window where a caller names no other; ``train`` takes two
CACHE = 1 << 20  # windows whose difference a task remembers, 10 bytes each
WORDS = 1 << 18  # words that a task numbers before it starts anew
CHUNK = 4_096  # windows looked up, and compressed, at a time
BASE_BYTES, OWN_BYTES = 16_384, 2_048
RUN = 200  # words of a line of ordinary text, and of a run of a thinned text
LINE_BYTES = 4_000_000  # of ordinary lines that the dictionary trainer takes
STEPS = (1, 2, 3, 4, 5, 6, 8, 10)  # bytes saved by the toxic dictionary
LOSSES = (1, 2, 4, 6)
#: Every window starts with it, and so do both dictionaries: a block always compresses.
ANCHOR = bytes(range(128, 168))
#: ASCII letters in lower case, bytes of other letters kept, the rest a space.
FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _stems(word: bytes) -> Iterator[bytes]:
    """The word, ended by a space, and its beginnings."""
    yield word + b" "
    for n in range(4, min(8, len(word))):
        yield word[:n]


def _contexts(texts: Iterable[list[bytes]]) -> Counter:
    """In how many different places, told apart by the word before, each stem stands.
    Copies of a text add nothing."""
    seen = set()
    for words in texts:
        seen.update(zip([b"", *words], words))
    return Counter(s for _, w in seen for s in _stems(w))


def _telling(bad: Counter, good: Counter, ratio: float, evidence: float) -> set[bytes]:
    """Stems at least ``ratio`` times as frequent in the first as in the second, and too
    often so for chance (likelihood ratio of the two counts, in nats)."""
    q = sum(bad.values()) / (sum(bad.values()) + sum(good.values()))
    found = {}
    for stem, n in bad.items():
        g = good[stem]
        if n * (1 - q) > ratio * (g + 1) * q:
            found[stem] = n * np.log(n / (n + g) / q) + (g * np.log(g / (n + g) / (1 - q)) if g else 0)
    return {s for s, x in found.items() if x > evidence} or set(sorted(found, key=found.get)[-20:])


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary's bytes; too little text to train on is taken as it is."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _lines(texts: list[list[bytes]], size: int | None = None) -> list[bytes]:
    """Runs of words of all parts of all texts; beyond ``size`` bytes a random choice of them."""
    size = LINE_BYTES if size is None else size
    lines = [b" " + b" ".join(w[i : i + RUN]) + b" " for w in texts for i in range(0, max(len(w), 1), RUN)]
    random.Random(1).shuffle(lines)
    total = 0
    for n, line in enumerate(lines):
        total += len(line)
        if total > size and n:
            return lines[:n]
    return lines


def thinned(text: bytes, size: int) -> bytes:
    """The text, or about ``size`` bytes of it in runs of words spread evenly over it."""
    if len(text) <= size:
        return text
    words = text.split()
    runs = [b" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
    n = max(1, len(runs) * size // len(text))
    return b"\n".join(runs[(2 * i + 1) * len(runs) // (2 * n)] for i in range(n))


def _bound(lengths: list[int], total: int) -> int:
    """The largest length such that texts cut to it have at most ``total`` together."""
    left = total
    for i, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - i) > left:
            return left // (len(lengths) - i)
        left -= n
    return max(lengths, default=0)


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes
    window: int = WINDOW

    @classmethod
    def train(
        cls, toxic: list[bytes], ordinary: list[bytes], ratio: float = 3, evidence: float = 15, window: int = WINDOW
    ) -> Dictionaries:
        bad, good = [words_of(t) for t in toxic], [words_of(t) for t in ordinary]
        chosen = _telling(_contexts(bad), _contexts(good), ratio, evidence)
        samples = [b" " + w + b" " for words in bad for w in words if not chosen.isdisjoint(_stems(w))]
        random.Random(1).shuffle(samples)
        lines = _lines(good)
        half = (len(lines) + 1) // 2
        base = _dictionary(lines[:half], BASE_BYTES, 64)
        return cls(
            base + _dictionary(lines[half:] or lines, OWN_BYTES, 24) + ANCHOR,
            base + _dictionary([s * 3 for s in samples], OWN_BYTES, 20) + ANCHOR,
            window,
        )

    def differences(self) -> DifferenceCounter:
        return DifferenceCounter(_compressor(self.ordinary), _compressor(self.toxic), self.window)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_BTULTRA, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=known)


class Numbers(dict):
    """A number for each word, given when it is first asked for; 0 for none."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class DifferenceCounter:
    def __init__(self, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, window: int = WINDOW):
        self.ordinary, self.toxic = ordinary.multi_compress_to_buffer, toxic.multi_compress_to_buffer
        self.window = window
        self.bits = 63 // window  # of a word's number in a key; windows of over three words are not remembered
        self.numbers = Numbers()
        self.known = np.zeros(CACHE, dtype=np.uint64)  # the key that stands in each place, 0 for none
        self.saved = np.zeros(CACHE, dtype=np.int16)

    def _compressed(self, words: list[bytes], at: Iterable[int]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on the windows at these places."""
        size = self.window
        framed = [b"%b %b " % (ANCHOR, b" ".join(words[i * size : (i + 1) * size]).rstrip()) for i in at]
        if not framed:
            return np.zeros(0, dtype=np.int16)
        return np.array([len(a) - len(b) for a, b in zip(self.ordinary(framed), self.toxic(framed))], dtype=np.int16)

    def _keys(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) >= WORDS:
            self.numbers = Numbers()
            self.known[:] = 0
        own = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.uint64, count=len(words))
        keys = own[:: self.window].copy()
        for j in range(1, self.window):
            keys |= own[j :: self.window] << np.uint64(j * self.bits)
        return keys

    def _differences(self, words: list[bytes]) -> np.ndarray:
        """The same for all of at most ``CHUNK`` windows."""
        if self.bits < 21:
            return self._compressed(words, range(len(words) // self.window))
        keys = self._keys(words)
        places = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(len(self.known))
        saved, new = self.saved[places], np.flatnonzero(self.known[places] != keys)
        _, first, again = np.unique(keys[new], return_index=True, return_inverse=True)
        saved[new] = self._compressed(words, new[first].tolist())[again]
        # Keys that fall to one place in this chunk: both columns must get the same one of them.
        _, last = np.unique(places[new][::-1], return_index=True)
        new = new[::-1][last]
        self.known[places[new]], self.saved[places[new]] = keys[new], saved[new]
        return saved

    def _rows(self, words: list[bytes], windows: list[int]) -> np.ndarray:
        step = CHUNK * self.window
        found = [self._differences(words[i : i + step]) for i in range(0, len(words), step)]
        saved = np.concatenate(found) if found else np.zeros(0, dtype=np.int16)
        n, kinds = np.array(windows), LOSSES[-1] + STEPS[-1] + 1
        text = np.repeat(np.arange(len(n)), n)
        total = np.bincount(text, weights=saved, minlength=len(n))
        kind = np.clip(saved, -LOSSES[-1], STEPS[-1]) + LOSSES[-1]
        counts = np.bincount(text * kinds + kind, minlength=len(n) * kinds).reshape(len(n), kinds)
        at = [counts[:, LOSSES[-1] + k :].sum(axis=1) for k in STEPS] + [counts[:, : LOSSES[-1] - k + 1].sum(axis=1) for k in LOSSES]
        at, n = np.array(at, dtype=float).T, np.maximum(n, 1)
        return np.column_stack([np.log(n), total / n, at * 10 / n[:, None], np.log1p(at)])

    def features_of(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """For each text: windows, mean saving, and windows by saving, as shares and as
        logarithms.  Short texts are looked up together."""
        words: list[bytes] = []  # each text filled up with empty words to whole windows
        windows: list[int] = []
        for text in texts:
            own = words_of(text or b"")
            windows.append(-(-len(own) // self.window))
            words += own
            words += [b""] * (windows[-1] * self.window - len(own))
            if len(words) >= CHUNK * self.window:
                yield from self._rows(words, windows)
                words, windows = [], []
        if windows:
            yield from self._rows(words, windows)

    def features(self, text: bytes | None) -> np.ndarray:
        return next(self.features_of([text]))


FEATURES = 2 + 2 * (len(STEPS) + len(LOSSES))


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first is the constant

    def score(self, features: np.ndarray) -> float:
        z = self.weights[0] + ((features - self.mean) / self.scale) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _constant(toxic: int, ordinary: int) -> Model:
    """The share of toxic labels for every text; without any label, ordinary (a third)."""
    zero = np.zeros(FEATURES)
    return Model(None, zero, np.ones(FEATURES), np.concatenate([[np.log((toxic + 0.5) / (ordinary + 1))], zero]))


def _calibrate(dictionaries: Dictionaries, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton steps."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (labels - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(dictionaries, mean, scale, w)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _sample(labels: DataFrame, n: int) -> DataFrame:
    """At most n rows, by a hash of the id; the sort keeps n rows per task."""
    return labels.orderBy(F.xxhash64("id"), "id").limit(n)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 2_500, calibration: int = 6_000, train_bytes: int = 32_000_000, window: int = 2,
) -> Model:
    """Fit on labelled rows that are not held out."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(known["id"].isNotNull() & known["label"].isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("text is not null")

    def with_text(rows: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(rows), "id")  # a sample of bounded size

    classes = {k: _sample(known.where(F.col("label") == k), per_class) for k in (1, 0)}
    teaching = with_text(classes[1].unionByName(classes[0]))
    bound = _bound([r.n for r in teaching.select(F.octet_length("text").alias("n")).collect()], train_bytes)

    @arrow_udf("binary")
    def sent(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([thinned(t, bound) for t in values(b)], pa.binary())

    taught = teaching.select("id", "label", sent("text").alias("text")).orderBy("id", "text").collect()
    by_class = {k: [bytes(r.text) for r in taught if r.label == k] for k in (1, 0)}
    if not by_class[1] or not by_class[0]:
        return _constant(len(by_class[1]), len(by_class[0]))
    dictionaries = Dictionaries.train(by_class[1], by_class[0], window=window)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = shared.value.differences()
        for b in batches:
            yield pa.array(list(counter.features_of(values(b))), pa.list_(pa.float64()))

    fitted = with_text(_sample(known, calibration)).select("label", measured("text").alias("x")).collect()
    features, found = np.array([r.x for r in fitted]), np.array([r.label for r in fitted])
    if len(set(found.tolist())) < 2:
        return _constant(int(found.sum()), int((1 - found).sum()))
    return _calibrate(dictionaries, features, found)


def scored(docs: DataFrame, model: Model, text_col: str | Column = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic (0 to 1)."""
    text = F.col(f"`{text_col}`") if isinstance(text_col, str) else text_col
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        counter = model.dictionaries.differences() if model.dictionaries else None
        for b in batches:
            rows = counter.features_of(values(b)) if counter else [model.mean] * len(b)
            yield pa.array([model.score(x) for x in rows], pa.float64())

    columns = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
    return docs.select(*columns, score(text.cast("binary")).alias(score_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` that score under the threshold, with their own columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = scored(packed, train(docs, labels, text_col=text_col), F.col("row")[text_col]).where(F.col("score") < threshold)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
