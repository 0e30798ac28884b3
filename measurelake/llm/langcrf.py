"""Language identification by a linear-chain conditional random field over words.

Each word has features: its first and last one to three letters, its letter trigrams, the word itself, and the
languages of whose lexicon (words found almost only there in the sample) it is part. Transition weights are
learned along with them, on lines of one language and on code-switched lines spliced from several, so labels keep
to a language and change where the words do. Forward-backward gives each word's label probabilities; a text's
language is the one with the largest sum.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import unused

#: Texts that are learned from, over all languages, EACH of a language at least; chosen by hash of the id. Of a longer
#: text than LONGEST characters, PIECES pieces are learned from that lie evenly over all of it.
SAMPLE, EACH, LONGEST, PIECES = 1600, 8, 200_000, 20
BUCKETS = 1 << 16
#: Words of a sequence; longer texts are several.
STEPS = 256
CACHE = 150_000
NONE = "und"
SEED = 5

_find = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _find(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    w = f"^{word}$"
    own = [f"p{word[:i]}" for i in range(1, 1 + min(3, len(word)))] + [f"s{word[-i:]}" for i in range(1, 1 + min(3, len(word)))] + [f"w{word}"] + [f"g{w[i : i + 3]}" for i in range(len(w) - 2)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in own]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    #: Numbers of the languages whose lexicon holds the word; they are features behind the hashed ones.
    lexicon: dict[str, tuple[int, ...]]
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def index(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [features(w) + [BUCKETS + i for i in self.lexicon.get(w, ())] for w in vocabulary]
        return np.array([i for x in lists for i in x], np.int64), np.cumsum([0, *map(len, lists)])

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        idx, starts = self.index(vocabulary)
        return np.add.reduceat(self.weights[idx], starts[:-1], axis=0) if len(idx) else np.zeros((0, len(self.languages)))

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the table for the words of each text; -1 for what holds no letter. The table is bounded."""
        if len(self.rows) > CACHE:
            self.rows, self.table = {}, None
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.rows))
        good = [w for w in new if any(map(str.isalpha, w))]
        at = 0 if self.table is None else len(self.table)
        self.rows.update((w, -1) for w in new)
        self.rows.update((w, at + i) for i, w in enumerate(good))
        made = np.vstack([self.emissions(good[i : i + 4096]) for i in range(0, len(good), 4096)] or [np.zeros((0, len(self.languages)))])
        self.table = made if self.table is None else np.vstack([self.table, made])
        get = self.rows.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]


def marginals(emit: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences (n, steps, labels): label probabilities, and expected transitions."""
    n, steps, k = emit.shape
    live = np.arange(steps) < sizes[:, None]
    e = np.where(live[:, :, None], np.exp(emit - emit.max(axis=2, keepdims=True)), 1.0)
    move = np.exp(transition - transition.max())
    ahead = np.empty_like(e)
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = a
    for t in range(1, steps):
        a = (a @ move) * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        ahead[:, t] = a
    b = np.ones((n, k))
    out = np.empty_like(e)
    out[:, -1] = ahead[:, -1]
    pairs = np.zeros((k, k))
    for t in range(steps - 1, 0, -1):
        # behind its end a sequence brings nothing back
        c = np.where(live[:, t, None], e[:, t] * b, 1.0)
        joint = ahead[:, t - 1, :, None] * move * c[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[live[:, t]].sum(axis=0)
        b = np.where(live[:, t, None], c @ move.T, 1.0)
        b /= b.sum(axis=1, keepdims=True)
        out[:, t - 1] = ahead[:, t - 1] * b
    out /= out.sum(axis=2, keepdims=True)
    return out * live[:, :, None], pairs


def _smoothed(emit: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Label probabilities alone, for prediction."""
    steps = emit.shape[1]
    live = np.arange(steps) < sizes[:, None]
    e = np.where(live[:, :, None], np.exp(emit - emit.max(axis=2, keepdims=True)), 1.0)
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    ahead = np.empty_like(e)
    a = e[0] / e[0].sum(axis=1, keepdims=True)
    ahead[0] = a
    for t in range(1, steps):
        a = (a @ move) * e[t]
        a /= a.sum(axis=1, keepdims=True)
        ahead[t] = a
    b = np.ones_like(a)
    for t in range(steps - 1, 0, -1):
        b = np.where(live[:, t, None], (e[t] * b) @ move.T, 1.0)
        b /= b.max(axis=1, keepdims=True)
        ahead[t - 1] *= b
    ahead /= ahead.sum(axis=2, keepdims=True)
    return ahead.transpose(1, 0, 2) * live[:, :, None]


def learn(samples: list[tuple[str, str]], epochs: int = 3, batch: int = 128) -> Model | None:
    """A model of (text, language); None without a word."""
    draw = np.random.default_rng(SEED)
    languages = sorted({x for _, x in samples})
    number = {x: i for i, x in enumerate(languages)}
    lines: list[tuple[list[str], int]] = []
    counts: dict[str, Counter[int]] = defaultdict(Counter)
    for text, language in sorted(samples):
        own = [w for w in words(text) if any(map(str.isalpha, w))]
        for w in own:
            counts[w][number[language]] += 1
        lines += [(own[i : i + 48], number[language]) for i in range(0, len(own), 48)]
    if not lines:
        return None
    lexicon = {w: tuple(i for i, n in c.items() if n >= 0.9 * c.total()) for w, c in counts.items() if c.total() >= 8}
    model = Model(languages, np.zeros((BUCKETS + len(languages), len(languages))), np.zeros((len(languages),) * 2), lexicon)
    k = len(languages)
    at = {w: i for i, w in enumerate(counts)}
    idx, starts = model.index(list(counts))
    sizes_of = np.diff(starts)
    seen, seen_t = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6)
    plain = [(np.array([at[w] for w in ws]), np.full(len(ws), y)) for ws, y in lines]
    for _ in range(epochs):
        order = draw.permutation(len(plain))
        spliced = []
        for i in order[: len(order) // 3]:  # code-switched: pieces of lines, one after the other
            pick = [i, *draw.integers(0, len(plain), 2)]
            cut = [(int(draw.integers(0, max(1, len(plain[j][0]) - 3))), int(draw.integers(3, 17))) for j in pick]
            spliced.append(tuple(np.concatenate([plain[j][c][a : a + m] for j, (a, m) in zip(pick, cut, strict=True)]) for c in (0, 1)))
        todo = [plain[i] for i in order] + spliced
        todo = [todo[i] for i in draw.permutation(len(todo))]
        for first in range(0, len(todo), batch):
            own = todo[first : first + batch]
            sizes = np.array([len(x) for x, _ in own])
            steps = int(sizes.max())
            pad = np.zeros((len(own), steps), np.int64)
            gold = np.zeros((len(own), steps), np.int64)
            for r, (x, y) in enumerate(own):
                pad[r, : len(x)], gold[r, : len(y)] = x, y
            used, place = np.unique(pad, return_inverse=True)
            place = place.reshape(pad.shape)
            flat = np.concatenate([idx[starts[u] : starts[u + 1]] for u in used])
            bounds = np.concatenate([[0], np.cumsum(sizes_of[used])[:-1]])
            emit = np.add.reduceat(model.weights[flat], bounds, axis=0)
            p, pairs = marginals(emit[place], model.transition, sizes)
            live = np.arange(steps) < sizes[:, None]
            p[live, gold[live]] -= 1.0
            g = np.zeros((len(used), k))
            np.add.at(g, place[live], p[live])
            real = np.zeros((k, k))
            both = live[:, 1:]
            np.add.at(real, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            spread = np.repeat(g, sizes_of[used], axis=0)
            touched, inverse = np.unique(flat, return_inverse=True)
            d = np.stack([np.bincount(inverse, spread[:, j], len(touched)) for j in range(k)], axis=1) / len(own) + 1e-5 * model.weights[touched]
            seen[touched] += d * d
            model.weights[touched] -= 0.2 * d / np.sqrt(seen[touched])
            d = (pairs - real) / len(own) + 1e-5 * model.transition
            seen_t += d * d
            model.transition -= 0.2 * d / np.sqrt(seen_t)
    model.weights = model.weights.astype(np.float32)
    return model


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """A model of the rows of `df` with text and language: SAMPLE texts in expectation, as many of each language.

    Every language is learned, from EACH texts at least if it has them. None if no row has text and language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).count().orderBy("lang").collect()  # one row for each language
    if not counts:
        return None
    share = {r["lang"]: min(1.0, max(EACH, SAMPLE // len(counts)) / r["count"]) for r in counts}
    grain = 1 << 30
    cut = F.create_map(*(x for k, v in share.items() for x in (F.lit(k), F.lit(math.ceil(grain * v)))))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(SEED), F.col(doc_id)), F.lit(grain)) < F.try_element_at(cut, F.col(lang))).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", (i * F.length("text") / PIECES + 1).cast("int"), F.lit(LONGEST // PIECES))), "\n")
    picked = picked.withColumn("text", F.when(F.length("text") <= LONGEST, F.col("text")).otherwise(long))
    return learn([(r["text"], r["lang"]) for r in picked.toLocalIterator()])


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), labels: bool = False, block: int = 256) -> DataFrame:
    """`keep`, lang_pred and score of each whole text; with `labels` also `word_langs`, the label of each word in order.

    Score: the mean probability of the language over the words. Null texts, texts without a letter, and all texts if
    there is no model, are `und` with score 0. Words are runs of letters, lower-cased; a sequence of the chain has
    STEPS words at most, and a text any number of sequences. Map only; rows that repeat get equal results, an empty
    table gives an empty one, other columns are not read.
    """
    keep = tuple(keep)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double", *["word_langs array<string>"] * labels])
    if model is not None:
        model.rows, model.table = {}, None
    packed = None if model is None else (model.languages, model.weights, model.transition, model.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if packed is None else Model(*packed)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                made = _predicted(own, [x.as_py() for x in batch.column(len(keep))], labels)
                arrays = [*(batch.column(i) for i in range(len(keep))), pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), *([pa.array(made[2], pa.list_(pa.string()))] if labels else [])]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", *["word_langs"] * labels])

    return df.select(*keep, F.col(text).alias(unused(df, "__text"))).mapInArrow(run, schema)


def _predicted(model: Model | None, texts: list[str | None], labels: bool = False) -> tuple[list[str], list[float], list[list[str]]]:
    n = len(texts)
    names, scores, each = [NONE] * n, [0.0] * n, [[] for _ in range(n)]
    if model is None:
        return names, scores, each
    k = len(model.languages)
    rows = [r[r >= 0] for r in model.lookup([words(t) for t in texts])]
    sums = np.zeros((n, k))
    parts = [(i, r[a : a + STEPS]) for i, r in enumerate(rows) for a in range(0, len(r), STEPS)]
    move = np.exp(model.transition - model.transition.max())
    by_size = sorted(range(len(parts)), key=lambda j: len(parts[j][1]))
    found: dict[int, np.ndarray] = {}
    for first in range(0, len(by_size), 512):
        own = by_size[first : first + 512]
        sizes = np.array([len(parts[j][1]) for j in own])
        emit = np.zeros((len(own), int(sizes.max()), k))
        for r, j in enumerate(own):
            emit[r, : sizes[r]] = model.table[parts[j][1]]
        p = _smoothed(emit, move, sizes)
        np.add.at(sums, [parts[j][0] for j in own], p.sum(axis=1))
        if labels:
            found.update((j, p[r, : sizes[r]].argmax(axis=1)) for r, j in enumerate(own))
    for i, r in enumerate(rows):
        if len(r):
            best = int(sums[i].argmax())
            names[i], scores[i] = model.languages[best], min(1.0, float(sums[i, best]) / len(r))
    for j in sorted(found):
        each[parts[j][0]] += [model.languages[x] for x in found[j]]
    return names, scores, each
