"""Scoring texts by a hashed maximum-entropy language model.

Tokens are the words of a text, A-Z in lower case, and one end.  Words fall into classes by a hash of their last two
bytes; the end is a class of its own.  A token's probability is that of its class, given the classes of the two tokens
before it, times that of the word inside the class:

* class softmax: a bias, a row of weights for the class before, one for the class before that (a skip), and one for both
  together, in which the earlier class is hashed to ``PAIRS`` values;
* word softmax inside a class: a bias for each word and a weight for the class before with the word, hashed into
  ``CELLS`` cells for each word.  Every word with a share of at least ``COMMON`` of the training tokens (and ``LEAST``
  occurrences) is there; all others are one tail of their class, in which a word has its add-one relative frequency.

A softmax depends on its context only, so all training tokens are first counted by context and outcome, and gradient
steps (observed less expected, scaled by their logarithmic mean, each row held back by its own mass) run over these
counts.  Class counts are dealt by the class before: each of ``ROUNDS`` rounds is a job, in which tasks move the rows of
their own classes and the skip rows' sums are added up.  Words are dealt by class, and each class takes its steps by
itself.  Counts are whole numbers and every task's part is fixed, so scores don't depend on how texts are dealt to tasks.

What is gathered grows with the corpus: the number of classes (up to ``MOST_CLASSES``), the words that have a weight (up
to 1 / COMMON, which bounds the broadcasts to some 150 MB) and, without bound, the counts of all other words, which are joined.

Defined results: a null or empty text is the end token alone; repeated rows are scored and counted each; without
training texts the counts are 0, base scores are log10(1 / 1) and the model is uniform; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named

COMMON, LEAST = 2e-6, 8
#: Classes for each cube root of the training tokens, at least and at most.
CLASSES_A_ROOT, LEAST_CLASSES, MOST_CLASSES = 1.2, 128, 256
PAIRS, CELLS = 16, 32
ROUNDS, WORD_ROUNDS = 5, 3
#: Pseudo-tokens that hold a row back, and the part of the gap that a step closes: one over the three rows that are moved
#: at once in the class softmax, so that steps can't overshoot.
HOLD, RATE = 8.0, 1 / 3
STRETCH, HELD = 1 << 23, 1 << 22
END = 0


def floor_power(x: float, least: int, most: int) -> int:
    """The largest power of two up to x, between least and most."""
    return max(least, min(most, 1 << max(0, int(x).bit_length() - 1)))


def ending_hash(word: bytes) -> int:
    return zlib.crc32(word[-2:])


class Split:
    """Words of a batch of UTF-8 texts (binary; null: none): distinct ones, a number for each token, and ends of texts."""

    def __init__(self, texts: pa.Array) -> None:
        plain = pc.fill_null(texts, b"").view(pa.string())  # only ASCII letters and white space are looked at
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary.view(pa.binary())
        code, ends = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        real = pc.not_equal(pc.binary_length(self.words), 0).to_numpy(zero_copy_only=False)[code]
        self.ends = np.concatenate([[0], np.cumsum(real)])[ends]  # with a 0 in front
        self.code = code[real]


def stretches(b: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some STRETCH bytes of text in column ``texts``, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH)))
        yield b.slice(at, end - at)
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: how often it occurs in all texts; the end token isn't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in stretches(b, 0):
                s = Split(part.column(0))
                n = np.bincount(s.code, minlength=len(s.words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([s.words.take(pa.array(some)), pa.array(n[some], pa.int64())], names=["word", "n"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Symbols:
    """0 is the end, then the common words, then the tail of each class; classes count from 0, that of the end is last."""

    def __init__(self, common: list[bytes], classes: int) -> None:
        self.common, self.classes = pa.array(common, pa.binary()), classes
        n = len(common)
        self.of_class = np.concatenate([[classes], np.fromiter((ending_hash(w) % classes for w in common), np.int64, n), np.arange(classes)])
        order = np.argsort(self.of_class, kind="stable")
        self.size = np.bincount(self.of_class, minlength=classes + 1)  # words of a class, its tail included
        first = np.cumsum(self.size) - self.size
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order)) - np.repeat(first, self.size)

    def of(self, words: pa.Array) -> np.ndarray:
        """The symbols of distinct words."""
        found = pc.index_in(words, value_set=self.common)
        out = pc.fill_null(found, -1).to_numpy().astype(np.int64) + 1
        tail = np.flatnonzero(out == 0)
        ends = words.take(pa.array(tail)).to_pylist()
        out[tail] = np.fromiter((1 + len(self.common) + ending_hash(w) % self.classes for w in ends), np.int64, len(tail))
        return out


def contexts(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each place of ``s``, and before that; before a text (``first``: where texts begin) stands its end."""
    end = s[first[1] - 1] if len(first) > 1 else s[-1]
    before, skipped = np.empty_like(s), np.empty_like(s)
    before[1:], skipped[2:] = s[:-1], s[:-2]
    before[first] = end
    skipped[first] = end
    second = first + 1
    skipped[second[second < len(s)]] = end
    return before, skipped


def classes_of(ids: list[bytes], symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of whole texts, joined; their classes, the two classes before each, and where texts begin."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    s = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
    c = symbols.of_class[s]
    first = np.cumsum(sizes) - sizes
    return s, c, *contexts(c, first), first


def encoded(docs: DataFrame, is_train: Column, keep: list[str], held) -> DataFrame:
    """The columns ``keep`` with train, ids (symbols of the whole text), n_tokens, n_near, near (logs of the counts of common
    words), share (logs of the tails' sizes), rare and times (the other words).  ``held``: the common words, the number of classes, logs by symbol."""
    kinds = {"train": "boolean", "ids": "binary", "n_tokens": "long", "n_near": "long", "near": "double", "share": "double", "rare": "array<binary>", "times": "array<long>"}
    schema = ", ".join([f"`__{i}` {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)] + [f"{k} {t}" for k, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, classes, log_of = held.value
        symbols = Symbols(common, classes)
        n_common, none = len(symbols.common), log_of[END] == 0
        for b in batches:
            for part in stretches(b, len(keep) + 1):
                t = Split(part.column(len(keep) + 1))
                n = part.num_rows
                of_word = symbols.of(t.words)
                sizes = np.diff(t.ends)
                owner = np.repeat(np.arange(n), sizes)
                s = np.full(len(t.code) + n, END, dtype="<u4")
                s[np.arange(len(t.code)) + owner] = of_word[t.code]
                ends = t.ends[1:] + np.arange(1, n + 1)
                near = s <= n_common
                sums = [np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])] for x in (near, np.where(near, log_of[s], 0), np.where(near, 0, log_of[s]))]
                rare = np.flatnonzero(of_word[t.code] > n_common)
                pairs, times = np.unique(owner[rare] * len(t.words) + t.code[rare], return_counts=True)
                which = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(t.words)), minlength=n))]).astype(np.int32)
                offsets = pa.array(which, pa.int32())
                words = pa.ListArray.from_arrays(offsets, t.words.take(pa.array(pairs % max(1, len(t.words)))))
                ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int32).tobytes()), pa.py_buffer(s.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], part.column(len(keep)), ids, pa.array(sizes + 1, pa.int64()), pa.array(np.diff(sums[0]) * (not none), pa.int64()), pa.array(np.diff(sums[1])), pa.array(np.diff(sums[2])),
                     words, pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=[*[f"__{i}" for i in range(len(keep))], *kinds],
                )

    sent = [*[named(k).alias(f"__{i}") for i, k in enumerate(keep)], F.coalesce(is_train, F.lit(False)).alias("train"), F.col("text").cast("binary").alias("text")]
    return docs.select(*sent).mapInArrow(run, schema)


def _summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    k, n = np.concatenate(keys), np.concatenate(numbers)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[start], np.add.reduceat(n, start) if len(k) else n


def counted(ids: DataFrame, held) -> DataFrame:
    """ids of texts -> a row each (level, block) with cells and their numbers.  Level 1: block is the class before, a cell
    the class before that and the class; level 2: block is the class, a cell the class before and the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(*held.value[:2])
        c_all = symbols.classes + 1
        for b in (part for b in batches for part in stretches(b, 0)):
            s, c, before, skipped, _ = classes_of(b.column(0).to_pylist(), symbols)
            rows = []
            for level, block, cell, wide in ((1, before, skipped * c_all + c, c_all * c_all), (2, c, before * symbols.size[c] + symbols.place[s], c_all * int(symbols.size.max()))):
                key, n = np.unique(block * wide + cell, return_counts=True)
                cuts = np.searchsorted(key, np.arange(c_all + 1) * wide)
                rows += [(level, i, (key[x:y] - i * wide).astype("<i8").tobytes(), n[x:y].astype("<i8").tobytes()) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["level", "block", "cells", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, numbers, size = None, [], [], 0

        def one() -> pa.RecordBatch:
            k, n = _summed(keys, numbers)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["level", "block", "cells", "n"])

        for b in batches:
            for level, block, cells, n in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if at is not None and at != (level, block):
                    yield one()
                    keys, numbers, size = [], [], 0
                at = (level, block)
                keys.append(np.frombuffer(cells, dtype="<i8"))
                numbers.append(np.frombuffer(n, dtype="<i8"))
                size += len(keys[-1])
                if size > HELD + 2 * len(keys[0]):  # what is held stays near the number of distinct cells
                    k, m = _summed(keys, numbers)
                    keys, numbers, size = [k], [m], len(k)
        if at is not None:
            yield one()

    kinds = "level int, block int, cells binary, n binary"
    return ids.mapInArrow(run, kinds).repartition("level", "block").sortWithinPartitions("level", "block").mapInArrow(merge, kinds)


def step(w: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One gradient step of rows of weights: observed less expected over their logarithmic mean, held back by HOLD
    pseudo-tokens that are shared out as expected."""
    hold = HOLD * (expected + 1e-6) / (expected.sum(axis=-1, keepdims=True) + 1e-6 * expected.shape[-1])
    return np.clip(w + RATE * np.log((observed + hold) / (expected + hold)), -12, 12)


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities along the last axis, and the logs of the sums."""
    top = z.max(axis=-1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=-1, keepdims=True)
    return e / total, (top + np.log(total))[..., 0]


def pair_of(skipped: np.ndarray) -> np.ndarray:
    return (skipped * 2654435761 >> 7) % PAIRS


def class_energies(w: dict[str, np.ndarray], before: int) -> np.ndarray:
    """Energies of all classes for all classes before ``before``, in double precision."""
    return w["bias"] + w["before"][before] + w["skip"] + w["pair"][before * PAIRS + pair_of(np.arange(len(w["bias"])))]


def class_round(blocks: DataFrame, w: dict[str, np.ndarray], last: bool) -> dict[str, np.ndarray]:
    """A round over the class counts; with ``last``, the logs of the sums of every context instead."""
    spark = blocks.sparkSession
    held, c_all = spark.sparkContext.broadcast(w), len(w["bias"])
    pair = pair_of(np.arange(c_all))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        own, skips = [], np.zeros((2, c_all, c_all))
        for b in batches:
            for block, cells, n in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                p, sums = softmax(class_energies(w, block))
                if last:
                    own.append((block, sums.astype("<f4").tobytes()))
                    continue
                count = np.zeros(c_all * c_all)
                count[np.frombuffer(cells, dtype="<i8")] = np.frombuffer(n, dtype="<i8")
                count = count.reshape(c_all, c_all)
                p *= count.sum(axis=1, keepdims=True)
                skips += count, p
                both = np.zeros((2, PAIRS, c_all))
                np.add.at(both, (slice(None), pair), np.stack([count, p]))
                moved = [step(w["before"][block], count.sum(axis=0), p.sum(axis=0))[None], step(w["pair"][block * PAIRS : (block + 1) * PAIRS], *both)]
                own.append((block, np.concatenate(moved).astype("<f4").tobytes()))
        rows = [(0, *x) for x in own] + ([] if last or not own else [(1, i, skips[:, i].astype("<f8").tobytes()) for i in range(c_all)])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "row", "values"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for kind, row, values in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                v = np.frombuffer(values, dtype="<f8" if kind else "<f4")
                total[kind, row] = total[kind, row] + v if (kind, row) in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([r for _, r in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["kind", "row", "values"])

    kinds = "kind int, row int, values binary"
    parts = blocks.mapInArrow(run, kinds).repartition("kind", "row").sortWithinPartitions("kind", "row", F.xxhash64("values"))
    rows = parts.mapInArrow(add, kinds).collect()  # the weights, once
    out = {k: v.copy() for k, v in w.items()}
    if last:
        out["sums"] = np.full((c_all, c_all), np.nan, dtype=np.float32)
    skips = np.zeros((2, c_all, c_all))
    for r in rows:
        v = np.frombuffer(r["values"], dtype="<f8" if r["kind"] else "<f4")
        if last:
            out["sums"][r["row"]] = v
        elif r["kind"] == 0:
            v = v.reshape(-1, c_all)
            out["before"][r["row"]], out["pair"][r["row"] * PAIRS : (r["row"] + 1) * PAIRS] = v[0], v[1:]
        else:
            skips[:, r["row"]] = v.reshape(2, c_all)
    if last:
        for i in np.flatnonzero(np.isnan(out["sums"][:, 0])):  # classes that never stand before another
            out["sums"][i] = softmax(class_energies(w, int(i)))[1]
    else:
        out["skip"] = step(w["skip"], *skips).astype(np.float32)
    held.unpersist()
    return out


def train_classes(blocks: DataFrame, mass: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the class softmax from the counts of level 1, and the logs of its sums; ``mass``: tokens by class."""
    c_all = len(mass)
    w = {"bias": np.log(mass + 0.5)} | {k: np.zeros((n, c_all), dtype=np.float32) for k, n in (("before", c_all), ("skip", c_all), ("pair", c_all * PAIRS))}
    for _ in range(ROUNDS):
        w = class_round(blocks, w, False)
    return class_round(blocks, w, True)


def cell_of(before: np.ndarray, place: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The hashed cell of a class before and a word's place among ``cells`` (a power of two)."""
    h = (before + 1) * 0x9E3779B1 ^ (place + 1) * 0x85EBCA77
    return ((h ^ h >> 15) * 0x2C1B3C6D >> 12) & (cells - 1)


def train_class(before: np.ndarray, place: np.ndarray, n: np.ndarray, words: int, c_all: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one class: biases of its words, hashed weights, and the logs of the sums after every class before."""
    cells = floor_power(CELLS * words, CELLS, 1 << 30)
    every, bias, u = np.arange(words), np.log(np.bincount(place, weights=n, minlength=words) + 0.5), np.zeros(cells)
    per = max(1, (1 << 20) // words)  # rows of the dense table that are held at a time
    mass = np.bincount(before, weights=n, minlength=c_all)
    observed = np.bincount(cell_of(before, place, cells), weights=n, minlength=cells)
    for _ in range(WORD_ROUNDS if words > 1 else 0):
        expected = np.zeros(cells)
        some = np.flatnonzero(mass)
        for at in range(0, len(some), per):
            rows = some[at : at + per]
            cell = cell_of(rows[:, None], every, cells)
            p, _ = softmax(bias + u[cell])
            expected += np.bincount(cell.ravel(), weights=(p * mass[rows][:, None]).ravel(), minlength=cells)
        u = np.clip(u + 2 * RATE * np.log((observed + HOLD / 4) / (expected + HOLD / 4)), -12, 12)
    sums = np.concatenate([softmax(bias + u[cell_of(np.arange(at, min(at + per, c_all))[:, None], every, cells)])[1] for at in range(0, c_all, per)])
    return bias, u, sums


def train_words(blocks: DataFrame, held, symbols: Symbols) -> dict[str, np.ndarray]:
    """Weights of all words: bias by symbol, u with the start and number of each class's cells, sums by class and class before."""
    c_all = symbols.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = Symbols(*held.value[:2]).size
        for b in batches:
            for block, cells, n in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                cell = np.frombuffer(cells, dtype="<i8")
                bias, u, sums = train_class(cell // size[block], cell % size[block], np.frombuffer(n, dtype="<i8"), int(size[block]), c_all)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((bias, "<f8"), (u, "<f4"), (sums, "<f8"))]], names=["block", "bias", "u", "sums"])

    found = {r["block"]: r for r in blocks.mapInArrow(run, "block int, bias binary, u binary, sums binary").collect()}  # the weights, once
    bias, sums, u = np.zeros(len(symbols.of_class)), np.zeros((c_all, c_all)), []
    first = np.argsort(symbols.of_class, kind="stable")
    starts = np.cumsum(symbols.size) - symbols.size
    for c in range(c_all):
        own = first[starts[c] : starts[c] + symbols.size[c]]
        if c in found:
            bias[own], sums[c] = np.frombuffer(found[c]["bias"], dtype="<f8"), np.frombuffer(found[c]["sums"], dtype="<f8")
            u.append(np.frombuffer(found[c]["u"], dtype="<f4"))
        else:  # never seen: all words alike
            sums[c] = np.log(max(1, len(own)))
            u.append(np.zeros(1, dtype=np.float32))
    cells = np.array([len(x) for x in u], dtype=np.int64)
    return {"word": bias, "word_sums": sums, "u": np.concatenate(u), "cells": cells, "at": np.cumsum(cells) - cells}


def log_probability(w: dict[str, np.ndarray], symbols: Symbols, s: np.ndarray, c: np.ndarray, before: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """log10 of each symbol's probability after its context; of a tail, that of the whole tail."""
    z = w["bias"][c] + w["before"][before, c] + w["skip"][skipped, c] + w["pair"][before * PAIRS + pair_of(skipped), c] - w["sums"][before, skipped]
    z += w["word"][s] + w["u"][w["at"][c] + cell_of(before, symbols.place[s], w["cells"][c])] - w["word_sums"][c, before]
    return z / np.log(10)


def text_scores(w: dict[str, np.ndarray], symbols: Symbols, ids: list[bytes], most: int = 1 << 17) -> np.ndarray:
    """Sums of log_probability() over whole texts."""
    s, c, before, skipped, first = classes_of(ids, symbols)
    each = np.concatenate([log_probability(w, symbols, *[x[at : at + most] for x in (s, c, before, skipped)]) for at in range(0, len(s), most)])
    return np.add.reduceat(each, first)


def score(docs: DataFrame, is_train: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, n_known, train_tokens, base_score, score; learns where ``is_train`` holds."""
    sc = docs.sparkSession.sparkContext
    train = docs.filter(F.coalesce(is_train, F.lit(False)))
    counts = materialize(word_counts(train), "lm-counts")
    n_texts = train.count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = n_words + n_texts, v_words + (n_texts > 0)
    classes = floor_power(CLASSES_A_ROOT * n_all ** (1 / 3), LEAST_CLASSES, MOST_CLASSES)
    usual = F.col("c") >= max(COMMON * n_all, LEAST)
    rows = sorted(((r["c"], bytes(r["word"])) for r in counts.filter(usual).collect()), key=lambda x: (-x[0], x[1]))  # at most 1 / COMMON
    symbols = Symbols([w for _, w in rows], classes)
    tails = np.zeros((2, classes))
    of_class = F.crc32(F.expr("substring(word, -2, 2)")) % classes
    for r in counts.filter(~usual).groupBy(of_class.cast("int").alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tails[:, r["class"]] = r["n"], r["v"]
    number = np.array([n_texts, *[c for c, _ in rows], *tails[0]], dtype=np.float64)
    log_of = np.log10(number + 1)
    log_of[1 + len(rows) :] = np.log10(tails.sum(axis=0) + 1)
    held = sc.broadcast(([w for _, w in rows], classes, log_of))  # plain values: tasks may lack this module
    d = materialize(encoded(docs, is_train, keep, held).withColumn("__row", F.monotonically_increasing_id()), "lm-encoded")
    grams = materialize(counted(d.filter("train").select("ids"), held), "lm-counted")
    level = [grams.filter(F.col("level") == i).select("block", "cells", "n") for i in (1, 2)]
    w = train_classes(level[0], np.bincount(symbols.of_class, weights=number, minlength=classes + 1))
    w = sc.broadcast({k: v.astype(np.float32) if v.dtype == np.float64 else v for k, v in (w | train_words(level[1], held, symbols)).items()})
    sent = [*[f"__{i}" for i in range(len(keep))], "__row", "n_tokens", "n_near", "near", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(*held.value[:2])
        for b in (part for b in batches for part in stretches(b, len(sent))):
            got = text_scores(w.value, symbols, b.column(len(sent)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(sent)], pa.array(got.astype(np.float64))], names=[*sent, "model"])

    schema = ", ".join([f"`{k}` {d.schema[k].dataType.simpleString()}" for k in sent] + ["model double"])
    scored = d.select(*sent, "ids").mapInArrow(run, schema)
    rare = d.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("__row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word").groupBy(F.col("__row").alias("__r")).agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"))
    scored = scored.join(found, F.col("__row") == F.col("__r"), "left")
    rare_log, n_rare = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    base = F.col("near") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))
    full = F.col("model") + rare_log - F.col("share")
    names = [F.col(f"__{i}").alias(k) for i, k in enumerate(keep)]
    return scored.select(*names, "n_tokens", (F.col("n_near") + n_rare).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))
