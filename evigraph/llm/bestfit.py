"""Best-fit packing: pieces of documents, longest first, each into the tightest sequence that has room for it.

Documents are tokenised whole and ended with one id.  One longer than a sequence is cut, the odd piece first, so all its
other pieces are sequences of their own.  Pieces have at most ``WINDOW`` different lengths, so their histogram is all that
the order of best-fit decreasing depends on.  The driver gets that histogram (a row a length, whatever the corpus) and runs
the whole corpus through one set of sequences: a segment tree over remaining capacities, which counts the open sequences of each, finds the
tightest one with room in logarithmic time.  Equal pieces that follow one another into equal sequences are placed as a run:
after a piece of size s went into the tightest capacity r, what is left there, r - s, is tightest again while it is at least
s, so a run is what one piece after another would do.  (A run is at most as long as its pieces, so the bound a piece holds.)
The plan has one row a run; a run starts where a size or a range of equal sequences does, and their number does not depend on the documents.

The pieces are numbered within their length: in a task as they are cut, over tasks by a prefix sum.  A piece's number
finds its run, hence its sequence and its place there.  Only the pieces' numbers are shuffled, no ids and no texts.

Defined results: a null or empty text is one id (the end) and one piece; repeated rows and rows with a null doc_id are
documents of their own; ties (equal lengths) go by the order in which the table is read; a text or a word of any length is
tokenised whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ragged
from .units import cut, raw, stretches, unit_ends

WINDOW = 1024
END_ID = 2
#: Entries of a task's cache, and characters of the longest run that it keeps.
CACHE, LONGEST = 400_000, 64
#: White space that the tokenizer knows beyond the ASCII one, or control characters that are near to it.
WIDE_SPACE = r"[\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Ids of texts.  As a mapping: a run that the tokenizer never joins with another -> its ids.

    No run goes on behind a word, so a text's ids are those of its units (words with the white space before them).  Distinct
    units are cut into their runs, and only runs not yet seen go through the model.  Texts with other white space than
    ASCII and units that may hold a special token are encoded by the whole tokenizer.
    """

    #: Fixed value: the runs of the byte-level pre-tokenizer.
    RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = {b for b in range(256) if chr(b).isprintable() and chr(b) != " "}
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def direct(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        word = run[1:]
        if word.isalpha() and word.isascii() and run[0] == " ":
            piece = self.letters[32] + word
        else:
            piece = run.encode().decode("latin-1").translate(self.letters)
        out = array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()
        if len(run) <= LONGEST:
            self[run] = out
        return out

    def unit(self, unit: str) -> bytes:
        known = self.get(unit)
        if known is not None:
            return known
        word = unit[1:-1]
        if word.isalpha() and unit[0] == " ":  # a word, or one with a sign behind it, most of the time
            if unit[-1].isalpha():
                return self[unit]
            if unit[-1] in ".,;:!?":
                return self[unit[:-1]] + self[unit[-1]]
        return self.direct(unit) if "<|" in unit else b"".join(map(self.__getitem__, self.RUNS.findall(unit)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's begin; one more place ends the last."""
        data, places = raw(texts)
        ends = np.flatnonzero(unit_ends(data, places)) + 1
        coded = cut(data, np.concatenate([[0], ends])).dictionary_encode()
        if len(self) > CACHE:
            self.clear()
        known = list(map(self.unit, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.kind).itemsize
        code = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(known), dtype=self.kind)[ragged(np.cumsum(sizes) - sizes, sizes, code)]
        begins = np.concatenate([[0], np.cumsum(sizes[code])])[np.searchsorted(ends, places[1:], side="right")]
        return ids, np.concatenate([[0], begins])


def pieces(docs: DataFrame, path: str, window: int, with_ids: bool) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, doc_tokens, task, nth (of its length in this task), and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        for b in batches:
            at = 0
            for texts in stretches(b.column(1)):
                wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
                ids, places = encoder.encode(pc.if_else(pa.array(wide), "", texts))
                rows, which = [], []
                for i in range(len(texts)):
                    own = np.frombuffer(encoder.direct(texts[i].as_py()), dtype=encoder.kind) if wide[i] else ids[places[i] : places[i + 1]]
                    own = np.append(own, encoder.kind(END_ID)).astype("<u4")
                    first = len(own) % window or window
                    for k, (start, end) in enumerate(zip([0, *range(first, len(own), window)], range(first, len(own) + 1, window), strict=True)):
                        part = own[start:end]
                        rows.append((k, start, end - start, zlib.crc32(part), len(own), task, int(seen[end - start])))
                        seen[end - start] += 1
                        which.append((at + i, part.tobytes() if with_ids else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                at += len(texts)
                row, held = zip(*which, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns, *([pa.array(held, pa.binary())] if with_ids else [])], names=names)

    kinds = [pa.int32(), *[pa.int64()] * 2, pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", *(["ids"] if with_ids else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Capacities:
    """A segment tree whose leaves are the remaining capacities 0 to ``most``; every node counts its open sequences."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, sequences: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += sequences
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least ``size`` that an open sequence has."""
        at = self.leaves + size
        while not self.count[at]:
            while at & 1:  # a right child: what follows it is right of its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over lengths -> numbers of pieces: runs (length, first piece, first sequence, pieces a
    sequence, offset), sorted, and the number of sequences."""
    tree, open_at, used, runs = Capacities(window), defaultdict(list), 0, []

    def opened(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            tree.add(capacity, n)
            open_at[capacity].append((first, n))

    for size in sorted(histogram, reverse=True):
        placed, left = 0, histogram[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, n = window, -(-left // (window // size))
                opened(window, used, n)
                used += n
            first, n = open_at[capacity].pop()
            tree.add(capacity, -n)
            each = capacity // size
            whole = min(n, left // each)  # sequences that take all they can
            some = left - whole * each if whole < n else 0
            runs.append((size, placed, first, each, window - capacity))
            opened(capacity - each * size, first, whole)
            if some:
                opened(capacity - some * size, first + whole, 1)
            opened(capacity, first + whole + (some > 0), n - whole - (some > 0))
            placed, left = placed + whole * each + some, left - whole * each - some
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), used


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids (32-bit, little-endian)
    if asked for."""
    cutted = materialize(pieces(docs, tokenizer or default_tokenizer(), window, with_ids), "fit-pieces")
    counts = materialize(cutted.groupBy("task", "length").agg(F.count("*").alias("n")), "fit-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("task").alias("of_task"), F.col("length").alias("of_length"), before.alias("before"))
    numbered = cutted.join(base, (F.col("task") == F.col("of_task")) & (F.col("length") == F.col("of_length"))).withColumn("number", F.col("before") + F.col("nth"))
    runs, _ = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    held = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, placed, first, each, offset = held.value.T
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            run = np.zeros(len(length), dtype=np.int64)
            for s in np.unique(length):
                low, high = np.searchsorted(size, [s, s + 1])
                of = length == s
                run[of] = low + np.searchsorted(placed[low:high], number[of], side="right") - 1
            t = number - placed[run]
            found = [pa.array(first[run] + t // each[run]), pa.array(offset[run] + t % each[run] * length)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *found], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    kinds = ", ".join(f"{c} {cutted.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.select(*kept, "number").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Of pack(with_ids=True): a row a sequence with its ids as bytes (32-bit, little-endian), at most a window each."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), inside.alias("parts")).select("sequence_id", "tokens", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex")).select("sequence_id", "tokens", F.unhex("hex").alias("ids"))
