"""Lexical retrieval packing: sequences are filled with documents that BM25 finds near their first one.

Every document is tokenised whole and ended with one id.  Full windows of a long document are sequences of their own;
what remains of each document (under one window) is packed with its neighbours.  The inverted index is sharded by
content: three draws from a document's terms, each term in proportion to its inverse document frequency and the same
for all documents, order the corpus, so that documents which share rare terms stand together; shards are consecutive
runs of ``SHARD_DOCS`` in that order, however often a draw, a text or an id repeats.  In a shard the first unused
remainder seeds a sequence; BM25 scores all unused ones against the seed's document, and they fill the window in order
of their scores.  The last one is cut to fit, and its rest stays unused in the index.

Terms, their frequencies and lengths are those of whole documents, also where only the remainder is left to pack;
document frequencies are those of the whole corpus, counted while it is tokenised (at most a row a vocabulary id).

A shard's last, incomplete sequence is dealt into sequences of powers of two, which need no padding.

Defined results: a null or empty text is one id (the end) and one piece; repeated rows and rows with a null doc_id are
documents of their own; ties in a score go to the document that comes first in the shard; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ragged

WINDOW = 4096
END_ID = 2
SHARD_DOCS = 1000
K1, B = 1.2, 0.75
#: Draws that order the corpus, and shards that one task packs.
DRAWS, SHARDS_A_TASK = 3, 8
#: Encoded runs that a worker keeps, the first that it meets, and bytes of text that it splits at a time.
CACHE, STRETCH = 400_000, 1 << 24
IDS = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Ids of texts as 16-bit numbers.  As a mapping: a part of a word -> its ids.

    Texts are split at white space, distinct words into their letters and what follows, that into the runs which the
    tokenizer never joins, and only runs not yet seen go through the model.  Words with characters that lower-casing or composing may change, or that can hold a
    special token, are encoded by the whole tokenizer, as are texts with control characters that Python, but not the
    tokenizer, takes for white space.
    """

    RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > IDS:
            raise ValueError("ids of this vocabulary don't fit into 16 bits")
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = {b for b in range(256) if chr(b).isprintable() and chr(b) != " "}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _direct(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        if run.isalpha() or (runs := self.RUNS.findall(run)) == [run]:
            piece = run if run.isascii() and run.isalpha() else run.encode().decode("latin-1").translate(self.letters)
            out = array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()
        else:
            out = b"".join(map(self.__getitem__, runs))
        if len(self) < CACHE:
            self[run] = out
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, joined, with the place and number of each word's."""
        plain = pc.and_(pc.match_substring_regex(words, r"^[\x{00}-\x{FF}]*$"), pc.invert(pc.match_substring(words, "<|")))
        lower = pc.utf8_lower(pc.if_else(plain, words, ""))
        parts = pc.split_pattern(pc.replace_substring_regex(lower, r"^(\p{L}+)", r"\1 "), " ", max_splits=1)  # letters, what follows
        coded = parts.flatten().dictionary_encode()
        # no part holds a blank, and splitting one text is faster than a list of an array
        each = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ") if len(words) else []
        known = list(map(self.__getitem__, each))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        of_part = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(known), dtype=np.uint16)[ragged(np.cumsum(sizes) - sizes, sizes, of_part)]
        ends = np.concatenate([[0], np.cumsum(sizes[of_part])])[np.cumsum(pc.list_value_length(parts).to_numpy())]
        size = np.diff(ends, prepend=0)
        start = ends - size
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        more = [self._direct(w) for w in words.take(pa.array(odd)).to_pylist()]
        size[odd] = [len(m) // 2 for m in more]
        start[odd] = len(ids) + np.cumsum(size[odd]) - size[odd]
        return np.concatenate([ids, np.frombuffer(b"".join(more), dtype=np.uint16)]), start, size

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH)))
            yield from self._stretch(texts.slice(at, end - at))
            at = end

    def _stretch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        control = pc.match_substring_regex(texts, r"[\x1c-\x1f]")
        split = pc.utf8_split_whitespace(pc.if_else(control, "", texts))
        coded = split.flatten().dictionary_encode()
        ids, start, size = self._words(coded.dictionary)
        code = coded.indices.to_numpy()
        ids = ids[ragged(start, size, code)]
        ends = np.concatenate([[0], np.cumsum(size[code])])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        for i, whole in enumerate(control.to_pylist()):
            yield np.frombuffer(self._direct(texts[i].as_py()), dtype=np.uint16) if whole else ids[ends[i] : ends[i + 1]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker; those that pack shards let go of it."""
    return Encoder(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, doc_tokens, crcs (of its full windows), rest (16-bit ids of the remainder); of longer documents also
    terms (16-bit) and times (32-bit); df: in a batch's first row the ids and numbers of documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(path), np.array([END_ID], dtype=np.uint16)
        for b in batches:
            if not b.num_rows:
                continue
            out = {k: [] for k in ("doc_tokens", "crcs", "rest", "terms", "times")}
            held = np.zeros(IDS, dtype=np.int64)
            for ids in ids_of.encode(b.column(1)):
                ids = np.concatenate([ids, end])
                full = len(ids) // WINDOW
                terms, times = np.unique(ids, return_counts=True)
                held[terms] += 1
                out["doc_tokens"].append(len(ids))
                out["crcs"].append([_crc(ids[i * WINDOW : (i + 1) * WINDOW]) for i in range(full)])
                out["rest"].append(ids[full * WINDOW :].astype("<u2").tobytes())
                out["terms"].append(terms.astype("<u2").tobytes() if full else None)
                out["times"].append(times.astype("<u4").tobytes() if full else None)
            some = np.flatnonzero(held)
            df = [some.astype("<u2").tobytes() + held[some].astype("<u4").tobytes(), *[None] * (b.num_rows - 1)]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], pa.array(df, pa.binary())], names=["doc_id", *out, "df"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, crcs array<long>, rest binary, terms binary, times binary, df binary")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Documents that hold each id; an entry a vocabulary id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(IDS, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                k = len(t) // 6
                n[np.frombuffer(t, dtype="<u2", count=k)] += np.frombuffer(t, dtype="<u4", offset=2 * k)
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids], pa.int64())], names=["id", "n"])

    out = np.zeros(IDS, dtype=np.int64)
    for r in tokens.filter("df is not null").select("df").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def draws(idf: np.ndarray, held_by: np.ndarray, seed: int = 17) -> np.ndarray:
    """DRAWS rankings of the ids: the best-ranked id of a document is one of its ids in proportion to the weights, and
    the same for like documents.  Ids of one document only lead nowhere and rank last."""
    weight = np.where(held_by > 1, idf * idf, 0.0)
    with np.errstate(divide="ignore"):
        late = np.random.default_rng(seed).exponential(size=(DRAWS, IDS)) / weight
    return np.argsort(np.argsort(late, axis=1, kind="stable"), axis=1, kind="stable").astype(np.uint16)


def placed(tokens: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``tokens`` with place: a number under which like documents stand together."""
    held = tokens.sparkSession.sparkContext.broadcast(ranks)
    columns = ["doc_id", "doc_tokens", "crcs", "rest", "terms", "times", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = [t or r for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            # a document of whole windows only has an empty rest, and terms
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
            ids, start, place = np.frombuffer(b"".join(raw), dtype="<u2"), np.cumsum(sizes) - sizes, np.zeros(len(raw), dtype=np.int64)
            for r in held.value:
                place = place << 16 | np.minimum.reduceat(r[ids], start).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*columns, "place"])

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in columns)
    return tokens.select(*columns).mapInArrow(run, f"{kinds}, place long")


def _postings(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each id in sorted ids."""
    size = np.bincount(term, minlength=IDS)
    return np.cumsum(size) - size, size


def pack_shard(rests: list[np.ndarray], bags: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, idf: np.ndarray, mean: float) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, first, length) over the remainders; all but the last fill the window.  ``bags``: distinct
    terms and their times in each whole document, ``lengths``: its tokens."""
    n = len(rests)
    left = np.array([len(r) for r in rests], dtype=np.int64)
    first = np.zeros(n, dtype=np.int64)
    sizes = np.array([len(t) for t, _ in bags], dtype=np.int64)
    term, tf = (np.concatenate([bag[i] for bag in bags]) if n else np.zeros(0, dtype=np.int64) for i in (0, 1))
    norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
    doc = np.repeat(np.arange(n), sizes)
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    impact = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
    start, size = _postings(term)
    sequence, space, seed, indexed = [], WINDOW, 0, n

    def take(d: int) -> None:
        nonlocal space
        k = min(int(left[d]), space)
        sequence.append((d, int(first[d]), k))
        first[d] += k
        left[d] -= k
        space -= k

    while True:
        while seed < n and not left[seed]:
            seed += 1
        if seed == n:
            break
        query = bags[seed][0]
        take(seed)
        if space:
            unused = np.flatnonzero(left)
            if 4 * len(unused) < 3 * indexed:  # only unused ones stay in the index
                stay = left[doc] > 0
                term, doc, impact, indexed = term[stay], doc[stay], impact[stay], len(unused)
                start, size = _postings(term)
            at = ragged(start[query], size[query], np.arange(len(query)))
            score = np.bincount(doc[at], weights=impact[at], minlength=n)[unused]
            for d in unused[np.argsort(-score, kind="stable")].tolist():
                take(d)
                if not space:
                    break
        if not space:
            yield sequence
            sequence, space = [], WINDOW
    if sequence:
        yield sequence


def in_powers(sequence: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence dealt into sequences whose lengths are falling powers of two."""
    rest = list(sequence)
    while rest:
        space = 1 << (sum(k for _, _, k in rest).bit_length() - 1)
        out = []
        while space:
            d, start, k = rest.pop(0)
            out.append((d, start, min(k, space)))
            if k > space:
                rest.insert(0, (d, start + space, k - space))
            space -= out[-1][2]
        yield out


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows; the last may have fewer."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, *, tokenizer: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = materialize(tokenized(docs, tokenizer or default_tokenizer()).withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    count = frequencies(tokens)
    n, all_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    weights = np.log1p((n - count + 0.5) / (count + 0.5))
    idf, mean = docs.sparkSession.sparkContext.broadcast(weights), all_tokens / max(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        encoder.cache_clear()
        for t in _runs(batches, shard_docs):
            column = {k: t.column(k).to_pylist() for k in ("doc_tokens", "crcs", "rest", "terms", "times")}
            if number is None:
                number = t.column("part")[0].as_py() << 36  # sequences of one task
            total, which, rows = column["doc_tokens"], [], []
            rests = [np.frombuffer(x, dtype="<u2") for x in column["rest"]]
            bags = [np.unique(r, return_counts=True) if ids is None else (np.frombuffer(ids, dtype="<u2"), np.frombuffer(times, dtype="<u4").astype(np.int64)) for r, ids, times in zip(rests, column["terms"], column["times"], strict=True)]
            for d, crcs in enumerate(column["crcs"]):
                for i, crc in enumerate(crcs):
                    which.append(d)
                    rows.append((i * WINDOW, WINDOW, crc, total[d], number, 0, WINDOW))
                    number += 1
            for sequence in pack_shard(rests, bags, np.array(total), idf.value, mean):
                whole = sum(k for _, _, k in sequence) == WINDOW
                for part in [sequence] if whole else in_powers(sequence):
                    size, offset = sum(k for _, _, k in part), 0
                    for d, start, k in part:
                        which.append(d)
                        rows.append((total[d] - len(rests[d]) + start, k, _crc(rests[d][start : start + k]), total[d], number, offset, size))
                        offset += k
                    number += 1
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(PIECES)).T
            ids = t.column("doc_id").take(pa.array(which, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=["doc_id", *PIECES])

    parts = max(1, -(-n // (shard_docs * SHARDS_A_TASK)))
    # of rows under one place, copies of a text stand together; the row's number lets any place go to several tasks
    order = ["place", F.crc32("rest"), F.xxhash64("doc_id", F.lit(5)), "row"]
    spread = placed(tokens, draws(weights, count)).repartitionByRange(parts, *order)
    inside = spread.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return inside.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{p} long" for p in PIECES))
