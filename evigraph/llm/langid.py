"""Language identification by compression.

Each language's dictionary is raw text; a text is compressed with every dictionary in turn and belongs to the language
whose dictionary makes it smallest.  Where the smallest and the next differ by less than ``MIN_MARGIN`` of the next (as
in a tie), the decision is marked as rejected (``lang_pred`` still names the smallest).  Texts are lower-cased and taken whole, in
blocks, so that the dictionary also counts towards the end of a long one.

Dictionaries are learned from a bounded sample of whole texts: in the order of a hash of the id (of rows that repeat an id,
one), those that fit into what is left of ``BYTES`` a language.  Texts of more than a ``SHARE``-th of these bytes are not drawn, so that
one doesn't fill a dictionary, unless a language has no others; a text beyond ``BYTES`` never is.  The number of languages is
taken to be small (one dictionary each is sent to the tasks).

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with nothing learned
every text is ``und``; ties go to the language with more training documents, then to the smaller name; repeated rows
get the same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, named, unboxed

#: UTF-8 bytes of a dictionary at most, and the part of them that one text may take.
BYTES, SHARE = 1 << 17, 32
LEVEL = 6
BLOCK = 8192
MIN_MARGIN = 0.002
#: Bytes of margin at which the score reaches 1 - 1/e.
SCORE_SCALE = 4.0


def learn(train: DataFrame) -> dict[str, bytes]:
    """``train`` (doc_id, text, lang) -> dictionaries, most frequent language first."""
    t = train.filter("text is not null and lang is not null").select("doc_id", "text", "lang", F.octet_length("text").alias("size"))
    short, fits = F.col("size") <= BYTES // SHARE, F.col("size") <= BYTES
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size") + 1)), F.lit(0))
    langs = {r["lang"]: r for r in t.groupBy("lang").agg(F.count("*").alias("n"), total(short).alias("short"), total(fits).alias("fits")).collect()}  # a row a language
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, r in langs.items():
        which, size = (short, r["short"]) if r["short"] else (fits, r["fits"])
        # about twice the bytes that are needed
        chosen = chosen | ((F.col("lang") == lang) & which & (F.col("place") < int((1 << 30) * min(1.0, 2 * BYTES / max(size, 1)))))
    rows = t.withColumn("place", place).filter(chosen).groupBy("lang", "place").agg(F.min(F.lower("text")).alias("text")).collect()
    out = {}
    for lang in sorted(langs, key=lambda x: (-langs[x]["n"], x)):
        kept, left = [], BYTES
        for _, text in sorted((r["place"], r["text"]) for r in rows if r["lang"] == lang):
            raw = text.encode()
            if len(raw) < left:
                kept.append(raw)
                left -= len(raw) + 1
        out[lang] = b"\n".join(kept)
    return out


class Classifier:
    """Compressors for all languages; one per task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = list(dictionaries)
        self.compress = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
            if d is not None:
                d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        raw = f" {text.lower()} ".encode("utf-8", "replace")  # as a word stands inside the dictionary
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, rejected."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0, False
        best, following = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], float(1 - np.exp(-(following - best) / SCORE_SCALE)), (following - best) < MIN_MARGIN * following


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score, rejected; the text visits Python once."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    sent = [*keep, *([] if "text" in keep else ["text"])]
    at, n = sent.index("text"), len(keep)
    names = [*[f"__{i}" for i in range(n)], "lang_pred", "score", "rejected"]
    kinds = [*[docs.schema[k].dataType.simpleString() for k in keep], "string", "double", "boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(held.value)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(at)]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    found = docs.select(*[named(c).alias(f"__{i}") for i, c in enumerate(sent)]).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, kinds, strict=True)))
    return found.select(*[F.col(f"__{i}").alias(k) for i, k in enumerate(keep)], *names[n:])


def accepted_documents(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    kept = predict(boxed(docs, ["text"]), dictionaries, ["text", "box"]).filter(~F.col("rejected"))
    return unboxed(kept, docs, ["text"])
