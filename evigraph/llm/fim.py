"""Fill-in-middle transformation: a document becomes prefix, suffix and middle, each behind its sentinel.

A kernel on Arrow buffers does all rows of a batch together: bytes are classed by a lookup, unit ends are where a word's byte
meets white space or the end of a text, one cumulative sum over the batch counts the units and starts again at each
document, and one search in it finds the cuts of all rows.  The pieces are views of the same buffer, joined by Arrow.

Units are words with the white space before them; a text's last white space is one of its own.  Which documents are
transformed, in which form and where they are cut follows from a hash of the seed and the doc_id, so reruns agree.

Defined results: a null text is empty; an empty text and one that contains a sentinel stay as they are (plain); a null
doc_id hashes as the empty text; repeated rows are treated alike; a text of any length is cut whole; an empty table gives
an empty result; other columns are not read, unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named
from .units import cut, raw, stretches, unit_ends

SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred documents: those transformed; and of a hundred of these, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return [F.conv(F.substring(F.sha2(text, 256), 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def cuts(data: np.ndarray, places: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes where its prefix and its middle end."""
    ended = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(unit_ends(data, places), out=ended[1:], dtype=np.int32)
    before = ended[places[:-1]]
    n = (ended[places[1:]] - before).astype(np.int64)
    first, second = one % (n + 1), two % (n + 1)
    ends = [np.searchsorted(ended, (before + k).astype(np.int32)) for k in (np.minimum(first, second), np.maximum(first, second))]
    return n, *ends


def _transformed(texts: pa.Array, h: list[np.ndarray], rate: int, suffix_first: int) -> list[pa.Array]:
    data, places = raw(texts)
    n, a, b = cuts(data, places, h[0], h[1])
    marked = pc.match_substring_regex(texts, "|".join(SENTINELS)).to_numpy(zero_copy_only=False)
    moved = (np.diff(places) > 0) & ~marked & (h[2] % 100 < rate)
    spm = h[3] % 100 < suffix_first
    pieces = cut(data, np.concatenate([np.column_stack([places[:-1], a, b]).ravel(), places[-1:]]))
    row = np.flatnonzero(moved)
    back = spm[row]
    tags = pa.array(SENTINELS)
    prefix, middle = pieces.take(pa.array(3 * row)), pieces.take(pa.array(3 * row + 1))
    first, second = pieces.take(pa.array(3 * row + np.where(back, 2, 0))), pieces.take(pa.array(3 * row + np.where(back, 0, 2)))
    joined = pc.binary_join_element_wise(tags.take(pa.array(back.astype(np.int64))), first, tags.take(pa.array(1 - back)), second, SENTINELS[2], middle, "")
    form = np.where(moved, np.where(spm, 2, 1), 0)

    def spread(values: pa.Array) -> pa.Array:
        out = np.zeros(len(n), dtype=np.int64)
        out[row] = values.to_numpy(zero_copy_only=False)
        return pa.array(out, mask=~moved)

    return [
        pa.array(n), pa.array(["plain", "psm", "spm"]).take(pa.array(form)), spread(pc.utf8_length(prefix)), spread(pc.utf8_length(middle)),
        pc.replace_with_mask(texts, pa.array(moved), joined),
    ]


def transform(docs: DataFrame, *, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in stretches(b.column(kept)):
                part = b.slice(at, len(texts))
                h = [part.column(kept + 1 + i).to_numpy() for i in range(4)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *_transformed(texts, h, rate, suffix_first)], names=names)

    chosen = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], "text", *draws(F.col("doc_id"), seed))
    names = [*chosen.columns[:kept], *[c.split()[0] for c in COLUMNS.split(", ")]]
    out = chosen.mapInArrow(run, ", ".join([*[f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(kept)], COLUMNS]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[kept:])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  No sentinel is in the text, and none can arise where pieces meet."""
    part = F.split(output, "|".join(SENTINELS))
    back = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(back)
