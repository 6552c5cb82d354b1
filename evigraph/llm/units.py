"""Words with the white space before them, found in the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: By byte: white space of one byte.  All bytes of longer characters belong to words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are looked at together; a longer text is looked at alone.
STRETCH = 1 << 23


def stretches(texts: pa.Array, most: int = STRETCH) -> Iterator[pa.Array]:
    """Slices of ``texts`` (null: empty) of some ``most`` bytes, whole texts each."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where its texts begin; one more place ends the last."""
    places = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8, count=places[-1])[places[0] :] if data else np.zeros(0, dtype=np.uint8), places - places[0]


def cut(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """The strings between ``places``, which rise from 0 to the end of ``data``."""
    return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(np.ascontiguousarray(places, dtype=np.int32)), pa.py_buffer(data))


def unit_ends(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """By byte, whether a unit ends with it: a word's last byte, or a text's."""
    space = SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[places[1:][np.diff(places) > 0] - 1] = True
    return ends
