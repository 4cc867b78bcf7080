"""Fill-in-middle samples by a whole-batch numpy kernel on Arrow's UTF-8 buffers.

A text is cut into units at two places drawn from its doc_id, and its parts are put in the order
prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind sentinels; some texts stay plain. All texts
of a slice of a batch are cut together on the one buffer that holds them: a byte-class lookup, a mask of
places where a unit begins by the classes of two adjacent bytes, one cumulative sum of the mask
that is set back to zero at each document by subtracting its value there, and one search in the
sum for each cut of all rows. Draws are SHA-256 numbers made by Spark, so they are the same after a retry.

Memory: a slice has at most SLICE bytes of text, or one text; the kernel takes some six times that.

Units: code points (char), runs of non-blanks with the blanks behind them (word), lines with their
line feed (line). Blanks are ASCII's.

Defined cases: null text counts as empty; an empty text, and one that contains a sentinel, is plain, so
output and form always give the text back (`restored`); rows without doc_id draw like an empty
doc_id, rows with equal doc_id draw alike, each with its own number of units; an empty table gives an empty
result; extra columns ride along, and input columns with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import OWN, appended, with_fields

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SLICE = 4 << 20

CONTINUED, NEWLINE, BLANK, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = CONTINUED
CLASSES[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
CLASSES[0x0A] = NEWLINE

_BEFORE, _HERE = np.divmod(np.arange(16), 4)
#: Whether a unit begins at a byte, by 4 * the class before it + its own.
BEGINS = {
    "char": _HERE != CONTINUED,
    "word": np.isin(_BEFORE, (NEWLINE, BLANK)) & (_HERE == OTHER),
    "line": (_BEFORE == NEWLINE) & (_HERE != CONTINUED),
}

DRAWS = [f"{OWN}h{i}" for i in range(1, 5)]


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(DRAWS[i]) for i in range(4)]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most SLICE bytes of text, or one row; with the bytes and the rows' offsets in them."""
    for b in batches:
        texts = b.column(b.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield b.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def unit_counts(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running number of units that have begun by each byte, its value before each row, and each row's units."""
    classes = CLASSES[data]
    begins = np.empty(len(data), bool)
    begins[1:] = BEGINS[unit][4 * classes[:-1] + classes[1:]]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    sums = np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.concatenate([np.zeros(1, sums.dtype), sums])[offsets]
    return sums, upto[:-1], np.diff(upto).astype(np.int64)


def places(sums: np.ndarray, before: np.ndarray, counts: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The byte where unit number cuts (from 0) of each row begins; the row's end for its number of units."""
    found = np.searchsorted(sums, (before + cuts + 1).astype(sums.dtype))
    return np.where(cuts < counts, found, offsets[1:])


def holding(data: np.ndarray, offsets: np.ndarray, needles: Sequence[bytes]) -> np.ndarray:
    """Which rows contain one of the byte strings; a row is left at its first."""
    whole, held = data.tobytes(), np.zeros(len(offsets) - 1, bool)
    for needle in needles:
        at = whole.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(needle) <= offsets[row + 1]
            held[row] |= inside
            at = whole.find(needle, int(offsets[row + 1]) if inside else at + 1)
    return held


def _strings(parts: list[list]) -> pa.Array:
    """One string for each list of byte pieces."""
    ends = np.cumsum([0, *[sum(map(len, p)) for p in parts]])
    data = pa.py_buffer(b"".join([x for p in parts for x in p]))
    return pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(ends.astype(np.int64)), data).cast(pa.string())


def _arranged(unit: str, plain_from: int, spm_below: int, sentinels: Sequence[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, tail, middle = sentinels
    for b, data, offsets in slices(batches, "text"):
        h = [b.column(b.schema.get_field_index(n)).to_numpy() for n in DRAWS]
        sums, before, n = unit_counts(data, offsets, unit)
        cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
        first, second = (places(sums, before, n, offsets, c) for c in cuts)
        plain = (h[2] % 100 >= plain_from) | (n == 0) | holding(data, offsets, sentinels)
        spm = h[3] % 100 < spm_below
        view = memoryview(data)
        parts = []
        for start, p, m, end, as_is, back in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
            if as_is:
                parts.append([view[start:end]])
            elif back:
                parts.append([tail, view[m:end], head, view[start:p], middle, view[p:m]])
            else:
                parts.append([head, view[start:p], tail, view[m:end], middle, view[p:m]])
        own = b.drop_columns(DRAWS)
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
        units = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[0], cuts[1] - cuts[0])]
        yield appended(own, ["n", "form", "prefix_units", "middle_units", "output"], [pa.array(n), form, *units, _strings(parts)])


def _checked(sentinels: Sequence[str]) -> list[bytes]:
    """Sentinels that can't be mistaken for one another, wherever they stand between parts that hold none."""
    first = {s[:1] for s in sentinels}
    clear = len(sentinels) == 3 and all(sentinels) and not any(f in s[1:] for f in first for s in sentinels)
    if not clear or any(a.startswith(b) for i, a in enumerate(sentinels) for j, b in enumerate(sentinels) if i != j):
        raise ValueError("three sentinels are needed of which none begins another and whose first signs occur nowhere else in them")
    return [s.encode() for s in sentinels]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", plain_from: int = 90, spm_below: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """docs with n (units), form, prefix_units and middle_units (null if plain) and output.

    Of 100 texts about 100 - plain_from stay plain; of the others spm_below in 100 are spm.
    """
    if unit not in BEGINS:
        raise ValueError(f"unit is one of {', '.join(BEGINS)}")
    made = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())]
    kernel = partial(_arranged, unit, plain_from, spm_below, _checked(sentinels))
    return docs.select("*", *draws(F.col("doc_id"), seed)).mapInArrow(kernel, with_fields(docs.schema, *made))


def rebuilt(output: bytes, form: str, sentinels: Sequence[bytes]) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    head, tail, middle = sentinels
    rest, _, m = output.rpartition(middle)
    if form == "spm":
        s, _, p = rest[len(tail) :].partition(head)
    else:
        p, _, s = rest[len(head) :].partition(tail)
    return p + m + s


def _restored(sentinels: Sequence[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offsets in slices(batches, "output"):
        forms = b.column(b.schema.get_field_index("form")).to_pylist()
        whole = data.tobytes()
        yield appended(b, ["restored"], [_strings([[rebuilt(whole[s:e], f, sentinels)] for s, e, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), forms, strict=True)])])


def restored(rows: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """rows with restored, the exact text rebuilt from output and form alone."""
    return rows.mapInArrow(partial(_restored, _checked(sentinels)), with_fields(rows.schema, T.StructField("restored", T.StringType())))
