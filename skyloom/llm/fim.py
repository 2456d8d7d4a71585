"""Fill-in-middle transformation with a sparse exception index.

A text is cut at the ends of units: a unit is a run of white space with the word after it, or white space at the end of
the text. Units, cuts and pieces are found in the bytes, so the text is never decoded. What the bytes do not tell at once
is how many code points a piece has: the index of a text holds only its multibyte characters, each with its position (in
code points and in bytes) and the bytes it has in excess of one, summed up. A search in it converts a code-point position
to a byte position and back; between two exceptions, and in texts without any, that is plain arithmetic.

``cuts`` and ``form`` come from four numbers of 32 bits for each row: the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units and the middle after the larger one. A text is plain (not transformed) if it is empty, contains a mark,
or h3 % 100 >= ``rate``; otherwise its form is spm (suffix, prefix, middle) if h4 % 100 < ``spm_rate``, else psm.

Results by row: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), prefix_bytes,
middle_bytes (null if plain) and output (string). :func:`restored` rebuilds the text from output and form alone. Nulls: a
null text is empty and plain; a null doc_id is hashed like one without digits. Very long texts are cut whole; ties (two
equal cuts) give an empty middle. Repeated rows come out as often as they come in and alike; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, "42"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Rows that are put together before they are sent on, and bytes of text after which they are sent earlier.
ROWS, BYTES = 500, 16 << 20


class Exceptions:
    """Positions of the multibyte characters of a UTF-8 text and the bytes they have in excess, up to each and with it."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.at_char = self.at_byte - np.r_[0, self.excess[:-1]] if len(lead) else self.at_byte

    def byte_of(self, char: int) -> int:
        """Where the code point number ``char`` begins."""
        k = int(np.searchsorted(self.at_char, char))
        return char + (int(self.excess[k - 1]) if k else 0)

    def char_of(self, byte: int) -> int:
        """How many code points begin before ``byte``, which is where one begins (or the end)."""
        k = int(np.searchsorted(self.at_byte, byte))
        return byte - (int(self.excess[k - 1]) if k else 0)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte positions at which the units of a text end."""
    if not len(data):
        return np.empty(0, np.int64)
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.r_[ends, len(data)]


def transformed(text: bytes, h: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output."""
    data = np.frombuffer(text, np.uint8)
    ends = unit_ends(data)
    n = len(ends)
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    index = Exceptions(data)
    a_char, b_char = index.char_of(a), index.char_of(b)
    a, b = index.byte_of(a_char), index.byte_of(b_char)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < spm_rate
    parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)
    return n, "spm" if spm else "psm", a_char, b_char - a_char, a, b - a, b"".join(parts)


_NAMES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


def _transform(rate: int, spm_rate: int):
    def send(ids, rows):
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(cols[6], pa.binary()).cast(pa.string(), safe=False)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _NAMES.split(", ")])

    def run(batches):
        for b in batches:
            ids, rows, size = [], [], 0
            hs = zip(*(b.column(k).to_pylist() for k in range(2, 6)))
            for doc, text, h in zip(b.column(0).to_pylist(), b.column(1), hs):
                ids.append(doc)
                rows.append(transformed(text.as_py() or b"", h, rate, spm_rate))
                size += len(rows[-1][6])
                if len(rows) >= ROWS or size >= BYTES:
                    yield send(ids, rows)
                    ids, rows, size = [], [], 0
            if rows:
                yield send(ids, rows)

    return run


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) transformed; see the module's text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.sha2(key, 256).alias("h"))
    numbers = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return digest.select("doc_id", "text", *numbers).mapInArrow(_transform(rate, spm_rate), _NAMES)


def restored(output: Column, form: Column) -> Column:
    """The text again. A text with marks in it is plain, so the three marks cut an output of the other forms."""
    p = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    pieces = F.when(form == "psm", F.array(F.get(p, 1), F.get(p, 3), F.get(p, 2))).otherwise(F.array(F.get(p, 2), F.get(p, 3), F.get(p, 1)))
    return F.when(form == "plain", output).otherwise(F.array_join(pieces, ""))
