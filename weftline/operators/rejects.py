"""Rows that fail to parse: valid records come out typed, the others with a reason.

Method: structural indexing.  Each batch of records becomes one byte buffer.  numpy masks
mark the quotes; the parity of the quotes before a byte, counted from its record's start,
says whether it lies inside quotes; so delimiters and the borders of fields are found for
all records at once, without a loop over rows or characters.  Count and type checks then
give each record to the valid or the rejected ones.

Defined cases: a null or empty record has one field and is rejected with `column_count`;
a line break belongs to its record wherever it stands (one element holds one record); blank typed fields of a valid record
come out null; other columns of the input, whatever their names, are left out of the
result unless named in `keep`; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits and commas after a digit, then optionally a point and digits.
PLAIN_NUMBER = r"^[0-9][0-9,]*(\.[0-9]+)?$"
COLUMNS = ("cpse", "material_code", "description", "uom", "category_hint", "hsn_code", "last_rate_inr")

_QUOTE, _COMMA = 34, 44


def index_records(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(broken, fields per record, positions of delimiters, record of each delimiter).

    buffer: the bytes of all records, one after the other; starts and ends: of each record.
    """
    n = len(starts)
    size = len(buffer)
    quotes = buffer == _QUOTE
    before = np.zeros(size + 1, np.int64)
    np.cumsum(quotes, out=before[1:])
    owner = np.repeat(np.arange(n), ends - starts)
    inside = ((before[:-1] - before[starts][owner]) & 1).astype(bool) if size else np.zeros(0, bool)
    delimiter = (buffer == _COMMA) & ~inside
    at = np.flatnonzero(delimiter)
    fields = np.bincount(owner[at], minlength=n) + 1
    broken = ((before[ends] - before[starts]) & 1).astype(bool)  # a quote stays open
    q = np.flatnonzero(quotes)
    if len(q):
        own = owner[q]
        first, last = q == starts[own], q == ends[own] - 1
        prev, nxt = np.maximum(q - 1, 0), np.minimum(q + 1, size - 1)
        opens = ~inside[q]
        # an opening quote stands at a field's start, or doubles the quote before it
        bad_open = opens & ~(first | delimiter[prev] | quotes[prev])
        # a closing quote stands at a field's end, or is doubled by the quote after it
        bad_close = ~opens & ~(last | quotes[nxt] | ((buffer[nxt] == _COMMA) & ~last))
        broken[own[bad_open | bad_close]] = True
    return broken, fields, at, owner[at]


def field_array(buffer: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, total: int) -> pa.Array:
    """The slices buffer[lo:hi] as an array of strings at `rows` of `total`, null elsewhere; outer quotes off, doubled ones halved."""
    quoted = (hi > lo) & (buffer[np.minimum(lo, max(len(buffer) - 1, 0))] == _QUOTE) if len(buffer) else np.zeros(len(lo), bool)
    lo, hi = lo + quoted, hi - quoted
    size = hi - lo
    length = np.zeros(total, np.int64)
    length[rows] = size
    offsets = np.zeros(total + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    # byte j of the result is byte j - (start in the result) + lo of the buffer
    data = buffer[np.repeat(lo - offsets[rows], size) + np.arange(offsets[-1])]
    valid = np.zeros(total, bool)
    valid[rows] = True
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.large_string(), total, [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    # a sound field holds quotes only if it is quoted, and then doubled
    if quoted.any() and (data == _QUOTE).any():
        out = pc.replace_substring(out, '""', '"')
    return out.cast(pa.string())


def _split(batches: Iterator[pa.RecordBatch], line: str, width: int, wanted: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at_line = batch.schema.get_field_index(line)
        texts = batch.column(at_line)
        texts = texts.cast(pa.string()).fill_null("")
        if len(texts) == 0:
            continue
        texts = pa.concat_arrays([texts])  # offsets start at zero
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        base = offsets[0]
        buffer, starts, ends = whole[base : offsets[-1]], offsets[:-1] - base, offsets[1:] - base
        broken, fields, at, own = index_records(buffer, starts, ends)
        good = ~broken & (fields == width)
        # borders of the fields of the well-formed records, as a matrix
        cut = at[good[own]].reshape(-1, width - 1)
        rows = np.flatnonzero(good)
        lo = np.concatenate([starts[rows, None], cut + 1], axis=1)
        hi = np.concatenate([cut, ends[rows, None]], axis=1)
        out = [field_array(buffer, lo[:, k], hi[:, k], rows, len(texts)) for k in wanted]
        why = np.where(broken, "broken_quoting", np.where(fields != width, "column_count", ""))
        reason = pa.array(why.astype(object), pa.string(), mask=why == "")
        kept = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if k != at_line]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), reason, *out], names=[*(n for n, _ in kept), "__reason", *(f"__f{k}" for k in wanted)])


def split_records(df: DataFrame, line: str = "raw_line", columns: tuple[str, ...] = COLUMNS, keep: tuple[str, ...] = ("line_id",), wanted: tuple[str, ...] | None = None) -> DataFrame:
    """`keep`, `reason` (null: structurally sound) and the wanted fields (all, unless named) as strings."""
    wanted = columns if wanted is None else wanted
    which = [columns.index(c) for c in wanted]
    src = df.select(*keep, F.col(line).cast("string").alias("__line"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__line"), "__reason string", *(f"__f{k} string" for k in which)])
    got = src.mapInArrow(lambda it: _split(it, "__line", len(columns), which), schema)
    return got.select(*keep, F.col("__reason").alias("reason"), *(F.col(f"__f{k}").alias(c) for k, c in zip(which, wanted)))


def spaces(c: Column) -> Column:
    return F.trim(c)


CHECKED = ("material_code", "description", "last_rate_inr")


def check_materials(df: DataFrame, keep: tuple[str, ...] = ("line_id",), wanted: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The catalogue's type checks after the structural ones, in their fixed order; reason is null for valid rows."""
    s = split_records(df, keep=keep, wanted=wanted)
    code, rate = spaces(F.col("material_code")), spaces(F.col("last_rate_inr"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~code.rlike(r"^[A-Za-z0-9./-]+$"), "bad_code")
        .when(~F.col("description").rlike(r"\p{L}"), "bad_description")
        .when(~(rate.isin("", "N/A", "-") | rate.rlike(PLAIN_NUMBER)), "bad_rate")
    )
    return s.withColumn("reason", reason)


def valid_rows(df: DataFrame, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The valid records, typed: blanks become null, the rate a decimal."""
    s = check_materials(df, keep).filter(F.col("reason").isNull())
    text = [F.nullif(spaces(F.col(c)), F.lit("")).alias(c) for c in COLUMNS[:-1]]
    return s.select(*keep, *text, F.expr("try_cast(regexp_replace(trim(last_rate_inr), ',', '') AS decimal(38,6))").alias("last_rate_inr"))


def rejected_rows(df: DataFrame, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    return check_materials(df, keep, CHECKED).filter(F.col("reason").isNotNull()).select(*keep, "reason")
