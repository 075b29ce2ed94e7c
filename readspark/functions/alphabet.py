"""Codes of bases and qualities, and their text forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code of a base is its place here.
BASES = "NACTG"
N_BASES, N_QUALITIES, FIRST_QUALITY = 5, 94, 33
SIZES = {"acids": N_BASES, "q_scores": N_QUALITIES}


def base_codes(text: Column) -> Column:
    """Codes of a string of bases; any other character is an error that names it."""
    bad = F.regexp_extract(text, f"([^{BASES}])", 1)
    code = lambda c: (F.instr(F.lit(BASES), c) - 1).cast("int")
    checked = F.when(bad != "", F.raise_error(F.concat(F.lit("Invalid acid: "), bad)).cast("string")).otherwise(text)
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(checked, ""), code))


def _text(codes: pa.Array, letters: bytes) -> pa.Array:
    """Strings of the letters of codes."""
    offsets = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
    values = np.frombuffer(letters, np.uint8)[codes.flatten().to_numpy(zero_copy_only=False)]
    out = pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())).cast(pa.string())
    return pc.if_else(codes.is_valid(), out, pa.scalar(None, pa.string())) if codes.null_count else out


def _base_text(codes: pa.Array) -> pa.Array:
    return _text(codes, BASES.encode())


def _quality_text(codes: pa.Array) -> pa.Array:
    return _text(codes, bytes(range(FIRST_QUALITY, FIRST_QUALITY + N_QUALITIES)))


def base_text(codes: Column) -> Column:
    return F.arrow_udf(_base_text, "string")(codes)


def quality_codes(text: Column) -> Column:
    code = lambda c: (F.ascii(c) - FIRST_QUALITY).cast("int")
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), code))


def quality_text(codes: Column) -> Column:
    return F.arrow_udf(_quality_text, "string")(codes)


def fastq_size(identifier: Column, n: Column) -> Column:
    """Bytes of a record: the identifier, both strings, two marks and four line ends."""
    return (F.octet_length(identifier) + 2 * n + 6).cast("long")
