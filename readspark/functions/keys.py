"""Context keys: whole numbers that pack the symbols before a position, and the position.

A generic key has the last ``ao`` bases (base 5) and ``qo`` qualities (base 94), newest
in the lowest digit, then ``pb`` bits of position. A light key has four base codes
(A, C, T, G) and qualities scaled to ``qm`` steps; an unknown base or a quality of 0
makes both digits 0. Digits before the first symbol are 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .alphabet import BASES, N_QUALITIES

_NAMES = """dummy
generic: 1 0 0, 2 0 0, 4 0 0, 8 0 0, 0 1 0, 0 2 0, 0 3 0, 0 0 2, 0 0 4, 0 0 8, 4 1 2, 1 3 2, 2 1 6, 6 2 0, 3 3 0, 8 0 4, 4 0 3, 4 0 6, 0 2 6, 0 3 3, 4 2 6, 5 2 4, 3 3 4
light: 4 1 2 16, 8 1 2 16, 8 0 0 1, 0 3 3 8, 0 3 3 16, 0 4 3 8, 0 4 3 16, 0 4 0 8, 0 4 0 16, 3 3 0 8, 3 3 0 16, 2 3 2 8, 0 4 2 8, 2 3 2 16, 0 4 2 16, 2 4 2 8, 4 3 4 16, 4 3 2 8, 0 3 0 4, 0 3 0 8, 0 3 0 16, 0 3 0 32, 4 4 4 8, 4 4 4 16, 5 4 4 16, 3 5 4 16"""


@dataclass(frozen=True)
class KeySpec:
    name: str
    ao: int = 0
    qo: int = 0
    pb: int = 0
    qm: int = 0

    @property
    def light(self) -> bool:
        return self.qm > 0

    @property
    def base_digits(self) -> int:
        return 4 if self.light else len(BASES)

    @property
    def quality_digits(self) -> int:
        return self.qm if self.light else N_QUALITIES

    @property
    def acid_bits(self) -> int:
        return (self.base_digits**self.ao - 1).bit_length()

    @property
    def bits(self) -> int:
        return (self.quality_digits**self.qo - 1).bit_length() + self.acid_bits + self.pb

    @property
    def domain(self) -> int:
        """How many keys there can be."""
        return 1 << self.bits

    def pack(self, acid_queue: Column, quality_queue: Column, pos: Column, n: Column) -> Column:
        """The key from both queues and the position's share of the read."""
        key = F.shiftleft(quality_queue.cast("long"), self.acid_bits).bitwiseOR(acid_queue.cast("long"))
        part = (pos.cast("long") * (1 << self.pb)) / n.cast("long")
        return F.shiftleft(key, self.pb).bitwiseOR(F.floor(part).cast("long")) if self.pb else key

    def digits(self, acid: Column, quality: Column) -> tuple[Column, Column]:
        """What a symbol adds to the queues."""
        if not self.light:
            return acid.cast("long"), quality.cast("long")
        known = (acid > 0) & (quality > 0)
        return F.when(known, acid.cast("long") - 1).otherwise(F.lit(0).cast("long")), F.when(known, F.floor(quality.cast("long") * self.qm / N_QUALITIES)).otherwise(F.lit(0)).cast("long")


def _queue(order: int, size: int, at: Callable[[int], Column]) -> Column:
    total = F.lit(0).cast("long")
    for j in range(1, order + 1):
        total = total + at(j) * F.lit(size ** (j - 1)).cast("long")
    return total


def key_array(spec: KeySpec, acids: Column, quals: Column) -> Column:
    """The key of each position of a read that is held as two arrays; no shuffle."""
    n = F.size(acids)

    def with_digits(d: Column) -> Column:
        at = lambda i, field: lambda j: F.coalesce(F.get(d[field], i - j), F.lit(0).cast("long"))
        return F.transform(acids, lambda _, i: spec.pack(_queue(spec.ao, spec.base_digits, at(i, "a")), _queue(spec.qo, spec.quality_digits, at(i, "q")), i, n))

    a = F.zip_with(acids, quals, lambda x, y: spec.digits(x, y)[0]) if spec.ao else F.array().cast("array<bigint>")
    q = F.zip_with(acids, quals, lambda x, y: spec.digits(x, y)[1]) if spec.qo else F.array().cast("array<bigint>")
    # One element, so that the digits are computed once for a read.
    return F.get(F.transform(F.array(F.struct(a.alias("a"), q.alias("q"))), with_digits), F.lit(0))


def key_column(spec: KeySpec, read_id: str = "read_id", pos: str = "pos", n: str = "n", acid: str = "acid", q: str = "q") -> Column:
    """The key over rows of single symbols, by lag windows."""
    before = Window.partitionBy(read_id).orderBy(pos)
    a, b = spec.digits(F.col(acid), F.col(q))
    at = lambda x: lambda j: F.lag(x, j).over(before)
    zero = lambda f: lambda j: F.coalesce(f(j), F.lit(0).cast("long"))
    return spec.pack(_queue(spec.ao, spec.base_digits, zero(at(a))), _queue(spec.qo, spec.quality_digits, zero(at(b))), F.col(pos), F.col(n))


def decode(spec: KeySpec, key: Column) -> Column:
    """A key as text: bases, qualities and share of the read, as in ``ACGTN, !0~, 3/4``; oldest symbol first."""
    pos = key.bitwiseAND(F.lit((1 << spec.pb) - 1))
    rest = F.shiftright(key, spec.pb)
    acid, quality = rest.bitwiseAND(F.lit((1 << spec.acid_bits) - 1)), F.shiftright(rest, spec.acid_bits)
    digit = lambda x, size, j: F.pmod(F.floor(x / F.lit(size**j)), F.lit(size))
    letters = BASES[1:] if spec.light else BASES
    bases = [F.substring(F.lit(letters), (digit(acid, spec.base_digits, j) + 1).cast("int"), F.lit(1)) for j in reversed(range(spec.ao))]
    quals = [F.char(digit(quality, spec.quality_digits, j) + 33) for j in reversed(range(spec.qo))]
    return F.concat_ws(", ", F.concat(F.lit(""), *bases), F.concat(F.lit(""), *quals), F.concat(pos.cast("string"), F.lit(f"/{1 << spec.pb}")))


def spec_of(name: str) -> KeySpec:
    if name == "dummy":
        return KeySpec(name)
    m = re.fullmatch(r"generic_ao(\d+)_qo(\d+)_pb(\d+)|light_ao(\d+)_qo(\d+)_pb(\d+)_qm(\d+)", name)
    if not m:
        raise ValueError(f"unknown key type {name}")
    return KeySpec(name, *[int(x) for x in m.groups() if x is not None])


def _all() -> dict[str, KeySpec]:
    dummy, generic, light = _NAMES.split("\n")
    names = [dummy]
    names += ["generic_ao{}_qo{}_pb{}".format(*x.split()) for x in generic.split(": ")[1].split(", ")]
    names += ["light_ao{}_qo{}_pb{}_qm{}".format(*x.split()) for x in light.split(": ")[1].split(", ")]
    return {x: spec_of(x) for x in names}


#: All 50 key types by name.
KEY_TYPES = _all()


def key_sql(spec: KeySpec) -> str:
    """The key as DuckDB SQL over rows (read_id, pos, n, acid, q), with the window ``w`` of a read."""
    if spec.light:
        known = "acid > 0 and q > 0"
        a, q = f"(case when {known} then acid - 1 else 0 end)", f"(case when {known} then q * {spec.qm} // 94 else 0 end)"
    else:
        a, q = "acid", "q"
    queue = lambda x, order, size: "(" + " + ".join(["0::bigint", *[f"lag({x}, {j}, 0) over w * {size ** (j - 1)}::bigint" for j in range(1, order + 1)]]) + ")"
    key = f"(({queue(q, spec.qo, spec.quality_digits)} << {spec.acid_bits}) | {queue(a, spec.ao, spec.base_digits)})"
    return f"(({key} << {spec.pb}) | (pos::bigint * {1 << spec.pb} // n))" if spec.pb else key
