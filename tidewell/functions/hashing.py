"""Keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public MurmurHash3 (x86, 32 bit) constants and the seed
# that the Scala standard library uses for strings.
STRING_SEED = 0xF7CA7FD2
BLOCK_C1 = 0xCC9E2D51
BLOCK_C2 = 0x1B873593
BLOCK_ADD = 0xE6546B64
FINAL_M1 = 0x85EBCA6B
FINAL_M2 = 0xC2B2AE35

_LOW32 = f"{0xFFFFFFFF}L"


def _let(value: str, body: str) -> str:
    """SQL for ``body`` with ``v`` bound to the value.

    An expression used twice is computed twice; a lambda variable is not.
    Without this the nested steps below would double at every level.
    """
    return f"transform(array({value}), v -> {body})[0]"


def _times(value: str, factor: int) -> str:
    """32-bit product; split in halves because bigint overflow is an error in ANSI mode."""
    low, high = f"(v & 65535L) * {factor}L", f"shiftleft((shiftright(v, 16) * {factor}L) & 65535L, 16)"
    return _let(value, f"({low} + {high}) & {_LOW32}")


def _rotate(value: str, bits: int) -> str:
    return _let(value, f"(shiftleft(v, {bits}) | shiftright(v, {32 - bits})) & {_LOW32}")


def _spread(value: str, bits: int) -> str:
    return _let(value, f"v ^ shiftright(v, {bits})")


def _scramble(block: str) -> str:
    return _times(_rotate(_times(block, BLOCK_C1), 15), BLOCK_C2)


def _mix(state: str, block: str) -> str:
    return f"({_times(_rotate(f'{state} ^ {_scramble(block)}', 13), 5)} + {BLOCK_ADD}L) & {_LOW32}"


def _finish(state: str) -> str:
    mixed = _spread(_times(_spread(_times(_spread(state, 16), FINAL_M1), 13), FINAL_M2), 16)
    return _let(mixed, f"if(v >= {2**31}L, v - {2**32}L, v)")


def _string_hash_sql() -> str:
    """Lambda from UTF-16 text in hex (4 digits a unit, 8 a pair) to its hash."""
    pairs, units = "shiftright(length(d), 3)", "shiftright(length(d), 2)"
    at = f"if({pairs} > 0, sequence(0, {pairs} - 1), cast(array() as array<int>))"
    blocks = f"transform({at}, i -> cast(conv(substring(d, i * 8 + 1, 8), 16, 10) as bigint))"
    rest = f"cast(conv(substring(d, {pairs} * 8 + 1, 4), 16, 10) as bigint)"
    tail = f"if({units} % 2 = 1, {_scramble(rest)}, 0L)"
    body = f"aggregate({blocks}, {STRING_SEED}L, (h, b) -> {_mix('h', 'b')})"
    return f"d -> {_finish(f'{body} ^ {tail} ^ cast({units} as bigint)')}"


def string_hash(text: Column) -> Column:
    """Signed 32-bit MurmurHash3 over pairs of UTF-16 units, as a bigint.

    Spark's own ``hash`` works on UTF-8 bytes with another seed and gives other
    numbers, so the steps are written out with higher-order functions.
    """
    digits = F.hex(F.encode(text, "UTF-16BE"))
    return F.when(
        text.isNotNull(), F.call_function("transform", F.array(digits), F.expr(_string_hash_sql()))[0]
    )


def in_modulus(text: Column, divisor: Column) -> Column:
    """True when the divisor is positive and divides the hash of the text."""
    divisor = F.coalesce(divisor.cast("bigint"), F.lit(0))
    return F.when(divisor > 0, F.try_mod(string_hash(text), divisor) == 0).otherwise(F.lit(False))


def request_id(
    dataset: Column, tag: Column, requested_by: Column, channel: Column, day: Column, kind: Column
) -> Column:
    """Upper-case MD5 of the parts joined by ``|``; a null ``kind`` is left out."""
    blank = F.lit("")
    parts = [F.coalesce(part, blank) for part in (dataset, tag, requested_by, channel)]
    return F.upper(F.md5(F.concat_ws("|", *parts, F.date_format(day, "yyyy-MM-dd"), kind).cast("binary")))


def lookup_key(device: Column, user: Column, url: Column, producer: Column) -> Column:
    """``device:user:url:producer`` with ``NA`` for what is missing."""
    return F.concat_ws(":", *[F.coalesce(part, F.lit("NA")) for part in (device, user, url, producer)])
