"""Integer codes as column expressions: lengths, bit strings, packed cells.

Gamma code of x (x >= 1): as many zeros as x has bits after the first, then x in binary.
Delta code: the gamma code of the bit length, then x without its leading one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Simple-9 modes, by selector: values in a word, bits of each (fixed values).
S9_COUNTS = (28, 14, 9, 7, 5, 4, 3, 2, 1)
S9_BITS = (1, 2, 3, 4, 5, 7, 9, 14, 28)
S9_LIMIT = 1 << 28


def bit_length(x: Column) -> Column:
    return F.length(F.bin(x)).cast("long")


def gamma_length(x: Column) -> Column:
    return 2 * bit_length(x) - 1


def gamma_bits(x: Column) -> Column:
    """The gamma code as a string of 0 and 1."""
    return F.concat(F.repeat(F.lit("0"), F.length(F.bin(x)) - 1), F.bin(x))


def delta_length(x: Column) -> Column:
    return gamma_length(bit_length(x)) + bit_length(x) - 1


def delta_bits(x: Column) -> Column:
    """The delta code as a string of 0 and 1."""
    return F.concat(gamma_bits(bit_length(x)), F.substr(F.bin(x), F.lit(2)))


def pack_cell(obj_id: Column, pos: Column, n: int) -> Column:
    """Object and position in one number, always 64-bit."""
    return obj_id.cast("long") * n + pos.cast("long")


def cell_position(cell: Column, n: int) -> Column:
    return F.pmod(cell, F.lit(n).cast("long"))


def cell_object(cell: Column, n: int) -> Column:
    return F.call_function("div", cell - cell_position(cell, n), F.lit(n).cast("long"))


def s9_unpack(words: Column, n_values: Column) -> Column:
    """The first ``n_values`` values of an array of Simple-9 words (32-bit integers: four
    selector bits, then values from the high end)."""
    counts, bits = (F.array(*[F.lit(x) for x in t]) for t in (S9_COUNTS, S9_BITS))

    def one(word: Column) -> Column:
        mode = F.shiftrightunsigned(word, 28) + 1
        width = F.element_at(bits, mode)
        mask = (F.pow(F.lit(2), width) - 1).cast("int")
        # a shift amount must be a literal; division by a power of two moves the field down
        payload = word.bitwiseAND(F.lit((1 << 28) - 1)).cast("long")
        return F.transform(F.sequence(F.lit(1), F.element_at(counts, mode)), lambda i: F.floor(payload / F.pow(F.lit(2), 28 - width * i)).cast("long").bitwiseAND(mask.cast("long")))

    return F.slice(F.flatten(F.transform(words, one)), F.lit(1), n_values.cast("int"))


def s9_value(words: Column, n_values: Column, i: Column) -> Column:
    """The value at place ``i`` from 0, or -1 past the end."""
    return F.coalesce(F.try_element_at(s9_unpack(words, n_values), (i + 1).cast("int")), F.lit(-1).cast("long"))
