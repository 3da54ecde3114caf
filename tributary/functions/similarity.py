"""Text similarity on built-in expressions.

Scores are whole numbers of thousandths, rounded half to even, so comparisons with
a threshold or a delta are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .text import squeeze

# A bigint holds the state of texts up to this many characters without overflow.
WORD = 62


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(squeeze(c), " ")), " ")


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def char_masks(c: Column) -> Column:
    """Map from a character of ``c`` to the bits of the places where it stands."""
    return bind(
        letters(c),
        lambda cs: F.map_from_entries(
            F.transform(
                F.array_distinct(cs),
                lambda ch: F.struct(
                    ch.alias("key"),
                    F.aggregate(
                        F.transform(
                            cs,
                            lambda x, i: F.when(x == ch, _bit(i)).otherwise(_zero()),
                        ),
                        _zero(),
                        lambda acc, bit: acc.bitwiseOR(bit),
                    ).alias("value"),
                ),
            )
        ),
    )


def lcs_with_masks(masks: Column, size: Column, other: Column) -> Column:
    """Length of the longest common subsequence, one bit operation per character.

    ``masks`` and ``size`` describe a text of at most ``WORD`` characters.
    """
    full = _bit(size) - 1
    steps = F.transform(
        letters(other),
        lambda ch: F.coalesce(F.try_element_at(masks, ch), _zero()),
    )
    left = F.aggregate(
        steps,
        full,
        lambda v, m: (
            (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)
        ),
    )
    return size - F.bit_count(left).cast("int")


def _lcs_table(a: Column, b: Column) -> Column:
    """The same length by the row-by-row table, for texts of any size."""

    def next_row(row: Column, ch: Column, chars: Column) -> Column:
        best = F.transform(
            chars,
            lambda x, j: F.greatest(
                F.get(row, j + 1), F.when(x == ch, F.get(row, j) + 1).otherwise(F.lit(0))
            ),
        )
        return F.aggregate(
            best,
            F.array(F.lit(0)),
            lambda acc, t: F.array_append(acc, F.greatest(F.element_at(acc, -1), t)),
        )

    return bind(
        letters(a),
        lambda chars: F.element_at(
            F.aggregate(
                letters(b),
                F.array_repeat(F.lit(0), F.size(chars) + 1),
                lambda row, ch: next_row(row, ch, chars),
            ),
            -1,
        ),
    )


def lcs(a: Column, b: Column) -> Column:
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
        .when(F.length(a) <= WORD, lcs_with_masks(char_masks(a), F.length(a), b))
        .when(F.length(b) <= WORD, lcs_with_masks(char_masks(b), F.length(b), a))
        .otherwise(_lcs_table(a, b))
    )


# Characters of one word of state in numpy: the bit above takes the carry.
NARROW = 63
# Pairs that are compared at once: bounds memory only.
PAIRS = 1 << 16


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, one bit operation per character over all pairs."""
    out = np.zeros(len(a), np.int64)
    # Texts of like sizes go together, the state follows the shorter one.
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        longest = max(1, len(pairs[order[at]][1]))
        mine = np.array(order[at : at + max(1, PAIRS // max(1, longest // NARROW))], np.int64)
        at += len(mine)
        out[mine] = _common([pairs[i][0] for i in mine], [pairs[i][1] for i in mine])
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, a row a text, -1 behind its end; sizes)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, sizes


def _common(a: list[str], b: list[str]) -> np.ndarray:
    (left, sizes), (right, _) = _codes(a), _codes(b)
    words = max(1, -(-left.shape[1] // NARROW))
    full = [(np.uint64(1) << np.clip(sizes - w * NARROW, 0, NARROW).astype(np.uint64)) - np.uint64(1) for w in range(words)]
    state = [f.copy() for f in full]
    for j in range(right.shape[1]):
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            mask = np.zeros(len(a), np.uint64)
            for i in range(w * NARROW, min((w + 1) * NARROW, left.shape[1])):
                mask |= ((left[:, i] == right[:, j]) & (left[:, i] >= 0)).astype(np.uint64) << np.uint64(i - w * NARROW)
            hit = state[w] & mask
            added = state[w] + hit + carry
            carry = added >> np.uint64(NARROW)
            state[w] = (added | (state[w] - hit)) & full[w]
    return sizes - sum(np.bitwise_count(x).astype(np.int64) for x in state)


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts, over whole batches; null for a null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = common_lengths(a[known].tolist(), b[known].tolist())
    return pd.Series(out).astype("Int32")


def common_with(texts: list[str]) -> Callable[[Column], Column]:
    """A function from a text to the lengths of its longest common subsequences with some fixed ones, in their order."""
    letters_ = sorted(set("".join(texts)))

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        codes, sizes = _codes(values[known].tolist())
        words = max(1, -(-codes.shape[1] // NARROW))
        full = [(np.uint64(1) << np.clip(sizes - w * NARROW, 0, NARROW).astype(np.uint64)) - np.uint64(1) for w in range(words)]
        masks = {}
        for ch in letters_:
            at = (codes == ord(ch)).astype(np.uint64)
            masks[ch] = [
                sum((at[:, i] << np.uint64(i - w * NARROW) for i in range(w * NARROW, min((w + 1) * NARROW, codes.shape[1]))), np.zeros(len(sizes), np.uint64))
                for w in range(words)
            ]
        found = np.zeros((len(sizes), len(texts)), np.int32)
        for t, text in enumerate(texts):
            state = [f.copy() for f in full]
            for ch in text:
                carry = np.uint64(0)
                for w in range(words):
                    hit = state[w] & masks[ch][w]
                    added = state[w] + hit + carry
                    carry = added >> np.uint64(NARROW)
                    state[w] = (added | (state[w] - hit)) & full[w]
            found[:, t] = sizes - sum(np.bitwise_count(x).astype(np.int64) for x in state)
        out = np.full(len(values), None, object)
        for i, row in zip(np.flatnonzero(known), found):
            out[i] = row
        return pd.Series(out)

    return run


def thousandths(common: Column, total: Column) -> Column:
    """2 * common / total in thousandths, half to even; two empty texts are equal."""
    up = common.cast("bigint") * 2000
    low = F.floor(up / total)
    rest = up - low * total
    step = F.when((rest * 2 > total) | ((rest * 2 == total) & (low % 2 == 1)), 1).otherwise(0)
    return F.when(total == 0, F.lit(1000)).otherwise(low + step).cast("int")


def token_sort_score(a: Column, b: Column) -> Column:
    """Similarity of two texts with their words sorted; case matters."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    return thousandths(common_length(x, y), F.length(x) + F.length(y))


def as_score(per_mille: Column) -> Column:
    return per_mille.cast("double") / 1000
