"""Order MinHash fingerprints, sensitive to edit distance.

A text's elements are windows of tokens numbered by occurrence, so that a
repeated window counts each time.  Tokens are words; a word of over
``LONG`` bytes is cut where two neighbouring bytes say so, so that an edit in a
text without white space changes the tokens around it and no others.  For each of
the sketch's hash functions the elements with the least hashes are selected, put
back in text order and hashed as a tuple.  Two texts' likeness is the share of
equal tuples: it falls both with other content and with another order.

All hashes are modulo 2**64.  ``mix(x)`` xors x with itself shifted right by 32,
multiplies by 0x9E3779B97F4A7C15, xors with itself shifted right by 29, multiplies
by 0xD6E8FEB86659FD93 and xors with itself shifted right by 32.  A byte b has the
value mix(b + 0x2545F4914F6CDD1D); a token's hash is the sum of its bytes' values
times the powers of 0x9FB21C651E98DF25, from power 0.

Defined cases: a null text is empty; texts without a word have the fingerprint
of all zeros, alike only to each other; texts with fewer tokens than a window are
one element; a very long text takes memory in proportion to its length, and its
elements are hashed in blocks; of equal least hashes the earlier element is
selected; equal texts have equal fingerprints.  Documents follow each other by
id, those without one first; repeated ids by a hash of the text, and rows that
are wholly equal in any order; an only document follows itself; an empty table
gives an empty result.  Only the id and text columns are read, so other columns
can't clash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.arrow import arrow_schema, rows_of, text_or_empty, to_batch
from gridloom.plans.durable import materialize

#: Bytes of a word that is not cut.
LONG = 16
#: Tokens in a window, elements in a tuple, tuples in a fingerprint (16 bits each).
WINDOW, CHOSEN, TUPLES = 2, 2, 64
#: Elements hashed at once.
BLOCK = 4_096
TOP = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd multipliers of the hash functions, 32 bits each, as columns."""
    x = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (x >> np.uint64(32)).astype(np.uint32)[:, None], x.astype(np.uint32)[:, None] | np.uint32(1)


#: Each byte's value in word hashes, the base of their powers, and what multiplies a window's words.
_BYTES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
_BASE = 0x9FB21C651E98DF25
_PLACES = (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Whether a long word is cut between two bytes, at index first * 256 + second; true for about a quarter of the pairs.
_CUT = _mix(np.arange(65536, dtype=np.uint64) + np.uint64(0x1D8E4E27C47D124F)) % np.uint64(4) == 0
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            tables = [np.full(1 << n.bit_length(), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))]
            for t in tables:
                t[0] = 1
            cls.up, cls.down = (np.multiply.accumulate(t) for t in tables)
        return cls.up[:n], cls.down[:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash for each token: differences of one running sum over the bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and (ends - starts).max() > LONG:
        cut = _CUT[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
        inside = np.zeros(len(data), np.int8)  # 1 at the first byte of a long word, -1 after its last: a running sum
        long = ends - starts > LONG
        inside[starts[long]] += 1
        after = ends[long]
        inside[after[after < len(data)]] -= 1
        word = np.cumsum(inside, dtype=np.int8) > 0
        at = np.flatnonzero(cut & word[:-1] & word[1:]) + 1
        starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    up, down = _Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def elements(text: str, window: int = WINDOW) -> np.ndarray:
    """Hashes of the windows with their occurrence numbers, in text order."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(window, len(h))
    n = len(h) - k + 1
    grams = h[:n] * np.uint64(_PLACES[0])
    for j in range(1, k):
        grams ^= grams >> np.uint64(33)
        grams += h[j : j + n] * np.uint64(_PLACES[j % 4])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    again = ordered[1:] == ordered[:-1]
    if again.any():
        place = np.arange(n)
        first = np.concatenate(([True], ~again))
        times = np.empty(n, np.uint64)
        times[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
        grams += times * np.uint64(0xE7037ED1A0B428DB)
    return _mix(grams)


def sketch(text: str, window: int = WINDOW, chosen: int = CHOSEN, tuples: int = TUPLES) -> np.ndarray | None:
    """The fingerprint's tuple hashes, or None for a text without words."""
    e = elements(text, window)
    if not len(e):
        return None
    mask, mult = _functions(tuples)
    short = (e >> np.uint64(32)).astype(np.uint32)
    least = np.full((tuples, chosen), TOP, np.uint32)
    place = np.full((tuples, chosen), -1, np.int64)
    row = np.arange(tuples)
    for at in range(0, len(e), BLOCK):
        h = short[None, at : at + BLOCK] ^ mask
        h *= mult
        for j in range(min(chosen, h.shape[1])):
            i = h.argmin(axis=1)
            v, p = h[row, i], i + at
            h[row, i] = TOP
            if at == 0:
                least[:, j], place[:, j] = v, p
                continue
            for c in range(chosen):  # insert into the ascending least ones
                swap = v < least[:, c]
                least[:, c], v = np.where(swap, v, least[:, c]), np.where(swap, least[:, c], v)
                place[:, c], p = np.where(swap, p, place[:, c]), np.where(swap, place[:, c], p)
    order = np.sort(np.where(place < 0, np.int64(2**62), place), axis=1)
    got = np.where(order < 2**62, e[np.minimum(order, len(e) - 1)], np.uint64(0))
    out = np.full(tuples, 0x5851F42D4C957F2D, np.uint64)
    for c in range(chosen):
        out = _mix(out + got[:, c])
    return (out >> np.uint64(48)).astype(np.uint16)


def as_bytes(found: np.ndarray | None, tuples: int = TUPLES) -> bytes:
    return bytes(2 * tuples) if found is None else found.astype(">u2").tobytes()


def as_text(found: np.ndarray | None, tuples: int = TUPLES) -> str:
    """Lowercase hex digits, four a tuple."""
    return as_bytes(found, tuples).hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and that to the next text.

    The edited text replaces a text's last half (rounded down) by as many code
    points from the start of the next document's; the first follows the last.

    Texts are dealt once, by ranges of (id, hash of the text, row), and each range
    is one sorted pass.  A range's last document needs the next range's first:
    both texts go to the result's table beside the range's rows, where one row a
    range meets its successor.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("k"), text_or_empty(text_col).alias("t"))
    keyed = docs.select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("row"))
    keys = ["k", "h", "row"]
    dealt = (keyed.repartitionByRange(parts, *keys) if parts else keyed.repartitionByRange(*keys)).sortWithinPartitions(*keys).select("k", "t")
    id_type = df.schema[id_col].dataType.simpleString()
    # Digests are bytes until the end, half the size of their digits.
    digests = ("edited_sha256", "fingerprint", "edited_fingerprint")
    results = f"`{id_col}` bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    # Rows of a range have its number; its first and last text stand in a row of their own.
    schema = f"{results}, part int, head string, last_k bigint, last_t string"
    target, result = arrow_schema(schema), arrow_schema(results)

    def pair(k, t, s, text, own):
        half = len(t) // 2
        edited = t[: len(t) - half] + text[:half]
        e = sketch(edited)
        return k, len(t), hashlib.sha256(edited.encode()).digest(), as_bytes(s), as_bytes(e), likeness(s, e), likeness(s, own)

    def run(batches):
        from pyspark import TaskContext

        part, head, held, out = TaskContext.get().partitionId(), None, None, []
        for key, text in rows_of(batches):
            own = sketch(text)
            if held is None:
                head = text
            else:
                out.append((*pair(*held, text, own), part, None, None, None))
                if len(out) >= 2048:
                    yield to_batch(out, target)
                    out = []
            held = key, text, own
        if held is not None:
            yield to_batch([*out, (*[None] * 7, part, head, held[0], held[1])], target)

    made = materialize(dealt.mapInArrow(run, schema), "sketches")
    ends = made.filter("head is not null").select("part", "head", "last_k", "last_t")
    order = Window.orderBy("part")  # a row a range
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = ends.select("last_k", "last_t", F.coalesce(F.lead("head").over(order), first).alias("next"))

    def close(batches):
        for k, t, text in rows_of(batches):
            yield to_batch([pair(k, t, sketch(t), text, sketch(text))], result)

    names = result.names
    whole = made.filter("head is null").select(*names).union(met.mapInArrow(close, results))
    return whole.withColumns({id_col: F.col(id_col).cast(id_type)} | {c: F.lower(F.hex(c)) for c in digests})
