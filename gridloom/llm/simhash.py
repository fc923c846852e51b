"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut in two segments of 32 bits, and each segment has a table
that is keyed by its value.  A fingerprint probes the tables with the small
Hamming ball around each of its segments, fetches what stands under those
values, and complete distances decide.  Two fingerprints within r bits differ in
at most r // 2 bits of the first segment or fewer of the second, so none is lost.

A large group of near copies can put very many fingerprints under one segment
value.  Such a hot key is not paired: its fingerprints are indexed again by the
halves of their other segment, with the bits that may still differ, and so on;
below the third level only 8 bits are free, which bounds a key by 256
fingerprints whatever the data's skew.  Nothing is capped: each level is exact.

Defined cases: a null text or one without words has fingerprint zero and is
linked like any other; a very long text takes memory in proportion to its
length, and its shingles are summed up in blocks; copies share a fingerprint and
are never paired; at a tie of bits (set in exactly half the shingles) the bit is
0; a null id belongs to its fingerprint's component and never names it; repeated
rows stay; an empty table gives an empty result.  Only the id and text are read,
so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import map_rows
from gridloom.llm.components import components
from gridloom.plans.durable import materialize

SEED = 42
#: Fingerprints under a key beyond which it is indexed again.
BUCKET = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are touched
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
        hashes = np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The id and ``fp bigint`` of every row, over shingles of ``width`` words."""
    id_type = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), lambda key, text: [(key, fingerprint(text, width))], f"`{id_col}` {id_type}, fp bigint")


def _segments(prints: DataFrame, width: int, probe: bool) -> DataFrame:
    """``key, fp, at, left``: a row for each of the two segments of ``width`` bits from bit ``at``.

    ``prints`` has the key so far, the fingerprint, the place of the bits that no
    segment has used yet and the bits that may still differ.  The table's rows
    hold a segment's own value; a probe's rows the values of its ball.  With b
    bits left one segment differs in b // 2 at most, or the other in fewer:
    the first one's ball has radius b // 2, the second one's (b - 1) // 2.
    """
    value = lambda h: F.expr(f"shiftrightunsigned(fp, at + {h * width}) & {(1 << width) - 1}L")
    # The place of the bits left over: above the first segment, below the second.
    row = lambda h, v, d: F.struct(F.lit(h).alias("h"), v.alias("v"), (F.col("at") + (width if h == 0 else 0)).alias("at"), (F.col("left") - d).alias("left"))
    parts = []
    for h in (0, 1):
        own = F.array(row(h, value(h), 0))
        if not probe:
            parts.append(own)
            continue
        ball = F.concat(own, F.array(*[row(h, value(h).bitwiseXOR(F.lit(1 << i).cast("bigint")), 1) for i in range(width)]))
        parts.append(F.when(F.col("left") >= 2 + h, ball).when(F.col("left") >= h, own).otherwise(F.slice(own, 1, 0)))
    cut = prints.select("key", "fp", F.explode(F.concat(*parts)).alias("s"))
    return cut.select(F.xxhash64("key", "s.h", "s.v").alias("key"), "fp", F.col("s.at").alias("at"), F.col("s.left").alias("left"))


def links(distinct: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``a, b`` with a < b: all links between different fingerprints of column fp at most ``max_bits`` (0 to 3) apart."""
    if max_bits not in range(4):
        raise ValueError("balls of radius 1 in each segment find at most 3 differing bits")
    if not max_bits:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    start = distinct.select(F.lit(0).cast("bigint").alias("key"), "fp", F.lit(0).alias("at"), F.lit(max_bits).alias("left"))
    table, probes, found = start, start, None
    for width in (32, 16, 8):
        table, probes = _segments(table, width, False), _segments(probes, width, True)
        # Below the last segments only 8 bits are free: a key holds at most 256 fingerprints.
        hot = materialize(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"), "hot") if width > 8 else None
        more = hot is not None and not hot.isEmpty()
        fetched = (table.join(hot, "key", "left_anti") if more else table).select("key", F.col("fp").alias("b"))
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        met = probes.select("key", F.col("fp").alias("a")).join(fetched, "key").filter(near).select("a", "b")
        found = met if found is None else found.union(met)
        if not more:
            break
        table, probes = table.join(hot, "key", "left_semi"), probes.join(hot, "key", "left_semi")
    return found.distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, max_bits: int, width: int) -> DataFrame:
    """The id, ``fp``, ``hash`` of the text and ``component_id`` of every row."""
    id_type = df.schema[id_col].dataType.simpleString()
    read = df.select(id_col, text_col, F.xxhash64(text_col).alias("hash"))
    found = map_rows(read, lambda key, text, h: [(key, fingerprint(text, width), h)], f"`{id_col}` {id_type}, fp bigint, hash bigint")
    prints = materialize(found, "fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    if not max_bits:
        return prints.join(least.withColumnRenamed("least", "component_id"), "fp")
    roots = components(links(least.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    rooted = least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, width: int = 3) -> DataFrame:
    """The id, ``fp`` and ``component_id`` of every row; the component's id is the smallest id in it."""
    return _grouped(df, id_col, text_col, max_bits, width).select(id_col, "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: of each component the row whose id names it.

    Rows without an id stay only if no row of their component has one.  Rows are
    told apart by id and text: of rows that repeat both, all stay.
    """
    named = _grouped(df, id_col, text_col, max_bits, width).filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = named.select(F.col(id_col).alias("_kept"), F.col("hash").alias("_hash")).distinct()
    return df.join(kept, df[id_col].eqNullSafe(kept["_kept"]) & (F.xxhash64(df[text_col]) == kept["_hash"]), "left_semi")


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


__all__ = ["as_hex", "fingerprint", "fingerprints", "links", "near_duplicates", "representatives"]
