"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text wherever it meets the block size's trigger; each piece becomes one letter of a
signature, so an edit changes few letters. Block sizes double; the length sets the one at which 33 to 64 pieces are expected, more
than 64 pieces the next that gives no more, too few the one below where it gives no more than 64; signatures are kept at that size
and the next two, and each covers the whole text. Two fingerprints are compared by edit distance at a block size that both have;
one letter tells too little. A finest signature of fewer than eight letters is followed by a digest, so that equal fingerprints mean
equal texts there. Rolling hashes of a whole text are computed at once with numpy, pieces are hashed with CRC-32, and the edit
distance runs bit-parallel.

Every document is also compared with the next one in descending doc_id, which needs an order over all documents. They are dealt
into as many ranges of doc_id as there are shuffle partitions, at approximate quantiles of the ids; an id that spans several ranges is
divided by its texts' hashes. A task reads its range in order, one document after the other, so a range of any size needs the memory
of two documents; texts are compressed, shuffled and read once. Only the first and last row of each range go on to meet each other.

Defined results: a null text is empty; an empty text has the fingerprint ``1:::``; equal texts, empty ones included, have likeness
1; null doc_ids come last, repeated ones are ordered by text hash and text; a single document is its own next; an empty table gives no
rows; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import carried, materialize, partitions, table, text_of

PIECES = 64
#: Block sizes of a fingerprint.
SIZES = 3
WINDOW = 7
#: Largest block size, as a power of two: all sizes of a fingerprint fit the hash.
_MAX_BITS = 33 - SIZES
#: Signatures of fewer letters come with a digest of the text.
_SHORT = 8
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_MIX = np.array([0x9E3779B1 * (i * i * 2654435761 + 12345 + i) & 0xFFFFFFFF | 1 for i in range(WINDOW)], dtype=np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """For each position a 32-bit hash of the last seven bytes."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32) + np.uint32(1)
    h = b * _MIX[0]
    for k in range(1, WINDOW):
        h[k:] += b[:-k] * _MIX[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _signature(data: bytes, cuts: np.ndarray) -> str:
    out, at = [], 0
    for end in cuts.tolist():
        out.append(_LETTERS[zlib.crc32(data[at : end + 1]) >> 13 & 63])
        at = end + 1
    if at < len(data):
        out.append(_LETTERS[zlib.crc32(data[at:]) >> 13 & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice:at four times the block size``, and ``:digest`` where the first has few letters.
    Cuts at a size are among those at half of it."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "1:::"
    h = rolling(data)
    cuts = lambda bits, at: at[(h[at] & np.uint32((1 << bits) - 1)) == 0]
    pieces = lambda at: len(at) + (not len(at) or int(at[-1]) + 1 < len(data))
    bits = ((len(data) - 1) // PIECES).bit_length()
    at = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0)
    while pieces(at) > PIECES and bits < _MAX_BITS:
        bits += 1
        at = cuts(bits, at)
    if pieces(at) > PIECES:
        at = at[:0]
    elif bits and len(at) < PIECES // 2:
        finer = np.flatnonzero((h & np.uint32((1 << bits - 1) - 1)) == 0)
        if pieces(finer) <= PIECES:
            bits, at = bits - 1, finer
    parts = [_signature(data, cuts(bits + up, at)) for up in range(SIZES)]
    if len(parts[0]) < _SHORT:
        parts.append(hashlib.sha256(data).hexdigest()[:16])
    return f"{1 << bits}:" + ":".join(parts)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of two integers."""
    if not a or not b:
        return len(a) + len(b)
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        eq = seen.get(c, 0)
        x = eq | down
        diag = ((eq & up) + up ^ up) | eq
        right, left = down | ~(diag | up) & full, up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 | 1
        up, down = (left << 1 | ~(x | right)) & full, right & x & full
    return score


def _alike(a: str, b: str) -> float:
    k = 4 if min(len(a), len(b)) >= 16 else 2
    if min(len(a), len(b)) < k:
        return 0.0
    if a == b:
        return 1.0
    grams = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not any(b[i : i + k] in grams for i in range(len(b) - k + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 where no block size is common or no run of letters is."""
    if x == y:
        return 1.0
    (s, *a), (t, *b) = x.split(":")[: SIZES + 1], y.split(":")[: SIZES + 1]
    s, t = int(s), int(t)
    return max((_alike(p, q) for i, p in enumerate(a) for j, q in enumerate(b) if s << i == t << j), default=0.0)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compress texts for the way to their ranges."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield b.assign(text=[pack(t.encode("utf-8", "surrogatepass")) for t in b["text"]])


RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A row of a range's end: which end, the range, the whole text compressed.
_EDGE = "edge string, range int, text binary"


def _compared(doc: str | None, text: str, print_: str, next_text: str, next_print: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    changed = fingerprint(edited)
    return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, next_print)


def _unpacker():
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return lambda x: unpack(x).decode("utf-8", "surrogatepass")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one or more ranges, each in descending order: every row with its next one; of each range the first and the last."""
    read = _unpacker()
    names = [x.split()[0] for x in f"{RESULT}, {_EDGE}".split(", ")]
    none = (None,) * 6
    before = None  # range, packed text, and what _compared takes of a row
    for b in batches:
        rows = []
        for doc, r, packed in zip(b["doc_id"], b["_range"], b["text"], strict=True):
            text = read(packed)
            now = (r, packed, doc, text, fingerprint(text))
            if before is None or before[0] != r:
                if before is not None:
                    rows.append((before[2], None, None, before[4], *none[3:], "last", before[0], before[1]))
                rows.append((doc, None, None, now[4], *none[3:], "first", r, packed))
            else:
                rows.append((*_compared(*before[2:], text, now[4]), None, None, None))
            before = now
        yield pd.DataFrame(rows, columns=names)
    if before is not None:
        yield pd.DataFrame([(before[2], None, None, before[4], *none[3:], "last", before[0], before[1])], columns=names)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read = _unpacker()
    for b in batches:
        rows = [_compared(d, read(t), f, read(u), g) for d, t, f, u, g in zip(b["doc_id"], b["text"], b["fingerprint"], b["next_text"], b["next_print"], strict=True)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])


def range_number(docs: DataFrame, key: str, tie: str, parts: int) -> Column:
    """The range, 0 to ``parts`` - 1, of a row by the long column ``key``, nulls lowest; where a key spans several ranges, by ``tie``,
    a hash. The bounds are approximate quantiles, found by halving in log2(parts) steps."""
    bounds = [int(x) for x in docs.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    if not bounds:
        return F.lit(0)
    of = F.array(*[F.lit(x).cast("long") for x in bounds])

    def below(strict: bool) -> Column:
        """How many bounds are less than the key, or no greater."""
        lower = (lambda x: x < F.col(key)) if strict else (lambda x: x <= F.col(key))
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & lower(F.get(of, at + step - 1)), at + step).otherwise(at))

    least, most = below(True), below(False)
    share = F.shiftrightunsigned(F.col(tie), 33) / float(1 << 31)
    return (F.when(F.col(key).isNull(), F.lit(0)).otherwise(least + F.floor(share * (most - least + 1)))).cast("int")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has its last half replaced by the first half-length of the next document's text."""
    parts = ranges or partitions(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_tie"))
    number = range_number(docs.select(F.col(id_col).cast("long").alias("_id")), "_id", "_tie", parts)
    rows = rows.select(carried(F.col("_id")).alias("doc_id"), number.alias("_range"), "_tie", "text").mapInPandas(_pack, "doc_id string, _range int, _tie long, text binary")
    dealt = rows.repartitionById(parts, F.col("_range")).sortWithinPartitions(F.col("_range").desc(), F.col("doc_id").cast("long").desc_nulls_last(), "_tie", "text")
    walked = materialize(dealt.select("doc_id", "_range", "text").mapInPandas(_walk, f"{RESULT}, {_EDGE}"), "ctph")
    # two rows a range; the ranges are as many as partitions
    ring = Window.orderBy(F.col("range").desc())
    nxt = walked.where("edge = 'first'").select("range", F.coalesce(F.lead("range").over(ring), F.max("range").over(Window.partitionBy())).alias("to"))
    first = walked.where("edge = 'first'").select(F.col("range").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = walked.where("edge = 'last'").select("doc_id", "range", "text", "fingerprint").join(F.broadcast(nxt), "range").join(first, "to")
    names = [x.split()[0] for x in RESULT.split(", ")]
    out = walked.where("edge is null").select(*names).unionByName(last.mapInPandas(_edges, RESULT))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_context_triggered_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
