"""Media columns: content-defined payload chunking.

A text's bytes, padded with zero bytes to whole 64-byte rows, become the samples of an 8-bit mono WAV file. A rolling gear hash cuts
the file into chunks wherever its bits say so, between a least and a most length, so equal passages give equal chunks. Chunks are
deduplicated by digest into a store of compressed chunks, bucketed by digest, and every file is kept as the ordered list of its
chunks' digests. Reading back joins the lists with the store on the digest, puts each file's chunks in order, verifies every
chunk's digest and the file's own, and computes features from the samples read.

The content crosses the network twice, compressed: to its digest's bucket and to its file. The store is a table bucketed by
digest, so the join moves the lists only, and a map task sends a chunk's content once. Lists are kept per distinct file: copies of
a text, be they a third of all rows, are read back once and get its features by a join of light rows; the length before padding is
each row's own. A chunk that very many different files share is joined through salted copies of its row.

Defined results: a null text is empty and becomes 64 zero samples; equal texts give equal values; repeated rows are files of their
own; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import carried, join_hot, materialize, partitions, scratch_dir, shuffle_files_dropped, small, table, text_of

ROW = 64
LEAST, MOST, BITS = 2048, 32768, 12
#: Bytes of a chunk's SHA-256 that name it; the whole file's is checked in full.
DIGEST = 16
LEVEL = 9
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_RATE = 8000
#: References that one copy of a stored chunk, or rows that one copy of a file's features serves; those with more get salted copies.
PER_COPY = 2000


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM in a RIFF container; an odd payload cannot occur."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, _RATE, _RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_samples(media: bytes) -> bytes:
    """The samples, after checking the container."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not the WAV layout that was stored")
    n = struct.unpack("<I", media[40:44])[0]
    if len(media) != 44 + n:
        raise ValueError("sample count and file length differ")
    return media[44:]


def gear_cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash's low BITS bits depend on the last BITS bytes only, so doubling sums give it for all
    positions at once; cuts are then taken from left to right with the least and most lengths kept."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < BITS:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    marks = np.flatnonzero((h & np.uint32((1 << BITS) - 1)) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % ROW or (ROW if not data else 0)), len(data)


def _pieces(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    for end in gear_cuts(media):
        yield hashlib.sha256(media[at:end]).digest()[:DIGEST], media[at:end]
        at = end


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each chunk of each file, without content."""
    names = ["whole", "seq", "n_seq", "digest", "n_bytes", "doc_id"]
    for b in batches:
        rows = []
        for doc, text in zip(b["doc_id"], b["text"], strict=True):
            payload, n = payload_of(text)
            media = wav(payload)
            whole, digests = hashlib.sha256(media).digest(), [d for d, _ in _pieces(media)]
            rows += [(whole, seq, len(digests), d, n, doc) for seq, d in enumerate(digests)]
        yield pd.DataFrame(rows, columns=names)


def _contents(dictionary: bytes):
    """Digest and compressed content of each chunk, once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _compressor(dictionary)
        for b in batches:
            rows, sent, weight = [], set(), 0
            for text in b["text"]:
                for digest, piece in _pieces(wav(payload_of(text)[0])):
                    if digest not in sent:
                        sent.add(digest)
                        rows.append((digest, pack(piece)))
                        weight += len(rows[-1][1])
                if weight > 8_000_000:
                    yield pd.DataFrame(rows, columns=["digest", "data"])
                    rows, weight = [], 0
            yield pd.DataFrame(rows, columns=["digest", "data"])

    return run


def _compressor(dictionary: bytes):
    import zstandard

    how = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **how).compress


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {})).decompress


def train_dictionary(texts: DataFrame, rows: int, size: int) -> bytes:
    """A compression dictionary from the beginnings of ``rows`` texts, the first in no order; empty if there are too few. It changes no
    result: any dictionary gives every chunk back."""
    import zstandard

    sample = texts.select(F.left("text", F.lit(8192)).alias("text")).limit(rows)  # an order would send so many from each task to the driver
    chunks = [piece for r in sample.collect() for _, piece in _pieces(wav(payload_of(r["text"])[0]))]
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes() if len(chunks) >= 100 else b""
    except zstandard.ZstdError:
        return b""


def features(samples: bytes) -> str:
    """Mean, root mean square around it, crossings of the middle and the greatest of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32)
    mean = float(x.mean(dtype=np.float64))
    rms = float(np.sqrt(np.mean((x - np.float32(mean)) ** 2, dtype=np.float64)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"mean={mean:.3f};rms={rms:.3f};crossings={crossings};peak={int(x.max())}"


_FEATURES = ["whole", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]


def _assemble(dictionary: bytes):
    """Chunks of a file come one after the other, in order of seq."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = _decompressor(dictionary)
        parts: list[bytes] = []
        for b in rows:
            out = []
            for whole, seq, n_seq, digest, data in zip(b["whole"], b["seq"], b["n_seq"], b["digest"], b["data"], strict=True):
                if seq == 0:
                    parts = []
                piece = unpack(data)
                if seq != len(parts) or hashlib.sha256(piece).digest()[:DIGEST] != bytes(digest):
                    raise ValueError(f"chunk {seq} is not what was stored")
                parts.append(piece)
                if seq == n_seq - 1:
                    media, parts = b"".join(parts), []
                    if hashlib.sha256(media).digest() != bytes(whole):
                        raise ValueError("a file was not read back as stored")
                    payload = wav_samples(media)
                    out.append((whole, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-ROW:]), len(media), f"{features(payload)};chunks={n_seq}"))
            if out:
                yield pd.DataFrame(out, columns=_FEATURES)

    return run


class ChunkStore:
    """A table of distinct chunks, bucketed by digest, in the shared folder."""

    def __init__(self, spark: SparkSession, dictionary: bytes = b"", name: str | None = None):
        self.spark, self.dictionary, self.name = spark, dictionary, name or f"weftline_chunks_{uuid.uuid4().hex}"

    def write(self, contents: DataFrame) -> ChunkStore:
        n = partitions(self.spark)
        with shuffle_files_dropped(self.spark):
            distinct = contents.repartition(n, "digest").dropDuplicates(["digest"])
            distinct.write.bucketBy(n, "digest").option("path", f"{scratch_dir(self.spark)}/{self.name}").saveAsTable(self.name)
        atexit.register(self.drop)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        from weftline.llm.common import _delete

        with contextlib.suppress(Exception):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            _delete(self.spark, f"{scratch_dir(self.spark)}/{self.name}")


def read_back(lists: DataFrame, store: ChunkStore) -> DataFrame:
    """One row of features per distinct file, from its chunks in the store."""
    files = materialize(lists.drop("doc_id", "n_bytes").dropDuplicates(["whole", "seq"]), "media-files")
    hot = materialize(files.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_COPY).select("digest", F.ceil(F.col("n") / PER_COPY).cast("int").alias("copies")), "media-hot")
    n_hot = hot.count()

    def with_data(some: DataFrame) -> DataFrame:
        if not n_hot:
            return some.join(store.read(), "digest")
        few = small(hot, n_hot)
        salted = some.join(few, "digest").withColumn("salt", F.pmod(F.xxhash64("whole", "seq"), F.col("copies")).cast("int"))
        copied = store.read().join(few, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        return some.join(few, "digest", "left_anti").join(store.read(), "digest").unionByName(salted.join(copied.drop("copies"), ["digest", "salt"]).drop("copies", "salt"))

    cols = ["whole", "seq", "n_seq", "digest", "data"]
    alone = with_data(files.where("n_seq = 1")).select(*cols)  # one chunk is the file: nothing to bring together
    parts = with_data(files.where("n_seq > 1")).select(*cols).repartition("whole").sortWithinPartitions("whole", "seq")
    schema = "whole binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"
    return alone.mapInPandas(_assemble(store.dictionary), schema).unionByName(parts.mapInPandas(_assemble(store.dictionary), schema))


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dictionary_rows: int = 1000, dictionary_bytes: int = 112_640) -> DataFrame:
    """doc_id and what was read back of its media: sizes, digests and features."""
    src = docs.select(carried(F.col(id_col).cast("long")).alias("doc_id"), text_of(text_col).alias("text"))
    lists = materialize(src.mapInPandas(_lists, "whole binary, seq int, n_seq int, digest binary, n_bytes long, doc_id string"), "media-lists")
    store = ChunkStore(docs.sparkSession, train_dictionary(src, dictionary_rows, dictionary_bytes))
    store.write(src.select("text").mapInPandas(_contents(store.dictionary), "digest binary, data binary"))
    with shuffle_files_dropped(docs.sparkSession):
        read = materialize(read_back(lists, store), "media-read")
    store.drop()  # a lost driver leaves no table behind from here on
    hexed = lambda c: F.lower(F.hex(c))
    mine = lists.where("seq = 0").select(F.col("doc_id").cast("long").alias("doc_id"), "whole", "n_bytes")
    hot = materialize(mine.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_COPY), "media-copies")
    out = join_hot(mine, read, "whole", hot, hot.count())
    return out.select("doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("whole").alias("media_sha256"), "feature")


def op10_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as media, stored in chunks and read back."""
    return media_columns(table(spark, sf_dir, "documents"))
