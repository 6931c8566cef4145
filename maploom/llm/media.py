"""Media columns: payloads stored as 8-bit WAV audio in content-defined chunks.

A payload is cut where a rolling gear hash of the last 32 bytes has its top bits
zero, so equal passages give equal chunks wherever they stand.  Chunk digests are
counted and deduplicated by Spark joins:

* payloads of equal texts are stored once, by the smallest ``doc_id``;
* a chunk that only one payload has stays in that payload's ordered chunk list;
* a chunk that several have goes to the chunk store once, and the lists name it.

Reading joins the named chunks back in, checks each chunk against its digest and
the media against the list's sizes, and computes the features from those bytes.
Only digests and the shared chunks are shuffled, never all payloads, as long as
the list of documents with shared chunks is small enough to broadcast (checked);
beyond that the texts are shuffled by ``doc_id`` instead.

Null text is empty: 64 zero bytes.  Null and repeated ids are kept, each row by its
own text.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.tables import join_hot, join_small, stored

UNIT = 64
LEAST, MOST, MASK_BITS = 1024, 16384, 11
RATE = 8000
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 500_000
#: Keys with very many rows that are joined by broadcast: chunks (16 KB each at most) and payloads' descriptions.
HOT_CHUNKS = 2000
HOT_PAYLOADS = 20_000
#: Bytes hashed at once.
SLICE_BYTES = 4 << 20

_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
_RESULT = "payload_key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def wav_header(n: int) -> bytes:
    """Header of mono 8-bit PCM audio with ``n`` samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """End offsets of each payload's chunks."""
    buf = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    h = _GEAR[buf]
    for s in (1, 2, 4, 8, 16):
        shifted = h[:-s] << np.uint32(s)
        h[s:] += shifted
    found = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, begin = [], 0
    for p in payloads:
        n = len(p)
        lo, hi = np.searchsorted(found, [begin, begin + n])
        ends, at = [], 0
        for c in (found[lo:hi] - begin).tolist():
            while c - at > MOST:
                at += MOST
                ends.append(at)
            if c - at >= LEAST:
                at = c
                ends.append(at)
        while n - at > MOST:
            at += MOST
            ends.append(at)
        if at < n:
            ends.append(n)
        out.append(ends)
        begin += n
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, list[bytes]]]:
    """(index, bytes of the text, payload, chunks) of each text."""
    at = 0
    while at < len(texts):
        group, total, begin = [], 0, at
        while at < len(texts) and total < SLICE_BYTES:
            group.append(payload(texts[at]))
            total += len(group[-1])
            at += 1
        for i, (p, ends) in enumerate(zip(group, cuts(group))):
            n = len((texts[begin + i] or "").encode("utf-8", "surrogatepass"))
            yield begin + i, n, p, [p[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, lists = [], []
        for _, n, p, chunks in _chunks(batch.column(1).to_pylist()):
            key.append(digest(p + n.to_bytes(8, "little")))
            lists.append([digest(c) for c in chunks])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "payload_key", "digests"])


_MEDIA = pa.schema([("payload_key", pa.binary()), ("n_bytes", pa.int64()), ("header", pa.binary()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("data", pa.binary())])))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, skip (payloads stored elsewhere), shared (digests) -> ordered chunk lists."""
    for batch in batches:
        skip, shared = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        rows = []
        for i, n, p, chunks in _chunks(batch.column(1).to_pylist()):
            key = digest(p + n.to_bytes(8, "little"))
            if key in (skip[i] or ()):
                continue
            named = set(shared[i] or ())
            parts = [(digest(c), c) for c in chunks]
            rows.append({"payload_key": key, "n_bytes": n, "header": wav_header(len(p)), "chunks": [{"digest": d, "size": len(c), "data": None if d in named else c} for d, c in parts]})
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=_MEDIA)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_MEDIA)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, skip, shared -> (digest, data) of the shared chunks, each once a batch."""
    for batch in batches:
        skip, shared, found = batch.column(2).to_pylist(), batch.column(3).to_pylist(), {}
        for i, n, p, chunks in _chunks(batch.column(1).to_pylist()):
            if digest(p + n.to_bytes(8, "little")) not in (skip[i] or ()):
                named = set(shared[i])
                found.update((d, c) for d, c in ((digest(c), c) for c in chunks) if d in named)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "data"])


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the media; returns (``doc_id, payload_key``, chunk lists, chunk store), as read back."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = stored(docs.mapInArrow(_describe, "doc_id long, payload_key binary, digests array<binary>"), "digests")
    owner = listed.groupBy("payload_key").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.first("digests").alias("digests"))
    owner = stored(owner, "payloads")
    copies = join_small(listed.select("doc_id", "payload_key"), owner.filter("n > 1").select("payload_key", "owner"), "payload_key", "inner", BROADCAST_ROWS)
    copies = copies.filter("doc_id > owner").groupBy("doc_id").agg(F.collect_set("payload_key").alias("skip"))
    parts = owner.filter("owner is not null").select("owner", F.explode(F.array_distinct("digests")).alias("digest"))
    often = parts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    shared = join_small(parts, often, "digest", "left_semi", BROADCAST_ROWS).groupBy("owner").agg(F.collect_set("digest").alias("shared")).withColumnRenamed("owner", "doc_id")
    special = stored(copies.join(shared, "doc_id", "full"), "special")
    planned = join_small(docs, special, "doc_id", "left", BROADCAST_ROWS).select("doc_id", "text", "skip", "shared")
    lists = stored(planned.mapInArrow(_pack, "payload_key binary, n_bytes long, header binary, chunks array<struct<digest: binary, size: int, data: binary>>"), "media", compression="zstd")
    chunks = planned.filter("shared is not null").mapInArrow(_shared, "digest binary, data binary").dropDuplicates(["digest"])
    return listed.select("doc_id", "payload_key"), lists, stored(chunks, "chunks", compression="zstd")


def describe_media(n: int, header: bytes, samples: bytes) -> tuple:
    """Digests and features of stored media, from its bytes."""
    values = np.frombuffer(samples, dtype=np.uint8)
    spread = np.bincount(values >> 4, minlength=16)
    change = np.abs(np.diff(values.astype(np.int16))).mean()
    feature = f"mean={values.mean():.4f};std={values.std():.4f};change={change:.4f};bins={','.join(map(str, spread))}"
    media = hashlib.sha256(header)
    media.update(samples)
    return n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(header) + len(samples), media.hexdigest(), feature


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """payload_key, n_bytes, header, chunks, found (digest -> data of the store) -> digests and features."""
    for batch in batches:
        rows = []
        for key, n, header, chunks, found in zip(*(c.to_pylist() for c in batch.columns)):
            store = {x["digest"]: x["data"] for x in found or ()}
            data = [c["data"] if c["data"] is not None else store[c["digest"]] for c in chunks]
            for c, d in zip(chunks, data):
                if len(d) != c["size"] or digest(d) != c["digest"]:
                    raise ValueError("a stored chunk differs from its digest")
            samples = b"".join(data)
            if header != wav_header(len(samples)):
                raise ValueError("a chunk list doesn't give the media's length")
            rows.append((key, *describe_media(n, header, samples)))
        names = ["payload_key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_media(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """``payload_key`` and what :func:`describe_media` finds, from the stored bytes."""
    named = F.filter("chunks", lambda c: c["data"].isNull())
    whole = lists.filter(F.size(named) == 0)
    partly = lists.filter(F.size(named) > 0)
    refs = stored(partly.select("payload_key", F.explode(F.array_distinct(F.transform(named, lambda c: c["digest"]))).alias("digest")), "references")
    found = join_hot(refs, chunks, "digest", refs.count(), HOT_CHUNKS).groupBy("payload_key").agg(F.collect_list(F.struct("digest", "data")).alias("found"))
    partly = partly.join(found, "payload_key").select("payload_key", "n_bytes", "header", "chunks", "found")
    none = F.lit(None).cast("array<struct<digest: binary, data: binary>>").alias("found")
    return whole.select("payload_key", "n_bytes", "header", "chunks", none).mapInArrow(_read, _RESULT).union(partly.mapInArrow(_read, _RESULT))


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text's media, read it back, and describe it per document."""
    keys, lists, chunks = store_media(docs)
    found = stored(read_media(lists, chunks).dropDuplicates(["payload_key"]), "media-columns")
    return join_hot(keys, found, "payload_key", keys.count(), HOT_PAYLOADS).drop("payload_key")
