"""Token-id output: documents' ids as one long array in files, with Elias-Fano document boundaries.

File format: Parquet files of blocks, in ascending ``doc_id`` order by ``(shard,
block)``.  A block holds the ids of whole documents one after the other
(little-endian unsigned 16-bit where the vocabulary allows, else 32-bit) and two
Elias-Fano sequences: the documents' end offsets and their ``doc_id`` (less the block's
smallest).  Such a sequence packs the low bits of each value, and gives the high bits as
a unary bit vector with every ``SAMPLE``-th one's place.  Some ``2 + log2(tokens /
documents)`` bits a document replace a 64-bit table; ``select`` finds any offset or id
without decoding the others.  A block's place in the whole array is the sum of the token
counts before it, taken from the blocks' counts, never from the documents.

Encoding goes through the tokenizers library.  Text is cut at single spaces and line
breaks that no pre-token can run over; Arrow numbers a slice's distinct pieces, only
those that the worker has not met go through the library, and the ids are gathered by
index.  A worker keeps up to ``CACHE`` pieces.  Texts with the strings of special tokens
are encoded whole.

Null text is empty: its only id is the end id.  Null ids come first.  Rows that repeat
a ``doc_id`` are all written, ordered by a hash of their text.  Extra columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.llm.tables import join_small, stored

#: Ids after which a block ends.
BLOCK_IDS = 1 << 20
#: Pieces, and ids of pieces, that a worker remembers.
CACHE = 500_000
CACHE_IDS = 4_000_000
SAMPLE = 256
#: Pieces encoded in one text, and bytes of text whose pieces are numbered at once.
LINES = 4000
SLICE_BYTES = 4 << 20
#: Ids looked up at once.
LOOKUP_IDS = 100_000
_FORMAT = (
    "shard int, block int, width int, n_docs long, n_tokens long, n_null long, first_id long, last_id long, "
    "id_bits int, id_low binary, id_high binary, id_marks binary, low_bits int, low binary, high binary, marks binary, ids binary"
)
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_PLACE = np.argsort(1 - _ONES, axis=1, kind="stable").astype(np.int64)  # place of the k-th one of each byte


class EliasFano:
    """A non-decreasing sequence in near-minimal space; ``select(i)`` gives its i-th value."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.low_bits = n, low_bits
        self._low, self._high, self._marks = low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (top >> bits) + 1, dtype=np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, from the nearest mark on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        mark = int(np.frombuffer(self._marks, dtype="<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte = mark // 8
        bits = np.unpackbits(np.frombuffer(self._high, dtype=np.uint8)[byte : byte + 2 * SAMPLE], bitorder="little")
        bits[: mark % 8] = 0
        while bits.sum() <= left:  # few documents with very many ids: the next one is further on
            bits = np.unpackbits(np.frombuffer(self._high, dtype=np.uint8)[byte : byte + len(bits) // 4], bitorder="little")
            bits[: mark % 8] = 0
        one = byte * 8 + int(np.flatnonzero(bits)[left])
        at = i * self.low_bits
        raw = int.from_bytes(self._low[at // 8 : (at + self.low_bits + 7) // 8], "little") >> (at % 8)
        return ((one - i) << self.low_bits) | (raw & ((1 << self.low_bits) - 1))

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``, by a rank directory over the bytes of the bit vector."""
        raw = np.frombuffer(self._high, dtype=np.uint8)
        rank = np.cumsum(_ONES[raw].sum(axis=1, dtype=np.int64))
        byte = np.searchsorted(rank, i, side="right")
        before = rank[byte] - _ONES[raw[byte]].sum(axis=1, dtype=np.int64)
        high = byte * 8 + _PLACE[raw[byte], i - before] - i
        if not self.low_bits:
            return high.astype(np.uint64)
        at = (np.asarray(i)[:, None] * self.low_bits + np.arange(self.low_bits)).astype(np.int64)
        low = (np.frombuffer(self._low, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        """All values."""
        return self.select_many(np.arange(self.n))

    def first_at_least(self, value: int) -> int:
        """The first place whose value is at least ``value`` (``n`` if none is), by binary search over ``select``."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.select(mid) < value:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self._low, self._high, self._marks


class Pieces:
    """Ids of the pieces met so far, in one flat array."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.place: tuple[dict[str, int], dict[str, int]] = ({}, {})  # after a space, as it stands
        self.flat = np.zeros(1 << 12, dtype=self.kind)
        self.begin = np.zeros(1 << 10, dtype=np.int64)
        self.count = np.zeros(1 << 10, dtype=np.int64)
        self.n = self.used = 0

    def add(self, words: list[str], as_it_stands: int, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.n + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        while self.used + len(ids) >= len(self.flat):  # one more than is used
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = slice(self.n, self.n + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.place[as_it_stands].update(zip(words, range(self.n, self.n + len(words))))
        self.n, self.used = self.n + len(words), self.used + len(ids)

    def take(self, begin: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        """``count`` ids from each ``begin`` on, one run after the other; ``total``: the running sum of the counts."""
        at = np.repeat(begin - (total - count), count)
        at += np.arange(len(at))
        return self.flat[at]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces at these places, where each one's end)."""
        total = np.cumsum(self.count[at])
        return self.take(self.begin[at], self.count[at], total), total


class Encoder:
    """Ids of texts, as the tokenizers library gives them without added special tokens."""

    #: White space before white space, or at the end: there a pre-token may hold more than one of it.
    _run = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}](?:[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
    _white = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    _cut = re.compile(r"(?<=\S)(?=\n\S)| (?=\S)")
    #: Letters in every version of Unicode.
    _word = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u01ff]+")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # cutting is right for byte-level pre-tokens without a normalizer
        before = self.tokenizer.pre_tokenizer
        self.cuts = self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and not any(c in s for s in self.special for c in " \n")
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.cuts and len(line) == 1 else None
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True  # the byte-level sign of a space
        self.tails = {c: i[0] for c in ".,;:?!" if self.cuts and len(i := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1}
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every piece is new to the library
        self.pieces = Pieces(self.kind)

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many of each text)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=self.kind), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _lines(self, words: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``_raw``, of ``prefix`` (a space or nothing) and each word; words without white space are encoded many at a time.

        Those behind a space begin with an id whose token begins with a space; others come one a line, and
        a line break there is a pre-token and an id of its own that no such word has.
        """
        ids, counts = [], []
        for k in range(0, len(words), LINES):
            part = words[k : k + LINES]
            found = np.array(self.tokenizer.encode_batch_fast([prefix + (prefix or "\n").join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            if prefix:
                begins = np.flatnonzero(self.spaced[found])
                n = np.diff(begins, append=len(found))
            else:
                begins = np.append(np.flatnonzero(found == self.line), len(found))
                n = np.diff(begins, prepend=-1) - 1
                found = np.delete(found, begins[:-1])
            if len(begins) != len(part):
                found, n = self._raw([prefix + w for w in part])
            ids.append(found)
            counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else self._raw([])

    def _places(self, words: list[str], plain: np.ndarray, as_it_stands: int) -> np.ndarray:
        """Where the pieces lie; new ones are encoded.  ``plain``: pieces that hold no white space but a line break in front, and are more than that."""
        known = self.pieces.place[as_it_stands]
        found = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[k] for k in new]
            self._learn(fresh, plain[new], as_it_stands)
            found[new] = [known[w] for w in fresh]
        return found

    def _learn(self, words: list[str], plain: np.ndarray, as_it_stands: int) -> None:
        rest, simple, tailed, broken = [], [], [], []
        tail, word = self.tails, self._word.fullmatch
        for w, p in zip(words, plain.tolist()):
            if not p:
                rest.append(w)
            elif w[0] == "\n":
                broken.append(w)
            elif w[-1] in tail and word(w, 0, len(w) - 1):
                tailed.append(w)
            else:
                simple.append(w)
        prefix = "" if as_it_stands else " "
        self.pieces.add(rest, as_it_stands, *self._raw([prefix + w for w in rest]))
        self.pieces.add(simple, as_it_stands, *self._lines(simple, prefix))
        # a letter run is a pre-token, and so is the one mark behind it; a line break and what follows it are two
        for more, kind, cut, one in ((tailed, as_it_stands, slice(0, -1), [tail[w[-1]] for w in tailed]), (broken, 1, slice(1, None), [self.line] * len(broken))):
            if more:
                base = list(dict.fromkeys(w[cut] for w in more))
                lies = dict(zip(base, self._places(base, np.ones(len(base), dtype=bool), kind).tolist()))
                at = np.fromiter((lies[w[cut]] for w in more), dtype=np.int64, count=len(more))
                ids, ends = self.pieces.gather(at)
                self.pieces.add(more, as_it_stands, np.insert(ids, ends if more is tailed else ends - self.pieces.count[at], one), self.pieces.count[at] + 1)

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of each text: the first, and those that begin with a line break, stand as they are; others follow a space."""
        if self.line is None:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        odd = np.asarray(pc.match_substring_regex(texts, self._run))
        whole = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            whole |= np.asarray(pc.match_substring(texts, s))
        odd |= whole
        if not odd.any():
            return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = np.flatnonzero(odd)
        own = pa.array([[t] if w else self._cut.split(t) for t, w in zip(texts.take(pa.array(at)).to_pylist(), whole[at])], pa.list_(pa.string()))
        rest = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        order = np.empty(len(texts), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(~odd), at])] = np.arange(len(texts))
        return pa.concat_arrays([rest, own]).take(pa.array(order))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, each with the end id behind it; how many of each)."""
        split = self._split(texts)
        flat = split.flatten()
        sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
        ends = np.cumsum(sizes)
        coded = flat.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        breaks = np.asarray(pc.starts_with(words, "\n"))
        # white space of a word behind a line break in front
        inner = pc.if_else(pa.array(breaks), pc.utf8_slice_codeunits(words, 1), words)
        plain = ~np.asarray(pc.match_substring_regex(inner, self._white)) & (np.asarray(pc.binary_length(inner)) > 0) & (self.line is not None)
        stands = breaks[code]
        stands[ends - sizes] = True
        known = self.pieces
        if known.n > CACHE or known.used > CACHE_IDS:
            known.clear()
        place = np.zeros((2, len(words)), dtype=np.int64)
        for kind in (0, 1):
            wanted = np.zeros(len(words), dtype=bool)
            wanted[code[stands == kind]] = True
            place[kind, wanted] = self._places(words.filter(pa.array(wanted)).to_numpy(zero_copy_only=False).tolist(), plain[wanted], kind)
        key = code + stands * np.int32(len(words))
        begin, count = (x[place.ravel()].astype(np.int32)[key] for x in (known.begin, known.count))
        count[ends - 1] += 1  # room for the end id
        total = np.cumsum(count, dtype=np.int64)
        ids = known.take(begin, count, total)
        ids[total[ends - 1] - 1] = end_id
        return ids, np.diff(total[ends - 1], prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The encoder of this Python worker; found by import, so the tasks that a worker runs share it and its pieces."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``SLICE_BYTES``."""
    size = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64) // SLICE_BYTES
    cut = np.append(np.flatnonzero(np.diff(size, prepend=-1)), len(texts)) if len(texts) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        yield texts.slice(int(a), int(b - a))


def _block(shard: int, block: int, numbers: list[pa.Array], ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    whole, flat = pa.concat_arrays(numbers), np.concatenate(ids)
    ends = np.cumsum(np.concatenate(counts))
    known = whole.drop_null().to_numpy()
    low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    gaps = known.astype(np.uint64) - np.uint64(low % (1 << 64)) if len(known) else known  # modulo 2**64: right for any signs
    row = (shard, block, flat.itemsize, len(ends), int(ends[-1]), whole.null_count, low, high, *EliasFano.of(gaps).parts(), *EliasFano.of(ends).parts(), flat.tobytes())
    return pa.RecordBatch.from_pylist([dict(zip(_ROW.names, row))], schema=_ROW)


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        shard, block, total = TaskContext.get().partitionId(), 0, 0
        numbers, ids, counts = [], [], []
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                flat, count = encoder.encode(texts, end_id)
                ends = np.cumsum(count)
                doc = begin = 0
                while doc < len(count):
                    # up to the document with which the block is full
                    to = min(int(np.searchsorted(ends, begin + BLOCK_IDS - total)) + 1, len(count))
                    numbers.append(batch.column(0).slice(at + doc, to - doc))
                    ids.append(flat[begin : ends[to - 1]])
                    counts.append(count[doc:to])
                    total += int(ends[to - 1]) - begin
                    doc, begin = to, int(ends[to - 1])
                    if total >= BLOCK_IDS:
                        yield _block(shard, block, numbers, ids, counts)
                        numbers, ids, counts, total, block = [], [], [], 0, block + 1
                at += len(texts)
        if numbers:
            yield _block(shard, block, numbers, ids, counts)

    return run


_ROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
    ("n_null", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("id_bits", pa.int32()), ("id_low", pa.binary()), ("id_high", pa.binary()), ("id_marks", pa.binary()),
    ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("marks", pa.binary()), ("ids", pa.binary()),
])


def write_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode, write the files, and give them back as a table of blocks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_order", F.xxhash64("text"))  # spreads a hot id, or null, over partitions
    ordered = docs.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order").select("doc_id", "text")
    return stored(ordered.mapInArrow(_write(tokenizer_path, end_id), _FORMAT), "tokens", compression="zstd")


def _sequences(row: dict) -> tuple[EliasFano, EliasFano]:
    """(documents' ids less the first, end offsets) of a block."""
    ids = EliasFano(row["n_docs"] - row["n_null"], row["id_bits"], row["id_low"], row["id_high"], row["id_marks"])
    return ids, EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["marks"])


def _documents(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, memoryview]:
    """(ids, starts, ends, token ids as little-endian unsigned 32-bit) of a block."""
    ids, offsets = _sequences(row)
    known = (ids.values() + np.uint64((row["first_id"] or 0) % (1 << 64))).astype(np.int64)
    numbers = pa.array(np.concatenate([np.zeros(row["n_null"], dtype=np.int64), known]), mask=np.arange(row["n_docs"]) < row["n_null"])
    ends = offsets.values().astype(np.int64)
    flat = np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype("<u4")
    return numbers, np.concatenate([[0], ends[:-1]]), ends, memoryview(flat.tobytes())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        numbers, starts, ends, raw = _documents(row)
        yield pa.RecordBatch.from_arrays([
            numbers, pa.array(starts + row["base"]), pa.array(ends - starts), pa.array([raw[4 * a : 4 * b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
        ], names=["doc_id", "start", "n_tokens", "ids"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        numbers, starts, ends, raw = _documents(row)
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.int64, count=len(ends))
        yield pa.RecordBatch.from_arrays([numbers, pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _find(wanted: list[int]):
    """Of each block the documents with the wanted ids, found by ``select`` in both sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            ids, offsets = _sequences(row)
            width, found = row["width"], []
            for number in wanted:
                if row["first_id"] is None or not row["first_id"] <= number <= row["last_id"]:
                    continue
                place = ids.first_at_least(number - row["first_id"])
                while place < ids.n and ids.select(place) == number - row["first_id"]:
                    k = row["n_null"] + place
                    a, b = offsets.select(k - 1) if k else 0, offsets.select(k)
                    found.append((number, row["base"] + a, b - a, np.frombuffer(row["ids"], dtype=f"<u{width}", count=b - a, offset=a * width).astype("<u4").tobytes()))
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def _based(blocks: DataFrame) -> DataFrame:
    """Blocks with ``base``, the ids of all blocks before."""
    counts = blocks.select("shard", "block", "n_tokens")
    shards = counts.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    shards = shards.select("shard", (F.sum("all").over(W.orderBy("shard")) - F.col("all")).alias("before"))  # one row a shard
    inside = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    base = counts.select("shard", "block", inside.alias("inside")).join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))
    return join_small(blocks.drop("n_tokens"), base, ["shard", "block"], "inner", 200_000)


def read_token_ids(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of each document, read from the files."""
    return _based(blocks).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def verified_token_ids(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read from the files."""
    return _based(blocks).mapInArrow(_check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents with these ids (at most ``LOOKUP_IDS`` of them), without decoding the others.

    Only blocks whose id range holds a wanted id are read further.
    """
    wanted = sorted(set(doc_ids))
    if len(wanted) > LOOKUP_IDS:
        raise ValueError(f"look_up takes at most {LOOKUP_IDS} ids; join read_token_ids for more")
    near = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    return _based(blocks).filter(near).mapInArrow(_find(wanted), "doc_id long, start long, n_tokens long, ids binary")
