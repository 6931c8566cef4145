"""Sentencepiece BPE encoding and decoding by vectorised merge rounds.

*Words.*  No piece of the vocabulary runs over a word start (a space after another
character), so texts are cut there; Arrow numbers the distinct words of a slice of
texts and each is encoded once.

*Rounds.*  The words' symbols lie in one flat array, with the rank of each adjacent
pair.  A round takes each word's smallest rank by a segmented minimum, joins all pairs of
that rank at once (of pairs that overlap the leftmost, then every second one),
compacts the array and looks up only the pairs that changed.  Words without a pair left
leave the array.  Joining all pairs of a rank at once is what joining one after the
other gives, unless a joined piece makes a pair of a better or equal rank with its
neighbour; pieces that could are known from the vocabulary, and where one does the word
joins no further pair in that round.

*Long words.*  Words over ``LONG`` symbols (text without spaces) are cut between
characters that no piece has side by side.  Parts that are still long keep a linked list and
a bucket of places a rank: a round takes the bucket of the best rank, so each place is
visited only when its pair is joined, and the rounds are as many as ranks occur, however long the text.

Characters that no piece has become their UTF-8 bytes.  Decoding gathers the pieces'
bytes by offset.  Null text is empty and has no ids; null ids decode to the empty text.
Every row is kept, repeats and null ids included; columns beside ``doc_id`` and the text
(or ids) are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.tokencount import SPACE, PieceBpe

#: Symbols beyond which a word takes buckets of ranks, not rounds of its own.
LONG = 256
#: Bytes of text, and ids, of which the arrays are held at once; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
SLICE_IDS = 1 << 20
NEVER = np.int32(2**31 - 1)


class PieceCodec:
    """Pair ranks and piece bytes of a vocabulary, as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        score = PieceBpe(path).score  # raises where the rules of this module don't hold
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.n_ids = len(proto.pieces)
        symbol = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        for c in sorted({c for p in score for c in p} - symbol.keys()):  # characters that only longer pieces have
            symbol[c] = len(symbol) + self.n_ids
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        for piece, number in symbol.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = number
        self.symbol_char = {number: piece for piece, number in symbol.items() if number >= self.n_ids}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        self.width = np.int64(max(symbol.values()) + 2)
        pairs = [(symbol[p[:k]] * int(self.width) + symbol[p[k:]], rank[p], symbol[p]) for p in score for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        # an open hash table: few slots are taken, so most pairs are found or missed at once
        slots = 1 << (16 * len(pairs)).bit_length()
        self.pair = np.full(slots, -1, dtype=np.int64)
        self.pair_rank, self.pair_piece = np.full(slots, NEVER), np.full(slots, -1, dtype=np.int32)
        for key, r, joined in pairs:
            at = int(self._slot(np.array([key]))[0])
            while self.pair[at] >= 0:
                at = (at + 1) % slots
            self.pair[at], self.pair_rank[at], self.pair_piece[at] = key, r, joined
        joints = {(ord(a), ord(b)) for p in score for a, b in zip(p, p[1:])}
        self.joints = np.sort(np.array([a << 32 | b for a, b in joints], dtype=np.int64))
        self.opens_better = np.zeros(int(self.width), dtype=bool)
        for p in score:
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if part in rank and rank[part] >= rank[p]:
                        self.opens_better[symbol[part]] = True
        self.byte_id = np.full(256, 0, dtype=np.int32)
        text = [b""] * self.n_ids
        self.is_byte = np.zeros(self.n_ids, dtype=bool)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], text[i], self.is_byte[i] = i, bytes([value]), True
            elif p.type == 2:
                text[i] = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
            elif p.type != 3:
                text[i] = p.piece.replace(SPACE, " ").encode()
        self.size = np.array([len(t) for t in text], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.spaced = np.array([p.type not in (2, 3, 6) and p.piece.startswith(SPACE) for p in proto.pieces])
        self.control = np.array([p.type == 3 for p in proto.pieces])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of pairs of symbols; ``NEVER`` where they don't join."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        met = self.pair[at]
        other = np.flatnonzero((met != key) & (met >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.pair) - 1)
            met = self.pair[at[other]]
            other = other[(met != key[other]) & (met >= 0)]
        return self.pair_rank[at], self.pair_piece[at]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(40)) & np.int64(len(self.pair) - 1)

    def merge(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, how many of each) for words given by their code points."""
        symbols = self.char_symbol[code]
        # a character that no piece has: its negative code point, so that it comes through the rounds
        symbols = np.where(symbols < 0, -code.astype(np.int64), symbols).astype(np.int32)
        begin = np.cumsum(sizes) - sizes
        head = np.zeros(len(code), dtype=bool)
        head[begin] = True
        long = sizes > LONG
        if long.any():
            inside = _runs(begin[long] + 1, sizes[long] - 1)
            joint = code[inside - 1].astype(np.int64) << 32 | code[inside]
            at = np.minimum(np.searchsorted(self.joints, joint), len(self.joints) - 1)
            head[inside[self.joints[at] != joint]] = True
        part = (np.cumsum(head) - 1).astype(np.int32)
        first = part[begin]
        part_size = np.diff(np.flatnonzero(head), append=len(code))
        apart = (part_size > LONG)[part]
        done = [self._rounds(symbols[~apart], part[~apart]), self._buckets(symbols[apart], part[apart])]
        symbols, part = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(part, kind="stable")
        ids, counts = self._ids(symbols[order], part[order], len(part_size))
        return ids, np.add.reduceat(counts, first)

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_sym, done_word = [sym[:0]], [word[:0]]
        rank, piece = self._all_pairs(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(starts, append=len(sym))
            if (best == NEVER).any():
                over = np.repeat(best == NEVER, length)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, piece = sym[~over], word[~over], rank[~over], piece[~over]
                length, best = length[best < NEVER], best[best < NEVER]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, length))
            touches = np.diff(at, prepend=-9) == 1
            at = self._leftmost(at, touches, at + 1, at - 1, at + 2, sym, word, rank, piece)
            sym[at] = piece[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            at = place[at]
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed], piece[changed] = self._pairs_at(sym, word, changed)
        return np.concatenate(done_sym), np.concatenate(done_word)

    def _all_pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(sym, word, np.arange(len(sym)))

    def _pairs_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, piece = self.look_up(sym[at], sym[nxt])
        apart = (word[at] != word[nxt]) | (nxt == at)
        return np.where(apart, NEVER, rank), piece

    def _leftmost(self, at, touches, gone, left, right, sym, word, rank, piece) -> np.ndarray:
        """The pairs to join of those at ``at``: of pairs that overlap (``touches``: with the one before) every second one.

        ``gone``: the second place of each pair; ``left`` and ``right``: the places beside the pair.
        """
        order = np.arange(len(at))
        head = np.maximum.accumulate(np.where(touches, 0, order))
        chosen = (order - head) % 2 == 0
        at, gone, left, right = at[chosen], gone[chosen], left[chosen], right[chosen]
        if not self.opens_better[piece[at]].any():
            return at
        # what stands beside each joined piece: on the right before and after that is joined in turn
        mine, own = piece[at], rank[at]
        before = np.where(left >= 0, sym[np.maximum(left, 0)], -1)
        before[1:] = np.where(gone[:-1] == left[1:], mine[:-1], before[1:])
        inside = right < len(sym)
        after = np.where(inside, sym[np.minimum(right, len(sym) - 1)], -1)
        joined = after.copy()
        joined[:-1] = np.where(right[:-1] == at[1:], mine[1:], joined[:-1])
        better = (left >= 0) & (word[np.maximum(left, 0)] == word[at]) & (self.look_up(before, mine)[0] <= own)
        better |= inside & (word[np.minimum(right, len(sym) - 1)] == word[at]) & ((self.look_up(mine, after)[0] <= own) | (self.look_up(mine, joined)[0] <= own))
        if not better.any():
            return at
        first = np.flatnonzero(np.diff(word[at], prepend=-1))
        total = np.cumsum(better) - better
        return at[total == np.repeat(total[first], np.diff(first, append=len(at)))]

    def _buckets(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sym)
        rank, piece = self._all_pairs(sym, word)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        buckets: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        alive = np.ones(n, dtype=bool)

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NEVER]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, a, b in zip(rank[at[cut]].tolist(), cut.tolist(), [*cut[1:].tolist(), len(at)]):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(heap, r)
                buckets[r].append(at[a:b])

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(buckets.pop(r)))
            at = at[alive[at]]
            at = at[rank[at] == r]
            if not len(at):
                continue
            touches = np.zeros(len(at), dtype=bool)
            touches[1:] = nxt[at[:-1]] == at[1:]
            chosen = self._leftmost(at, touches, nxt[at], prv[at], nxt[nxt[at]], sym, word, rank, piece)
            gone = nxt[chosen]
            sym[chosen] = piece[chosen]
            alive[gone] = False
            nxt[chosen] = nxt[gone]
            inside = nxt[chosen] < n
            prv[nxt[chosen[inside]]] = chosen[inside]
            changed = np.unique(np.concatenate([chosen, prv[chosen][prv[chosen] >= 0]]))
            to = nxt[changed]
            end = to >= n
            to = np.where(end, changed, to)
            new_rank, new_piece = self.look_up(sym[changed], sym[to])
            rank[changed] = np.where(end | (word[changed] != word[to]), NEVER, new_rank)
            piece[changed] = new_piece
            rest = at[rank[at] == r]  # those that wait
            put(np.union1d(changed, rest[alive[rest]]))
        return sym[alive], word[alive]

    def _ids(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero((sym < 0) | (sym >= self.n_ids) | (sym == 0))
        counts = np.bincount(word, minlength=n_words)
        if len(odd):
            kinds, which = np.unique(sym[odd], return_inverse=True)
            raw = [(self.symbol_char[s] if s >= self.n_ids else chr(-s)).encode("utf-8", "surrogatepass") for s in kinds.tolist()]
            size = np.array([len(b) for b in raw], dtype=np.int64)
            flat = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            begin = np.cumsum(size) - size
            many = np.ones(len(sym), dtype=np.int64)
            many[odd] = size[which]
            counts = np.bincount(word, weights=many, minlength=n_words).astype(np.int64)
            at = np.cumsum(many) - many
            out = np.repeat(sym, many)
            places = _runs(at[odd], size[which])
            out[places] = flat[_runs(begin[which], size[which])]
            return out, counts
        return sym, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, how many of each)."""
        filled = np.asarray(pc.greater(pc.binary_length(texts), 0))
        counts = np.zeros(len(texts), dtype=np.int64)
        texts = texts.filter(pa.array(filled)).cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, dtype=np.int32), counts
        parts = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        sizes = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        last = np.zeros(len(code), dtype=bool)  # of a text
        last[np.cumsum(sizes) - 1] = True
        blank = pc.index(coded.dictionary, "").as_py()
        # an empty part is a space before the next part; at the end of a text the spaces are a word
        closes = (code != blank) | last
        where = np.flatnonzero(closes)
        before = np.diff(where, prepend=-1) - 1
        key = code[where]
        strings = [SPACE + w for w in words]
        if before.any():
            more, new = np.unique(np.stack([before[before > 0], key[before > 0]]), axis=1, return_inverse=True)
            key[before > 0] = len(words) + new.ravel()
            strings += [SPACE * (k + 1) + words[c] for k, c in more.T.tolist()]
        code_points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ids, n = self.merge(code_points, np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)))
        begin = np.cumsum(n) - n
        per_word = n[key]
        text_of = np.repeat(np.arange(len(sizes)), sizes)[where]
        counts[filled] = np.bincount(text_of, weights=per_word, minlength=len(sizes)).astype(np.int64)
        return ids[_runs(begin[key], per_word)], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids, as the library's ``decode`` gives it."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n_ids):
            raise ValueError("ids outside the vocabulary")
        ends = np.cumsum(counts)
        size, begin = self.size[ids], self.begin[ids]
        heads = np.flatnonzero(counts > 0)
        at = (ends - counts)[heads]
        if len(ids) and self.control[ids].any():  # the first piece with a text of its own
            plain = np.append(np.flatnonzero(~self.control[ids]), len(ids))
            at = plain[np.searchsorted(plain, at)]
            inside = at < ends[heads]
            at = at[inside]
        cut = at[self.spaced[ids[at]]]
        size[cut] -= 1
        begin[cut] += 1
        raw = self.bytes[_runs(begin, size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        stop = total[ends].tolist()
        start = total[ends - counts].tolist()
        out = []
        for k, (a, b) in enumerate(zip(start, stop)):
            try:
                out.append(raw[a:b].decode("utf-8"))
            except UnicodeDecodeError:
                mine = slice(int(ends[k] - counts[k]), int(ends[k]))
                out.append(self._loose(ids[mine], begin[mine], size[mine]))
        return out

    def _loose(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> str:
        """Text whose byte pieces are not UTF-8: each byte outside a character becomes U+FFFD."""
        edge = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8), prepend=-1))
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)]):
            raw = self.bytes[_runs(begin[a:b], size[a:b])].tobytes()
            while raw:
                try:
                    out.append(raw.decode("utf-8"))
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode("utf-8") + "�")
                    raw = raw[e.start + 1 :]
        return "".join(out)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin[k], begin[k] + 1, ...`` (``size[k]`` of them), one run after the other."""
    total = np.cumsum(size)
    at = np.repeat(begin - (total - size), size)
    return at + np.arange(len(at))


_codecs: dict[str, PieceCodec] = {}


def codec_for(path: str) -> PieceCodec:
    """The codec of this Python worker; found by import, so its tasks share it."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` in all."""
    slot = (np.cumsum(sizes) - sizes) // limit
    cut = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(sizes)).tolist()
    return zip(cut[:-1], cut[1:])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _cuts(np.asarray(pc.binary_length(texts)).astype(np.int64), SLICE_BYTES):
                ids, counts = codec.encode(texts.slice(a, b - a))
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            lists = batch.column(1)
            for a, b in _cuts(np.asarray(pc.list_value_length(lists)).astype(np.int64), SLICE_IDS):
                part = lists.slice(a, b - a)
                texts = codec.decode(part.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(part)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` (array<int>) of every text (``doc_id, text``), without begin or end ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(_encode(model_path), "doc_id long, ids array<int>")


def decode_pieces(coded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the text of every row's ids (``doc_id, ids``); null ids count as none, a null among them is left out."""
    ids = F.array_compact(F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")))
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(_decode(model_path), "doc_id long, ids array<int>, decoded string")
