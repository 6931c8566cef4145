"""Token counts by a finite-state transducer compiled from a BPE piece vocabulary.

The vocabulary is a sentencepiece BPE model: in each step the adjacent pair whose
joined piece has the best score is merged, the leftmost first.

*Why a finite-state machine.*  If ``t1 .. tn`` is the BPE result of a string then each
prefix ``t1 .. tk`` is the result of its own string, and a sequence is a result
exactly if each adjacent pair is the result of its two pieces joined.  So the last
piece of the result of each prefix is fixed: it is the one piece that ends there and
whose pair with the last piece before it is stable.  What later characters can see of
the past is the suffixes that some piece continues, with the last piece before each and
the count there relative to now.  That is a finite state; reading a character emits
the change of the count.

*Compilation.*  States and transitions are built when first met, and kept in an open
hash table that numpy probes for many lanes at once.  The table is emptied when it
reaches ``MAX_TRANSITIONS``, so a task's memory is bounded whatever the texts hold.

*Parallel scan.*  A text is cut in chunks.  Pieces never run over a word start, so what
a chunk emits from its first word start on hangs on no incoming state: all chunks run
that part at once, a character a step.  The part before it is a map from the incoming
state to (state out, count).  Its domain starts with the states that runs from the
start state reach which begin a little before the chunk, one for each phase a piece can
have; they mostly agree.  The maps then compose pairwise, in a prefix scan by doubling:
a long text without any word start takes rounds in the logarithm of its chunks.  Where a
map is asked for a state outside its domain the domain is extended, so the result is
exact.

Characters outside the vocabulary count their UTF-8 bytes (byte fallback) and end
every piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transitions a worker keeps: some 30 bytes each in the table, and a third as many states of some 600 bytes.
MAX_TRANSITIONS = 1_000_000
#: Characters of one lane, and texts' characters taken at once.
CHUNK = 192
#: Characters that the runs begin before a chunk, and how many such runs.
LOOK_BACK = 48
PHASES = 16
SLICE_CHARS = 4_000_000

SPACE = "▁"


class PieceBpe:
    """The pieces, scores and pair rule of a sentencepiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the transducer is for BPE models with byte fallback, a dummy prefix and no normalisation")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces that run over a word start are not supported")
        self.chars = sorted({c for p in self.score for c in p})
        self._stable: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """The merges themselves, for one or two pieces' text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        found = self._stable.get((left, right))
        if found is None:
            if len(self._stable) > 500_000:
                self._stable.clear()
            found = self._stable[left, right] = self.encode(left + right) == [left, right]
        return found


class Transducer:
    """Deterministic transducer over character classes; transitions carry the change of the token count.

    State 0 is the start of a piece sequence.
    """

    def __init__(self, bpe: PieceBpe, limit: int = MAX_TRANSITIONS):
        self.bpe, self.limit = bpe, limit
        self.open = {p[:k] for p in bpe.score for k in range(1, len(p))}  # texts that a piece continues
        self.reachable = {p for p in bpe.score if len(p) == 1 or bpe.encode(p) == [p]} | set(bpe.chars)
        self.classes = {c: i + 1 for i, c in enumerate(bpe.chars)}
        self.names = ["", *bpe.chars]
        self.width = len(self.names)
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[[ord(c) for c in bpe.chars]] = np.arange(1, self.width)
        self.reset()

    def reset(self) -> None:
        #: A state: the open suffixes of what was read, longest first, each with the last piece
        #: before it ("" at the very start) and the count there minus the count now.
        start = (("", "", 0),)
        self.states: dict[tuple, int] = {start: 0}
        self.made: list[tuple] = [start]
        size = 1 << 16
        self.key = np.full(size, -1, dtype=np.int64)
        self.to = np.zeros(size, dtype=np.int32)
        self.emit = np.zeros(size, dtype=np.int16)
        self.used = 0

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        reachable, stable, open_ = self.reachable, self.bpe.stable, self.open
        for suffix, before, base in state:
            piece = suffix + char
            if piece in reachable and (before == "" or stable(before, piece)):
                break
        else:
            raise AssertionError("a single character always ends a result")
        count = base + 1
        kept = [(suffix + char, before, base - count) for suffix, before, base in state if suffix + char in open_]
        return (*kept, ("", piece, 0)), count

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mask = np.int64(len(self.key) - 1)
        at = ((keys * np.int64(-7046029254386353131)) >> np.int64(32)) & mask
        open_ = np.flatnonzero((self.key[at] != keys) & (self.key[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            open_ = open_[(self.key[at[open_]] != keys[open_]) & (self.key[at[open_]] != -1)]
        return at

    def _put(self, key: np.ndarray, to: np.ndarray, emit: np.ndarray) -> None:
        size = len(self.key)
        while 2 * (self.used + len(key)) > size:
            size *= 2
        if size > len(self.key):
            keep = self.key >= 0
            key, to, emit = (np.concatenate(x) for x in ((self.key[keep], key), (self.to[keep], to), (self.emit[keep], emit)))
            self.key, self.to, self.emit = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int16)
            self.used = 0
        self.used += len(key)
        while len(key):  # keys that meet in one slot take turns
            at = self._slot(key)
            _, first = np.unique(at, return_index=True)
            self.key[at[first]], self.to[at[first]], self.emit[at[first]] = key[first], to[first], emit[first]
            rest = np.ones(len(key), dtype=bool)
            rest[first] = False
            key, to, emit = key[rest], to[rest], emit[rest]

    def advance(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts of many lanes; builds the transitions that are missing."""
        keys = state.astype(np.int64) * self.width + cls
        at = self._slot(keys)
        missing = np.flatnonzero(self.key[at] == -1)
        if len(missing):
            fresh = np.unique(keys[missing])
            to, emit = np.zeros(len(fresh), dtype=np.int32), np.zeros(len(fresh), dtype=np.int16)
            for i, k in enumerate(fresh.tolist()):
                old, c = divmod(k, self.width)
                new, emit[i] = self.step(self.made[old], self.names[c])
                number = self.states.get(new)
                if number is None:
                    number = self.states[new] = len(self.made)
                    self.made.append(new)
                to[i] = number
            self._put(fresh, to, emit)
            at = self._slot(keys)
        return self.to[at], self.emit[at]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, with the dummy prefix; an empty text has none."""
        if self.used > self.limit:
            self.reset()
        sizes = np.array([len(t) + (t != "") for t in texts], dtype=np.int64)
        joined = "".join(SPACE + t for t in texts if t).replace(" ", SPACE)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(code):
            return np.zeros(len(texts), dtype=np.int64)
        cls = self.class_of[code]
        unknown = cls == 0
        width = np.select([code < 0x80, code < 0x800, code < 0x10000], [1, 2, 3], 4)
        emitted = np.where(unknown, width, 0)
        ends = np.cumsum(sizes)
        begins = np.unique((ends - sizes)[sizes > 0])
        # positions where no piece runs over from the left: text starts, word starts, after and at unknown characters
        space = cls == self.classes.get(SPACE, -1)
        fresh = space.copy()
        fresh[1:] &= ~space[:-1]
        fresh[1:] |= unknown[:-1]
        fresh |= unknown
        fresh[begins] = True
        n = len(code)
        lanes = -(-n // CHUNK)
        starts = np.arange(lanes) * CHUNK
        where = np.flatnonzero(fresh)
        nxt = np.append(where, n)[np.searchsorted(where, starts)]
        stop = np.minimum(starts + CHUNK, n)
        sync = np.minimum(nxt, stop)
        end_state = np.zeros(lanes, dtype=np.int32)
        self._run(sync, stop, np.zeros(lanes, dtype=np.int32), end_state, cls, fresh, unknown, emitted)
        # the part before the first fresh position is a map of the state that comes in
        todo = np.flatnonzero(starts < sync)
        if len(todo):
            emitted[starts[todo]] += self._scan(todo, starts, sync, stop, end_state, cls, fresh, unknown)
        total = np.concatenate([[0], np.cumsum(emitted)])
        return total[ends] - total[ends - sizes]

    def _scan(self, todo, starts, sync, stop, end_state, cls, fresh, unknown) -> np.ndarray:
        """Tokens emitted before the first fresh position of each chunk of ``todo``, by composed chunk maps."""
        place = np.full(len(starts) + 1, -1)  # of a chunk within todo
        place[todo] = np.arange(len(todo))
        goes_on = (sync[todo] == stop[todo]) & (place[todo + 1] >= 0)  # the map's state out comes into another map
        head = np.flatnonzero((place[todo - 1] < 0) | (sync[todo - 1] < stop[todo - 1]))  # here the incoming state is known
        # domains: (chunk, state in), coded as one number
        states = [end_state[todo[head] - 1].astype(np.int64)]
        chunks = [head]
        later = np.flatnonzero(goes_on) + 1
        for k in range(PHASES if len(later) else 0):
            to = starts[todo[later]]
            out = np.zeros(len(later), dtype=np.int32)
            self._run(to - LOOK_BACK - k, to, np.zeros(len(later), dtype=np.int32), out, cls, fresh, unknown)
            states.append(out.astype(np.int64))
            chunks.append(later)
        fresh_key = np.unique((np.concatenate(chunks) << 32) | np.concatenate(states))
        key = np.zeros(0, dtype=np.int64)
        to, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while len(fresh_key):
            chunk, state = fresh_key >> 32, (fresh_key & 0xFFFFFFFF).astype(np.int32)
            out = np.zeros(len(chunk), dtype=np.int32)
            sums = self._run(starts[todo[chunk]], sync[todo[chunk]], state, out, cls, fresh, unknown)
            order = np.argsort(np.concatenate([key, fresh_key]), kind="stable")
            key, to, count = (np.concatenate(x)[order] for x in ((key, fresh_key), (to, out.astype(np.int64)), (count, sums)))
            # each entry's successor: the entry of the next chunk for the state that comes out
            chunk = key >> 32
            asked = np.where(goes_on[chunk], ((chunk + 1) << 32) | to, -1)
            at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            found = (asked >= 0) & (key[at] == asked)
            nobody = len(key)
            jump = np.append(np.where(found, at, nobody), nobody)
            # composing maps pairwise: after each round a jump covers twice as many chunks
            taken = np.zeros(len(key) + 1, dtype=bool)
            taken[np.searchsorted(key, (head << 32) | end_state[todo[head] - 1])] = True
            while (jump[:-1] < nobody).any():
                taken[jump[taken]] = True
                jump = jump[jump]
            taken = taken[:-1]
            fresh_key = np.unique(asked[taken & (asked >= 0) & ~found])
        out = np.zeros(len(todo), dtype=np.int64)
        out[key[taken] >> 32] = count[taken]
        return out

    def _run(self, begin, stop, state, out, cls, fresh, unknown, emitted=None) -> np.ndarray:
        """Run lanes of characters; ``out`` takes the end states.  Gives each lane's count, and each character's in ``emitted``."""
        sums = np.zeros(len(begin), dtype=np.int64)
        out[:] = state
        lane = np.flatnonzero(begin < stop)
        at, state = begin[lane].copy(), state[lane].copy()
        last = stop[lane]
        while len(lane):
            state[fresh[at]] = 0
            plain = np.flatnonzero(~unknown[at])
            if len(plain):
                new, count = self.advance(state[plain], cls[at[plain]])
                state[plain] = new
                sums[lane[plain]] += count
                if emitted is not None:
                    emitted[at[plain]] = count
            at += 1
            done = at >= last
            if done.any():
                out[lane[done]] = state[done]
                go = ~done
                lane, at, state, last = lane[go], at[go], state[go], last[go]
        return sums


_machines: dict[str, Transducer] = {}


def machine_for(path: str) -> Transducer:
    """The transducer of this Python worker; found by import, so the tasks that a worker runs share it."""
    if path not in _machines:
        _machines[path] = Transducer(PieceBpe(path))
    return _machines[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_for(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            slot = np.cumsum(sizes) // SLICE_CHARS
            cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(texts))
            counts = [machine.count(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], names=["row", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text; null is empty, extra columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("row")
    counted = docs.select(row, "text").mapInArrow(_count(model_path), "row struct<doc_id: long, n_bytes: long>, n_tokens long")
    return counted.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
