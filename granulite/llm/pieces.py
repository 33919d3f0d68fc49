"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A text that is split into chunks can't be encoded chunk by chunk: a piece may lie
across a boundary, and what precedes it decides which. So each boundary gets its
*states*: the pieces of the vocabulary that match the text around it and end at or
after it. A chunk yields a transfer matrix: the weight of the best way through the
chunk from each state of its left boundary to each of its right one. Matrices are
combined with the max-plus product, which is associative, so a scan gives the best
state of every boundary, and each chunk is then traced back by itself.

The public model is a BPE one, whose result isn't the path of greatest piece scores.
But a sequence of pieces is the BPE result exactly if each two neighbours, merged by
themselves, stay as they are, so weights are 0 for neighbours that do and minus
infinity for others: one path is left, and it's the library's result. A state must
name its piece for that. Where the text has a word's beginning at the boundary, all
pieces end, and there is one state only; the walk from states to the next word's
beginning is short, and words between are encoded by the library, each different one
once. Documents of one chunk are such words alone. Words are told apart, and their
ids put in their places, on arrays: no object is made for a word or an id.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trim
from .words import buffers, hashes, segments

#: Characters of a chunk; texts of more are giant. Bytes of text that are handled at once. Words that a worker remembers.
CHUNK, SEGMENT, REMEMBER = 16384, 1 << 20, 300_000
MARK = "▁"
SPACE = 0x20
UNKNOWN, BARRIER = -1, -2
#: An id for a boundary's state where any piece may follow.
OPEN = (0, BARRIER)
NONE = -np.inf
_U = np.uint64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Known:
    """Words with their ids, found by hash and compared by their bytes; as arrays."""

    def __init__(self):
        self.hash, self.row = np.empty(0, _U), np.empty(0, np.int64)
        # of each row: where its bytes and its ids begin, and how many there are
        self.place, self.size, self.at, self.n = (np.empty(0, np.int64) for _ in range(4))
        self.data, self.ids = np.empty(0, np.uint8), np.empty(0, np.int32)

    def find(self, hash_: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for a new one."""
        if not len(self.hash):
            return np.full(len(hash_), -1)
        i = np.minimum(np.searchsorted(self.hash, hash_), len(self.hash) - 1)
        return np.where(self.hash[i] == hash_, self.row[i], -1)

    def only(self, rows: np.ndarray) -> Known:
        """Some of the rows, by hash."""
        out = Known()
        rows = self.row[np.isin(self.row, rows)]
        out.add(self.hash[np.isin(self.row, rows)], self.data[gather(self.place[rows], self.size[rows])], self.size[rows], self.ids[gather(self.at[rows], self.n[rows])], self.n[rows])
        return out

    def add(self, hash_: np.ndarray, data: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New rows; hash_ ascends."""
        rows = np.arange(len(hash_)) + len(self.size)
        i = np.searchsorted(self.hash, hash_)
        self.hash, self.row = np.insert(self.hash, i, hash_), np.insert(self.row, i, rows)
        self.place = np.append(self.place, np.cumsum(size) - size + len(self.data))
        self.at = np.append(self.at, np.cumsum(n) - n + len(self.ids))
        self.size, self.n, self.data, self.ids = np.append(self.size, size), np.append(self.n, n), np.append(self.data, data), np.append(self.ids, ids)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of ranges, one after the other."""
    to = np.cumsum(sizes) - sizes
    return np.repeat(starts - to, sizes) + np.arange(int(sizes.sum()))


class Pieces:
    """A BPE model with byte fallback whose pieces don't cross a word's beginning."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.id = {sp.id_to_piece(i): i for i in usual}
        self.name = {i: p for p, i in self.id.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        spelled = [b"" for _ in range(sp.get_piece_size())]
        for i in range(len(spelled)):
            spelled[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else self.name[i].replace(MARK, " ").encode() if i in self.name else b""
        #: Bytes of all pieces, and where those of each begin; whether a piece begins with a mark, and whether its bytes are its own.
        self.spelled, self.sizes = np.frombuffer(b"".join(spelled), np.uint8), np.array(list(map(len, spelled)))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.marked_ = np.array([self.name.get(i, "").startswith(MARK) for i in range(len(spelled))])
        self.plain = np.array([len(x) > 0 for x in spelled])
        if any(sp.is_unused(i) for i in usual) or any(MARK in p.lstrip(MARK) for p in self.id) or any(c not in self.id for p in self.id for c in p):
            raise ValueError("a model of another kind")
        if sp.encode("a  b ", out_type=str)[:1] != [sp.encode("a", out_type=str)[0]] or sp.encode("Ａ")[-1:] == sp.encode("A")[-1:]:
            raise ValueError("a model that changes the text")
        self.known = Known()
        self.fits = lru_cache(1 << 18)(self._fits)

    @staticmethod
    def marked(text: str) -> str:
        """The text as the model sees it."""
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, and how many each has; the texts are given by offsets into their bytes and hold no mark."""
        n, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for i, j in segments(offsets, SEGMENT):
            for part, of in zip((n, ids), self._segment(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])):
                part.append(of)
        return np.concatenate(n), np.concatenate(ids)

    def _segment(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        heads = offsets[:-1][full]
        if not len(full):
            return np.zeros(len(offsets) - 1, np.int64), np.empty(0, np.int32)
        # a space before each text, as the model sees it
        spaced = np.insert(data, heads, SPACE)
        heads = heads + np.arange(len(heads))
        blank = spaced == SPACE
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[heads] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(spaced))
        size = end - start
        found, rep, which = np.unique(hashes(spaced, start, end), return_index=True, return_inverse=True)
        row = self.known.find(found)
        new = rep[row < 0]
        if len(self.known.size) + len(new) > REMEMBER:  # those of this text are likely to come again
            self.known = self.known.only(row[row >= 0])
        if len(new):
            self.known.add(found[row < 0], spaced[gather(start[new], size[new])], size[new], *self._words(spaced, start[new], end[new]))
        row = self.known.find(found)[which]
        if (self.known.size[row] != size).any() or (self.known.data[gather(self.known.place[row], size)] != spaced).any():
            ids, n = self._words(spaced, start, end)  # two words of one hash: each by itself
        else:
            n = self.known.n[row]
            ids = self.known.ids[gather(self.known.at[row], n)]
        text = np.searchsorted(heads, start, "right") - 1
        per = np.zeros(len(offsets) - 1, np.int64)
        per[full] = np.bincount(text, weights=n, minlength=len(full)).astype(np.int64)
        return per, ids

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the library, and how many each has."""
        raw = data.tobytes()
        # the library puts the first space itself; a word of one space is empty without it
        ids = self.sp.encode([raw[a + 1 : b].decode() for a, b in zip(start.tolist(), end.tolist())], num_threads=1)
        for k in np.flatnonzero(end - start == 1):
            ids[k] = [self.id[MARK]]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n

    def units(self, marked: list[str]) -> list[np.ndarray]:
        """Ids of strings that are empty or begin with a mark and a word."""
        texts = [x[1:].replace(MARK, " ").encode() for x in marked]
        n, ids = self.encode(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8))
        out = np.split(ids, np.cumsum(n)[:-1])
        return [np.array([self.id[MARK]], np.int32) if x == MARK else y for x, y in zip(marked, out)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of lists of plain ids, and how many each has."""
        n = self.sizes[ids]
        to = np.cumsum(n) - n
        data = self.spelled[gather(self.places[ids], n)]
        ends = np.append(to, len(data))
        per = ends[offsets[1:]] - ends[offsets[:-1]]
        # the space that the library puts before a text goes again
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        lead = full[self.marked_[ids[offsets[:-1][full]]]]
        keep = np.ones(len(data), bool)
        keep[ends[offsets[:-1][lead]]] = False
        per[lead] -= 1
        return data[keep], per

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string: neighbours are merged, the best score first and the leftmost of equal ones."""
        s = list(text)
        while len(s) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def _fits(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are, side by side; b by itself after a barrier."""
        if b == UNKNOWN:
            return True
        if a in (UNKNOWN, BARRIER):
            return self.merged(self.name[b]) == [self.name[b]]
        return self.merged(self.name[a] + self.name[b]) == [self.name[a], self.name[b]]

    def starts(self, s: str, c: int) -> bool:
        """Whether a word begins at c (or the text does, or ends)."""
        return c <= 0 or c >= len(s) or (s[c] == MARK and s[c - 1] != MARK)

    def states(self, s: str, c: int) -> list[tuple[int, int]]:
        """The boundary's states: (how far beyond c a piece ends, the piece)."""
        if self.starts(s, c):
            return [OPEN]
        out = []
        for i in range(max(0, c - self.longest), c):
            for j in range(c, min(len(s), i + self.longest) + 1):
                if (p := self.id.get(s[i:j])) is not None:
                    out.append((j - c, p))
        if s[c - 1] not in self.id:
            out.append((0, UNKNOWN))
        return sorted(out)

    def walk(self, s: str, start: int, piece: int, stop: int) -> dict[int, tuple[int, int]]:
        """From a piece that ends at start: by end, the only piece that can end there and its beginning; until pieces reach stop."""
        last = {start: (piece, start)}
        for i in range(start, stop):
            if i not in last:
                continue
            a = last[i][0]
            if s[i] not in self.id:
                last.setdefault(i + 1, (UNKNOWN, i))
                continue
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                p = self.id.get(s[i:j])
                if p is not None and j not in last and self.fits(a, p):
                    last[j] = (p, i)
        return last

    def next_start(self, s: str, c: int, end: int) -> int:
        """The first word's beginning at c or after, or end."""
        while c < end and not self.starts(s, c):
            c += 1
        return c

    def transfer(self, s: str, lo: int, hi: int) -> tuple[list, list, np.ndarray]:
        """The states at lo and at hi, and the weights between; s holds the text around s[lo:hi]."""
        left, right = self.states(s, lo), self.states(s, hi)
        m = np.full((len(left), len(right)), NONE)
        first = self.next_start(s, lo, hi)
        for i, state in enumerate(left):
            begin = lo + state[0]
            if first < hi or self.starts(s, hi) and first == hi:
                whole = begin == first or first in self.walk(s, begin, state[1], first)
                ends = self._ends(s, self._last_start(s, first, hi), OPEN, hi) if whole else set()
            else:
                ends = self._ends(s, lo, state, hi)
            for j, end in enumerate(right):
                if end in ends:
                    m[i, j] = 0.0
        return left, right, m

    def _last_start(self, s: str, first: int, hi: int) -> int:
        c = hi
        while c > first and not self.starts(s, c):
            c -= 1
        return c

    def _ends(self, s: str, at: int, state: tuple[int, int], hi: int) -> set[tuple[int, int]]:
        """The states at hi that follow a state at ``at`` when no word begins between."""
        begin = at + state[0]
        if self.starts(s, hi):
            return {OPEN} if begin == hi or hi in self.walk(s, begin, state[1], hi) else set()
        if begin >= hi:  # a piece over the whole chunk
            return {(begin - hi, state[1])}
        return {(e - hi, p) for e, (p, b) in self.walk(s, begin, state[1], hi).items() if e >= hi and b < hi and e > begin}

    def _trace(self, s: str, begin: int, piece: int, end: int, stop: int) -> list[int]:
        """Ids from begin to the piece that ends at end."""
        last, out = self.walk(s, begin, piece, stop), []
        while end > begin:
            p, b = last[end]
            out += [p] if p != UNKNOWN else [self.sp.piece_to_id(f"<0x{x:02X}>") for x in reversed(s[b:end].encode())]
            end = b
        return out[::-1]

    def trace(self, s: str, lo: int, hi: int, enter: tuple[int, int], leave: tuple[int, int]) -> tuple[list[int], str, list[int]]:
        """The ids of a chunk, of the pieces that begin in it, given the states of its boundaries; between them its whole words, to be encoded."""
        begin, first = lo + enter[0], self.next_start(s, lo, hi)
        end = hi + leave[0]
        if begin >= hi and not (first < hi):
            return [], "", []
        if first == hi and not self.starts(s, hi):
            return self._trace(s, begin, enter[1], end, hi), "", []
        out = self._trace(s, begin, enter[1], first, first)
        last = self._last_start(s, first, hi)
        return out, s[first:last], self._trace(s, last, BARRIER, end, hi) if last < hi else []


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state of each inner boundary on the best way through, by products in a tree.

    The way begins in the only state of the text's beginning and ends in the only one of its end.
    """
    if len(matrices) == 1:
        return []
    pairs = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    outer = scan(pairs)  # the states between pairs
    out: list[int] = []
    for i in range(0, len(matrices), 2):
        enter = outer[i // 2 - 1] if i else 0
        leave = outer[i // 2] if i // 2 < len(outer) else 0
        if i + 1 < len(matrices):
            both = matrices[i][enter, :] + matrices[i + 1][:, leave]
            best = int(both.argmax())
            if both[best] == NONE:
                raise ValueError("no way through a text")
            out.append(best)
        if i // 2 < len(outer):
            out.append(leave)
    return out


@lru_cache(1)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, id_: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, ids) and the columns named in carry, for each row of docs.

    ids are those of the SentencePiece library for the whole text. model: a path that
    every executor can open. Texts of more than ``chunk`` characters are encoded in
    chunks of it, which are dealt to all tasks.

    * A null text has null ids and 0 tokens and chunks, an empty one no ids and 1 chunk.
    * Repeated rows, also of one id, are encoded each by itself. An empty table gives an
      empty table. Carried columns come last, and one named like a result is left out.
    """
    path = model or default_model()
    result = ["doc_id", "n_tokens", "n_chunks", "ids"]
    carry = tuple(c for c in carry if c not in result)
    kept = [f"__carry{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"), *(F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept)))
    types = dict(rows.dtypes)
    tail = "".join(f", {k} {types[k]}" for k in kept)
    giant = F.coalesce(F.length("__text"), F.lit(0)) >= chunk  # the mark before the text counts

    def whole(batches):
        m = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                texts = b.column("__text")
                n, ids = m.encode(*buffers(pc.replace_substring(texts, MARK, " ")))
                null = pc.is_null(texts)
                found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()), mask=null)
                out = [b.column("doc_id"), pa.array(n, pa.int64()), pc.invert(null).cast(pa.int32()), found]
                yield pa.RecordBatch.from_arrays([*out, *(b.column(k) for k in kept)], names=[*result, *kept])
        trim()

    small = rows.where(~giant).mapInArrow(whole, "doc_id long, n_tokens long, n_chunks int, ids array<int>" + tail)

    large = rows.where(giant).withColumn("__key", F.xxhash64("__text"))

    def split(batches):
        m = load(path)
        around = m.longest + 1
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = m.marked(t)
                n = -(-len(s) // chunk)
                for i in range(n):
                    a = max(0, i * chunk - around)
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([i * chunk - a], pa.int32()), pa.array([s[a : (i + 1) * chunk + around]]), pa.array([hash_of(t)], pa.binary())], names=["key", "i", "n", "lo", "body", "digest"])

    # equal giant texts are encoded once
    chunks = large.select("__key", "__text").dropDuplicates(["__key", "__text"]).mapInArrow(split, "key long, i int, n int, lo int, body string, digest binary")
    chunks = chunks.repartition(F.col("key"), F.col("i"))

    def bounds(m: Pieces, i: int, n: int, lo: int, body: str) -> tuple[int, int]:
        return lo, len(body) if i == n - 1 else lo + chunk

    def transfers(batches):
        m = load(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right, w = m.transfer(r["body"], *bounds(m, r["i"], r["n"], r["lo"], r["body"]))
                out.append((r["key"], r["digest"], r["i"], [list(x) for x in left], [list(x) for x in right], w.ravel().tolist()))
            if out:
                states = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.binary(), pa.int32(), states, states, pa.list_(pa.float64())])], names=["key", "digest", "i", "left", "right", "w"])

    def ways(table: pa.Table) -> pa.Table:
        r = table.sort_by("i").to_pylist()
        states = scan([np.array(x["w"]).reshape(len(x["left"]), len(x["right"])) for x in r])
        enter = [list(OPEN)] + [r[i + 1]["left"][q] for i, q in enumerate(states)]
        leave = [*enter[1:], list(OPEN)]
        return pa.table({"key": pa.array([x["key"] for x in r], pa.int64()), "digest": pa.array([x["digest"] for x in r], pa.binary()), "i": pa.array([x["i"] for x in r], pa.int32()), "enter": pa.array(enter, pa.list_(pa.int32())), "leave": pa.array(leave, pa.list_(pa.int32()))})

    way = chunks.mapInArrow(transfers, "key long, digest binary, i int, left array<array<int>>, right array<array<int>>, w array<double>")
    way = way.groupBy("key", "digest").applyInArrow(ways, "key long, digest binary, i int, enter array<int>, leave array<int>")

    def traces(batches):
        m = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                found = [m.trace(r["body"], *bounds(m, r["i"], r["n"], r["lo"], r["body"]), tuple(r["enter"]), tuple(r["leave"])) for r in rows]
                ids = [np.concatenate([a, mid, b]).astype(np.int32) for (a, _, b), mid in zip(found, m.units([x for _, x, _ in found]))]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.int64()), pa.array([r["digest"] for r in rows], pa.binary()), pa.array([r["i"] for r in rows], pa.int32()), lists], names=["key", "digest", "i", "ids"])
        trim()

    traced = chunks.join(way, ["key", "digest", "i"]).select("key", "digest", "i", "n", "lo", "body", "enter", "leave").mapInArrow(traces, "key long, digest binary, i int, ids array<int>")
    traced = traced.groupBy("key", "digest").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("c"))
    traced = traced.select(F.col("key").alias("__key"), "digest", F.flatten("c.ids").alias("ids"), F.size("c").alias("n_chunks"))
    encoded = large.withColumn("digest", F.unhex(F.md5("__text"))).drop("__text").join(traced, ["__key", "digest"])
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "ids", *kept)
    out = small.unionByName(encoded)
    return out.select(*result, *(F.col(k).alias(c) for c, k in zip(carry, kept)))


def hash_of(text: str) -> bytes:
    import hashlib

    return hashlib.md5(text.encode()).digest()


def decode_pieces(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """encoded with text, the decoded ids, as the library decodes them.

    Null ids give a null text, no ids an empty one. A column text of encoded is replaced;
    rows that repeat are decoded each by itself, and an empty table gives an empty table.
    """
    path = model or default_model()
    names = [c for c in encoded.columns if c != "text"]
    kept = [f"__c{i}" for i in range(len(names))]
    rows = encoded.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)), F.col(ids).cast("array<int>").alias("__ids"))

    def texts(m: Pieces, lists: pa.ListArray) -> pa.Array:
        null = pc.is_null(lists)
        offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
        if m.plain[flat].all():
            data, n = m.decode(offsets, flat)
            at = np.append(0, np.cumsum(n)).astype(np.int64)
            valid = pa.py_buffer(np.packbits(~null.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
            out = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes()), valid).cast(pa.string())
            try:
                out.validate(full=True)
                return out
            except pa.ArrowInvalid:  # bytes that aren't UTF-8
                pass
        return pa.array([None if x is None else m.sp.decode(x) for x in lists.to_pylist()], pa.string())

    def run(batches):
        m = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), texts(m, b.column("__ids"))], names=[*kept, "text"])
        trim()

    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in kept) + ", text string")
    return out.select(*(F.col(k).alias(c) for c, k in zip(names, kept)), "text")
