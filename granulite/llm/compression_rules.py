"""Quality rules: base counts, and Zstandard compression bands.

A repetitive text compresses too well, a random one hardly at all. The compressed
size of a text, divided by its size, must lie in a band that depends on its length,
since a short text compresses less than a long one of the same kind. A text may be
repetitive or random in one stretch only, so fixed chunks of it are held against a
band of their own, and the share of chunks outside is limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, buffers, words, windows, mix

_U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACES = " \t\n\v\f\r"
#: Bytes below which a row holds; least and largest ratio of a whole text. The last holds for all longer ones.
#: Largest ratios lie between those of prose and of noise of that length: random letters and digits from 256 bytes on, random lower-case letters from 1,024 on.
DOCUMENT_BANDS = (
    (64, 0.0, 2.0), (128, 0.45, 1.25), (256, 0.45, 1.10), (384, 0.45, 0.82), (512, 0.45, 0.79), (640, 0.44, 0.76), (768, 0.44, 0.74), (1024, 0.44, 0.70), (1280, 0.41, 0.61), (1536, 0.41, 0.595),
    (2048, 0.41, 0.575), (3072, 0.39, 0.565), (4096, 0.39, 0.56), (8192, 0.365, 0.55), (16384, 0.365, 0.54), (1 << 62, 0.31, 0.52),
)
#: Bytes of a chunk (a last one of less than half of it goes with the one before), its band, and the percentage of chunks that may lie outside it.
CHUNK, CHUNK_BAND, CHUNKS_OUTSIDE = 2048, (0.36, 0.575), 25
LEVEL = 3


def _repeated(w, n: int = 5) -> np.ndarray:
    """By word: whether a window of n words that its text holds twice or more covers it."""
    h = windows(w.hash, n)
    i = np.flatnonzero(w.doc[: len(h)] == w.doc[n - 1 :])
    k = h[i] ^ mix(w.doc[i].astype(_U))
    order = np.argsort(k)
    s = k[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(k), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(w.doc) + 1, np.int64)
    change[i[twice]] += 1  # each window begins at another word
    change[i[twice] + n] -= 1
    return np.cumsum(change[:-1]) > 0


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; a null has none."""
    out = {k: [np.empty(0, np.int64)] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    for w in words(texts):
        full = np.flatnonzero(np.diff(w.offsets) > 0)
        heads = w.offsets[:-1][full]
        n = w.counts()
        out["n_words"].append(n)
        out["n_repeat_words"].append(np.bincount(w.doc[_repeated(w)] - w.first, minlength=w.n_docs))
        for name, hit in (("word_chars", NOT_SPACE[w.data] & ((w.data & 0xC0) != 0x80)), ("n_symbols", SYMBOLS[w.data])):
            c = np.zeros(w.n_docs, np.int64)
            if len(heads):
                c[full] = np.add.reduceat(hit.astype(np.int64), heads)
            out[name].append(c)
    dup = []
    for t in texts.to_pylist():
        lines = [x for x in (t or "").split("\n") if x.strip(SPACES)]
        dup.append(len(lines) - len(set(lines)))
    return {k: np.concatenate(v) for k, v in out.items()} | {"n_dup_lines": np.array(dup, np.int64)}


def band(size: int, bands=DOCUMENT_BANDS) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if size < below)


def chunks(data: memoryview, size: int = CHUNK) -> list[memoryview]:
    n = max(1, (len(data) + size // 2) // size)
    return [data[i * size : (i + 1) * size if i < n - 1 else len(data)] for i in range(n)]


class Ratios:
    """Compressed size by size, of frames without a content size or checksum."""

    def __init__(self, level: int = LEVEL):
        self.c = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def __call__(self, data) -> float:
        return len(self.c.compress(data)) / len(data)


def verdict(ratio: float, chunk_ratios: list[float], size: int, bands=DOCUMENT_BANDS, chunk_band=CHUNK_BAND, outside: int = CHUNKS_OUTSIDE) -> bool:
    lo, hi = band(size, bands)
    bad = sum(not chunk_band[0] <= r <= chunk_band[1] for r in chunk_ratios)
    return lo <= ratio <= hi and bad * 100 <= outside * len(chunk_ratios)


def compression_rules(docs: DataFrame, id_: str = "doc_id", text: str = "text", bands=DOCUMENT_BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, outside: int = CHUNKS_OUTSIDE, level: int = LEVEL) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, n_chunks, chunks_outside) of each row.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated
    windows of 5. kept: not base_failed, and within the compression bands; a text
    shorter than two chunks is judged whole only, one of a chunk's size or more also
    by its chunks.

    * A null, empty or wordless text has no words, so base_failed; an empty one has no
      ratio and no chunks.
    * Each row is judged by itself: repeated rows get equal results, ids aren't read.
    * An empty table gives an empty table; further columns of docs are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        ratio_of = Ratios(level)
        for batch in batches:
            texts = batch.column(1)
            base = base_counts(texts)
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            offsets, data = buffers(texts)
            view = memoryview(data)
            ratio, n_chunks, n_outside, kept = [], [], [], []
            for i in range(len(texts)):
                x = view[offsets[i] : offsets[i + 1]]
                if not len(x):
                    ratio.append(None), n_chunks.append(0), n_outside.append(0), kept.append(False)
                    continue
                r = ratio_of(x)
                each = [ratio_of(y) for y in chunks(x, chunk)] if len(x) >= 2 * chunk else []
                ratio.append(r), n_chunks.append(len(each))
                n_outside.append(sum(not chunk_band[0] <= q <= chunk_band[1] for q in each))
                kept.append(verdict(r, each, len(x), bands, chunk_band, outside))
            cols = [batch.column(0), *(pa.array(base[k], pa.int64()) for k in names), pa.array(failed), pa.array(np.array(kept, bool) & ~failed)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ratio, pa.float64()), pa.array(n_chunks, pa.int32()), pa.array(n_outside, pa.int32())], names=["doc_id", *names, "base_failed", "kept", "ratio", "n_chunks", "chunks_outside"])

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, ratio double, n_chunks int, chunks_outside int"
    return rows.mapInArrow(run, schema)
