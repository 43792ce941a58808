"""Hashed text features for the classifiers, and the optimiser they share.

A text's features are the hashes, into 2**DIM_BITS dimensions, of its distinct words, of its words' first four and five
letters (bytes), and, if asked for, of its shape: binned shares of words that are upper-case, repeat their predecessor,
end in symbols or hold no letter, of distinct words, and the binned length. All of a text counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import kernel as K
from loomwell.llm.scratch import small_batches

DIM_BITS = 18
DIM = 1 << DIM_BITS
SHAPE_BINS = 12
#: Dimensions kept for shape features, below those of the hashed words.
SHAPE_DIMS = 8 * SHAPE_BINS
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()"]] = True


def _bins(share: np.ndarray) -> np.ndarray:
    """Bins of shares that are fine near 0: 0, then up to 1/1024, ..., up to 1."""
    return np.where(share <= 0, 0, np.clip(np.ceil(11 + np.log2(np.maximum(share, 1e-9))), 1, SHAPE_BINS - 1)).astype(np.int64)


def _shape(w: K.Words, raw_upper: np.ndarray) -> np.ndarray:
    """(texts, 6) feature numbers of the shape of each text."""
    n = np.maximum(w.per_doc(), 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=flag, minlength=w.n_docs) / n

    alpha = np.concatenate(([0], np.cumsum(_ALPHA[w.lower])))
    letters = alpha[w.end] - alpha[w.start]
    upper = np.concatenate(([0], np.cumsum(raw_upper)))
    caps = upper[w.end] - upper[w.start]
    size = w.end - w.start
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = K.sorted_by_doc(w.doc, w.hash)
    distinct = np.bincount(w.doc[order], weights=K.first_of_run(w.doc[order], w.hash[order]), minlength=w.n_docs) / n
    marks = size - letters
    columns = [share((caps >= 2) & (caps == letters)), share(same), share(marks >= 2), share(letters == 0), 1 - distinct]
    out = np.stack([_bins(c) + k * SHAPE_BINS for k, c in enumerate(columns)], 1)
    length = np.minimum(np.log2(n).astype(np.int64), SHAPE_BINS - 1) + 5 * SHAPE_BINS
    return np.concatenate((out, length[:, None]), 1)


def slice_features(w: K.Words, data: np.ndarray, shape: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, dimension) pairs without repeats, sorted by text."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):  # trim common punctuation
        more = (end - start > 1) & _TRIM[w.lower[end - 1]]
        end = end - more
        more = (end - start > 1) & _TRIM[w.lower[start]]
        start = start + more
    span = lambda k: K._spans(w.sums, start, np.minimum(start + k, end))
    size = end - start
    room = np.uint64(DIM - SHAPE_DIMS)
    docs, dims = [w.doc], [span(1 << 40)]
    for k, salt in ((4, 11), (5, 12)):
        long = size > k
        docs.append(w.doc[long])
        dims.append(K.mix(span(k)[long] + np.uint64(salt)))
    doc, dim = np.concatenate(docs), (np.concatenate(dims) % room).astype(np.int64) + SHAPE_DIMS
    if shape:
        upper = (data >= 65) & (data < 91)
        s = _shape(w, upper)
        doc = np.concatenate((doc, np.repeat(np.arange(w.n_docs), s.shape[1])))
        dim = np.concatenate((dim, s.ravel()))
    code = np.unique(doc * DIM + dim)
    return code // DIM, code % DIM


def batch_features(column: pa.Array, shape: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of a text column: first text, number of texts, and (text in the slice, dimension) pairs."""
    data, offsets = K.text_buffers(column)
    for i, j in K.slices(offsets):
        w = K.words_of(data, offsets[i : j + 1], i)
        doc, dim = slice_features(w, data[offsets[i] : offsets[j]], shape)
        yield i, j - i, doc, dim


def held_out(folds: int, fold: int):
    """Whether a row's crc32 of doc_id (as text) modulo ``folds`` is ``fold``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, shape: bool, folds: int, fold: int,
                  change: Callable[[str], str] | None = None) -> dict[str, np.ndarray]:
    """Features of at most ``most`` labelled rows outside the fold: equally many of each grade as far as there are, those
    with the smallest hashes of doc_id. ``change`` gives a second version of each text. All grades are learned; their
    numbers, one row a grade, come to the driver.

    Returns y; for 'x' (and 'z', the texts that were changed, of the rows numbered in 'z_at') row pointers and dimensions; and
    of each grade in 'grades' its number of labelled documents outside the fold ('sizes').
    """
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    # one label a document: the largest of repeated ones
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect()}
    each = max(1, most // max(1, len(sizes)))
    shares = [(y, max(1, int(1_000_000 * min(1.0, each / n)))) for y, n in sizes.items()]
    limits = F.broadcast(docs.sparkSession.createDataFrame(shares, "y int, share int"))  # one row a grade
    chosen = usable.join(limits, "y").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))
    chosen = chosen.select("doc_id", "y")  # about ``most`` rows: small enough to send to every task
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions = [("x", batch.column(0))]
            if change:
                texts = batch.column(0).to_pylist()
                changed = [change(t or "") for t in texts]
                same = [t == (s or "") for s, t in zip(texts, changed)]
                versions.append(("z", pa.array(["" if k else t for k, t in zip(same, changed)], pa.string())))
            out: dict[str, list] = {}
            for name, column in versions:
                out[name] = []
                for _, n, doc, dim in batch_features(column, shape):
                    cuts = np.cumsum(np.bincount(doc, minlength=n))[:-1]
                    out[name] += [d.astype(np.int32).tobytes() for d in np.split(dim, cuts)]
            x = out["x"]
            z = [None if k else d for k, d in zip(same, out["z"])] if change else [None] * len(x)  # null: as x
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.binary()), pa.array(z, pa.binary())], ["y", "x", "z"])

    got = rows.select("text", "y").mapInArrow(run, "y int, x binary, z binary").toArrow()
    result: dict[str, np.ndarray] = {"y": got["y"].to_numpy().astype(np.int64), "grades": np.array(list(sizes), np.int64), "sizes": np.array(list(sizes.values()), float)}
    result["x_ptr"], result["x_dim"] = _joined(got["x"])
    if change:
        result["z_at"] = np.flatnonzero(got["z"].is_valid().to_numpy())
        result["z_ptr"], result["z_dim"] = _joined(got["z"].drop_null())
    return result


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row pointers into, and all of, the 32-bit numbers that the values of a binary column hold."""
    sizes, numbers = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk) and offsets is not None:
            at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            sizes.append(np.diff(at) // 4)
            if data is not None:
                numbers.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int32))
    return np.cumsum(np.concatenate(sizes)), np.concatenate(numbers)


def _blocks(ptr: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` entries, so that sums over all rows need little memory beside the rows."""
    i = 0
    while i < len(ptr) - 1:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + most, "right")) - 1)
        yield i, j
        i = j


def row_sums(weights: np.ndarray, ptr: np.ndarray, dim: np.ndarray) -> np.ndarray:
    out = np.empty(len(ptr) - 1)
    for i, j in _blocks(ptr):
        sums = np.concatenate(([0.0], np.cumsum(weights[dim[ptr[i] : ptr[j]]])))
        cuts = ptr[i : j + 1] - ptr[i]
        out[i:j] = sums[cuts[1:]] - sums[cuts[:-1]]
    return out


def column_sums(per_row: np.ndarray, ptr: np.ndarray, dim: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size)
    for i, j in _blocks(ptr):
        out += np.bincount(dim[ptr[i] : ptr[j]], weights=np.repeat(per_row[i:j], np.diff(ptr[i : j + 1])), minlength=size)
    return out


def common_dims(data: dict[str, np.ndarray], least: int) -> np.ndarray:
    """Dimensions that at least ``least`` training rows have."""
    return np.flatnonzero(column_sums(np.ones(len(data["y"])), data["x_ptr"], data["x_dim"], DIM) >= least)


def project(data: dict[str, np.ndarray], dims: np.ndarray) -> dict[str, np.ndarray]:
    """The rows with only these dimensions, renumbered."""
    at = np.full(DIM, -1, np.int32)
    at[dims] = np.arange(len(dims))
    out = {"y": data["y"]}
    for name in ("x", "z"):
        if name + "_ptr" in data:
            kept = row_sums((at >= 0).astype(float), data[name + "_ptr"], data[name + "_dim"])
            new = at[data[name + "_dim"]]
            out[name + "_ptr"] = np.concatenate(([0], np.cumsum(kept.astype(np.int64))))
            out[name + "_dim"] = new[new >= 0]
    return out


def minimise(loss_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, l1: np.ndarray, steps: int, rate: float = 1.0) -> np.ndarray:
    """Accelerated proximal gradient descent (FISTA with backtracking) with an L1 penalty per coordinate."""
    x, y, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        value, grad = loss_and_gradient(y)
        while True:
            new = y - rate * grad
            new = np.sign(new) * np.maximum(0.0, np.abs(new) - rate * l1)
            move = new - y
            if loss_and_gradient(new)[0] <= value + grad @ move + (move @ move) / (2 * rate) + 1e-12 or rate < 1e-9:
                break
            rate *= 0.5
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_next * (new - x)
        if np.abs(new - x).max(initial=0) < 1e-5:
            x = new
            break
        x, t = new, t_next
    return x
