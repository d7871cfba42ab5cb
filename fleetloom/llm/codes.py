"""Short codes for vectors: the nearest entry of a codebook for each part, by cells of a grid that are remembered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.functions.durable import durable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Scaled components beyond this count as this, so that squares and sums of a part stay whole numbers of 64 bits.
MOST = 1 << 27
# Vectors that a task works on at once, and cells that it remembers for each part: a bound on its memory.
AT_ONCE, REMEMBERED = 8192, 20_000


@dataclass(frozen=True)
class Codebooks:
    """``entries`` of whole numbers by part, entry and place; no parts at all if there was no vector."""

    entries: np.ndarray

    @property
    def size(self) -> int:
        """Components of a vector."""
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class CellMemo:
    """The nearest entries of one codebook, by grid cells.

    A cell's box of whole numbers has a least and a greatest distance from each entry. An entry whose least
    distance is above the smallest greatest one is nearest to nothing in the box. The others are remembered
    for the cell, and only they are compared with the vectors in it. A full memo is emptied, which costs
    work but changes no result.
    """

    def __init__(self, book: np.ndarray, remembered: int = REMEMBERED):
        self.book, self.remembered, self.known = book, remembered, {}
        apart = ((book[:, None] - book[None]) ** 2).sum(axis=2).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        near = np.sqrt(np.median(apart.min(axis=1))) if len(book) > 1 else 1.0
        # Cells about as wide as neighbouring entries are apart.
        self.shift = int(np.clip(np.log2(max(near, 1.0)), 0, 26))

    def _candidates(self, cells: np.ndarray) -> list[bytes]:
        """For each cell the entries not dominated across its box, ascending, a byte each."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        book = self.book[None]
        least = (np.maximum(np.maximum(low - book, book - high), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(np.abs(book - low), np.abs(book - high)) ** 2).sum(axis=2)
        # Equal distances stay: the lower index is to win.
        kept = least <= greatest.min(axis=1, keepdims=True)
        return [np.flatnonzero(row).astype(np.uint8).tobytes() for row in kept]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each vector, ties to the lower index."""
        cells = np.ascontiguousarray(vectors >> self.shift)
        width = cells.shape[1] * cells.itemsize
        named, first, cell_of = np.unique(cells.view(np.dtype((np.void, width))).ravel(), return_index=True, return_inverse=True)
        raw = named.tobytes()
        names = [raw[at : at + width] for at in range(0, len(raw), width)]
        absent = [i for i, name in enumerate(names) if name not in self.known]
        fresh = dict(zip([names[i] for i in absent], self._candidates(cells[first[absent]]), strict=True)) if absent else {}
        lists = [fresh[n] if n in fresh else self.known[n] for n in names]
        if len(self.known) + len(fresh) > self.remembered:
            self.known.clear()
        if len(fresh) <= self.remembered:
            self.known |= fresh
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        entries = np.frombuffer(b"".join(lists), np.uint8)
        # One pair for each vector and candidate of its cell.
        each = sizes[cell_of]
        ends = np.cumsum(each)
        starts = ends - each
        row = np.repeat(np.arange(len(vectors)), each)
        within = np.arange(ends[-1]) - starts[row]
        candidate = entries[(np.cumsum(sizes) - sizes)[cell_of][row] + within]
        distance = ((vectors[row] - self.book[candidate]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == least[row])
        winner = hits[np.concatenate(([True], row[hits][1:] != row[hits][:-1]))]
        return candidate[winner].astype(np.int64), least


def usable(vector_col: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable and of the size, and these as whole numbers, a row each."""
    fits = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)) == size
    values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    finite = np.isfinite(values).all(axis=1)
    fits[fits] = finite
    return fits, whole_numbers(values[finite])


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of AT_ONCE at most, as few as may be."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(at, AT_ONCE)
            if held and rows + piece.num_rows > AT_ONCE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
            held.append(piece)
            rows += piece.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def first_entries(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """The parts of the vectors with the smallest ids, in the order of the ids.

    Of rows that share an id, the smallest vector counts; rows without an id are no entries. The first of them
    says how many components a vector has; a multiple of ``parts``.
    """
    chosen: list[tuple] = []
    size = F.size(vector_col)
    able = vectors.where(usable(vector_col) & (size > 0) & (size % parts == 0) & F.col(id_col).isNotNull())
    able = able.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    while len(chosen) < entries:
        # More than one round only if ids repeat among the smallest.
        rest = able.where((F.col("id") > chosen[-1][0]) & (F.size("vector") == len(chosen[0][1]))) if chosen else able
        found = rest.orderBy("id", "vector").limit(entries).collect()
        if not found:
            break
        for row in found:
            if len(chosen) < entries and (not chosen or row.id != chosen[-1][0]) and (not chosen or len(row.vector) == len(chosen[0][1])):
                chosen.append((row.id, row.vector))
    if not chosen:
        return Codebooks(np.zeros((0, 0, 0), np.int64))
    whole = whole_numbers(np.array([vector for _, vector in chosen], dtype=np.float64))
    return Codebooks(np.ascontiguousarray(whole.reshape(len(chosen), parts, -1).transpose(1, 0, 2)))


def refined(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> Codebooks:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it, if any.

    A task hands over one sum for each component of the codebooks, whatever the number of its vectors.
    """
    parts, entries, width = books.entries.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(book) for book in books.entries]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _gathered(batches):
            _, whole = _matrix(batch.column(0), books.size)
            if not len(whole):
                continue
            for part, memo in enumerate(memos):
                own = whole[:, part * width : (part + 1) * width]
                index, _ = memo.nearest(own)
                np.add.at(total[part], index, own)
                count[part] += np.bincount(index, minlength=entries)
        used = np.argwhere(count > 0)
        at = [np.repeat(used[:, i], width).astype(np.int32) for i in (0, 1)]
        place = np.tile(np.arange(width, dtype=np.int32), len(used))
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, at), pa.array(place), pa.array(total[at[0], at[1], place]), pa.array(count[at[0], at[1]])],
            names=["part", "entry", "place", "total", "n"],
        )

    found = vectors.select(vector_col).mapInArrow(sums, "part INT, entry INT, place INT, total BIGINT, n BIGINT")
    moved = books.entries.copy()
    # One row for each component of the codebooks.
    for row in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[row.part, row.entry, row.place] = row.total // row.n
    return Codebooks(moved)


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks from all vectors; every round reads them once. At most 256 entries, as a code has a byte a part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = first_entries(vectors, parts, entries, id_col, vector_col)
    for _ in range(rounds if len(books.entries) else 0):
        books = refined(vectors, books, vector_col)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """All columns but the vector, with ``code`` and ``error``, for each vector that is usable and of the codebooks' size."""
    rest = [f for f in vectors.schema.fields if f.name not in (vector_col, "code", "error")]
    schema = T.StructType([*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not len(books.entries):
        return vectors.sparkSession.createDataFrame([], schema)
    width = books.entries.shape[2]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(book) for book in books.entries]
        for batch in _gathered(batches):
            fits, whole = _matrix(batch.column(0), books.size)
            if not len(whole):
                continue
            codes, error = np.zeros((len(whole), len(memos)), np.uint8), np.zeros(len(whole), np.int64)
            for part, memo in enumerate(memos):
                codes[:, part], distance = memo.nearest(whole[:, part * width : (part + 1) * width])
                error += distance
            held = batch.filter(pa.array(fits))
            written = codes.tobytes().hex()
            step = 2 * len(memos)
            texts = pa.array([written[at : at + step] for at in range(0, len(written), step)], pa.string())
            yield pa.RecordBatch.from_arrays([*held.columns[1:], texts, pa.array(error)], names=schema.names)

    return vectors.select(vector_col, *[f.name for f in rest]).mapInArrow(coded, schema)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector.

    Components are scaled and rounded down to whole numbers (those beyond 2^27 count as that), so results are
    exact. Rows whose vector is NULL, has NULL or non-finite components, or another number of components than
    the vector with the smallest id (of those with a multiple of the parts) have no code and are left out.
    Repeated rows get one result each; a NULL id or label is a value like others. Fewer vectors than
    entries are as many entries. Without vectors there are no rows. ``label_error`` adds the errors of all rows
    of a label, which are summed up in the tasks first.
    """
    books = fit_codebooks(vectors, id_col=id_col, vector_col=vector_col, **settings)
    coded = durable(encode(vectors.select(vector_col, F.col(id_col).alias("vec_id"), F.col(label_col).alias("_label")), books, vector_col))
    per_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    return coded.join(per_label, F.col("_label").eqNullSafe(F.col("_of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
