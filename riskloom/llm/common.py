"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import ship

#: Rows and bytes that a Python operator handles at once; results leave in pieces of this size. One row may be larger.
SLICE, SLICE_BYTES = 1000, 2_000_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slices(batch: pa.RecordBatch, rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `size` bytes."""
    for at in range(0, batch.num_rows, rows):
        open_ = [batch.slice(at, rows)]
        while open_:
            part = open_.pop()
            half = part.num_rows // 2
            if half and part.nbytes > size:
                open_ += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def small_batches(df: DataFrame) -> None:
    """Halves and more the rows of an Arrow batch where the session has Spark's own default: batches of long texts take much memory."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get(ARROW_ROWS)) == 10_000:
        conf.set(ARROW_ROWS, str(2 * SLICE))


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, rows: int = SLICE) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield fn(part)
        release_memory()

    return df.mapInArrow(run, schema)


def kept_fields(df: DataFrame, keep: list[str] | None, outputs: list[str]) -> list[str]:
    """Columns that pass through: all of df's, or those in `keep`; an output of the same name replaces one.
    Spark resolves names without regard to case, so clashes are found that way too."""
    taken = {name.lower() for name in outputs}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def row_spread(*columns: str | Column) -> Column:
    """A number spread evenly over rows, also over rows that repeat a key."""
    return F.xxhash64(*columns, F.monotonically_increasing_id())


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


#: What a Python worker builds once and keeps for its later tasks (a model, a store of words).
_PROCESS: dict = {}


def release_memory() -> None:
    """Give memory that nothing uses back to the system, where the allocators allow it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_process(kind: str, key: str, make: Callable[[], object]) -> object:
    """make() once per worker process for this key; a new key of the same kind takes the place of the old.

    The first word of `kind` names the operator. A worker that serves another operator drops what the one before
    left, so that a sequence of operators needs no more memory than the largest of them.
    """
    if _PROCESS.get(kind, (None,))[0] != key:
        gone = [k for k in _PROCESS if k == kind or k.split()[0] != kind.split()[0]]
        for k in gone:
            del _PROCESS[k]
        if gone:
            release_memory()
        _PROCESS[kind] = (key, make())
    return _PROCESS[kind][1]


class WordStore:
    """Numbers of words, learnt once per distinct word while the store holds it.

    learn(words) gives the flat numbers of these words and how many each word has. The store starts anew before it
    would hold more than about `size` bytes; only the words of a single call may take more.
    """

    #: Bytes of a word beside its characters and numbers: string, place and hash table.
    WORD = 200

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], size: int = 32_000_000, dtype: type = np.int32):
        self.learn, self.size, self.dtype = learn, size, dtype
        self.clear()

    def clear(self) -> None:
        self.place: dict = {}
        self.flat, self.start, self.count, self.held = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def places(self, words: list) -> np.ndarray:
        """Each word's place in the store; the places hold until the next call."""
        distinct = set(words)
        new = list(distinct.difference(self.place))
        if self.place and self.held + self.WORD * len(new) + sum(map(len, new)) > self.size:
            self.clear()
            new = list(distinct)
        if new:
            flat, count = self.learn(new)
            self.place.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            self.held += self.WORD * len(new) + sum(map(len, new)) + self.flat.itemsize * len(flat)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat numbers of the words at these places, and how many each word has."""
        return ragged(self.flat, self.start[places], self.count[places]), self.count[places]


def ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start:start + count] of each row, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - ends + count, count) + np.arange(total)]


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of these lengths."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def split_on_space(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Parts of each text between single spaces: flat codes, number per text, and the distinct parts."""
    parts = pc.split_pattern(texts.fill_null(""), " ")
    counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, coded.dictionary.to_pylist()


class Shared:
    """A broadcast value with an id of its own, the same on driver and executors. For values of a bounded size only."""

    def __init__(self, spark, value: object):
        self._sent = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> object:
        return self._sent.value
