"""Benchmark decontamination with an FM-index per shard of training documents.

Words are runs of digits, lower-cased letters and characters beyond ASCII.  A window is ten
consecutive words of a benchmark item, or a whole item of fewer words.  Every shard keeps the
words of its documents that occur in the benchmark at all, in runs long enough for a window;
anything else is a separator.  Its FM-index is searched backwards for all windows, occurrences
are located by sampled suffix positions, and overlapping spans are merged.

Benchmark windows are made by Spark, distinct, and dealt to blocks of bounded size.  One block at
a time is gathered and broadcast, and the documents are searched for it; most benchmarks are one
block.  With more, the findings are kept as word ranges by row and merged at the end, so neither
the driver nor a worker ever holds more than a block.

Defined results: null and empty texts have no words and are never hit; an item without words
has no window; items that repeat an id count once; a null item id counts as the id "null";
repeated document rows are judged one by one; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, delete, forget, map_batches, materialise, tidied, written
from skein.llm.fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 4_000_000
#: Windows, counted once for each of their items, that a block holds on the average.
BLOCK_WINDOWS = 200_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """The words of a text; only A-Z are lower-cased, and so are bytes."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Block:
    """Windows of some benchmark items over their own vocabulary."""

    def __init__(self, windows: list[tuple[bytes, ...]], items: list[set[str]]) -> None:
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in windows for w in x), 1)}
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.patterns = np.zeros((len(windows), int(self.lengths.max(initial=1))), np.int32)
        for i, x in enumerate(windows):
            self.patterns[i, : len(x)] = [self.vocabulary[w] for w in x]
        self.items = [sorted(x) for x in items]
        self.shortest = int(self.lengths.min(initial=WINDOW))


class Blocks:
    """The windows of a benchmark, written in blocks that are gathered one at a time."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str) -> None:
        self.spark = items.sparkSession
        bounded_batches(self.spark)
        schema = pa.schema([("item", pa.string()), ("window", pa.binary())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                    words = words_of(text.as_py())
                    windows = {b" ".join(words[k : k + WINDOW]) for k in range(max(1, len(words) - WINDOW + 1) if words else 0)}
                    yield pa.RecordBatch.from_pydict({"item": [item] * len(windows), "window": list(windows)}, schema)

        rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.path = written(rows.mapInArrow(cut, "item string, window binary").distinct())
        self.count = max(1, -(-self._windows().count() // BLOCK_WINDOWS))

    def _windows(self) -> DataFrame:
        return self.spark.read.schema("item string, window binary").parquet(self.path)

    def __iter__(self):
        """Each block as a broadcast, which is destroyed when the next one is asked for."""
        for k in range(self.count):
            found: dict[bytes, set[str]] = {}
            for row in self._windows().where(F.pmod(F.xxhash64("window"), F.lit(self.count)) == k).toLocalIterator():  # about BLOCK_WINDOWS rows
                found.setdefault(bytes(row["window"]), set()).add(row["item"])
            shared = self.spark.sparkContext.broadcast(Block([tuple(w.split(b" ")) for w in found], list(found.values())))
            yield shared
            if self.count > 1:
                shared.destroy()
        delete(self.spark, [self.path])


def _long_runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Which places of ``ids`` are in a run of at least ``shortest`` nonzero ones."""
    inside = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    good = ends - starts >= shortest
    mark = np.zeros(len(ids) + 1, np.int32)
    np.add.at(mark, starts[good], 1)
    np.add.at(mark, ends[good], -1)
    return np.cumsum(mark[:-1]) > 0


class Shard:
    """Some documents, with the words that any window hits."""

    def __init__(self, texts: list[str]) -> None:
        self.words = [words_of(t) for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.hit = np.zeros(int(self.starts[-1]), bool)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, block: Block) -> None:
        get = block.vocabulary.get
        parts, places = [], []
        for d, words in enumerate(self.words):
            if len(words) < block.shortest:
                continue
            ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
            keep = np.flatnonzero(_long_runs(ids, block.shortest))
            if not len(keep):
                continue
            gaps = np.flatnonzero(np.diff(keep) > 1) + 1  # a separator in front of each further run, and behind the last
            parts += [np.insert(ids[keep], gaps, 0), np.zeros(1, np.int32)]
            places += [np.insert(keep, gaps, 0) + self.starts[d], np.zeros(1, np.int64)]
        if not parts:
            return
        place = np.concatenate(places)
        index = FMIndex(np.concatenate(parts))
        lo, hi = index.search(block.patterns, block.lengths)
        n = hi - lo
        found = np.repeat(np.arange(len(n)), n)
        if not len(found):
            return
        rows = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n) + lo[found]
        at = place[index.locate(rows)]
        mark = np.zeros(len(self.hit) + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + block.lengths[found], -1)
        self.hit |= np.cumsum(mark[:-1]) > 0
        docs = np.searchsorted(self.starts, at, side="right") - 1
        for d, w in np.unique(np.stack([docs, found], axis=1), axis=0):
            self.items[d].update(block.items[w])

    def hit_ranges(self, d: int) -> list[tuple[int, int]]:
        """Merged ranges of hit words of one document."""
        edge = np.diff(np.concatenate([[0], self.hit[self.starts[d] : self.starts[d + 1]].view(np.int8), [0]]))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of word ranges."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    words = np.array([m.span() for m in _WORD.finditer(raw)], np.int64).reshape(-1, 2)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # in front of each byte
    return [(int(chars[words[a, 0]]), int(chars[words[b - 1, 1]])) for a, b in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ROW = "words long, first array<long>, last array<long>, items array<string>"
_FOUND = ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def _searcher(block):
    """A mapper of (row, id, text) to their words, the ranges of those that windows of ``block`` hit, and the items."""

    def judge(rows: list[tuple[int, str, str]]) -> pd.DataFrame:
        shard = Shard([r[2] for r in rows])
        shard.search(block.value)
        out = []
        for d, (row, i, text) in enumerate(rows):
            ranges = shard.hit_ranges(d) if shard.items[d] else []
            out.append((row, i, text if ranges else None, int(shard.counts[d]), [a for a, _ in ranges], [b for _, b in ranges], sorted(shard.items[d])))
        return pd.DataFrame(out, columns=["row", "id", "text", "words", "first", "last", "items"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str, str]] = []
        size = 0
        for batch in batches:
            for row in zip(batch["row"], batch["id"], batch["text"], strict=True):
                held.append(row)
                size += len(row[2])
                if size >= SHARD_BYTES:
                    yield judge(held)
                    held, size = [], 0
        if held:
            yield judge(held)

    return run


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            ranges = merged(list(zip(r.first, r.last, strict=True)))
            items = sorted(set(r.items))
            spans = [{"start": a, "end": b} for a, b in _spans(r.text, ranges)] if ranges else []
            n_hit = int(sum(b - a for a, b in ranges))
            rows.append((r.id, r.words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, spans))
        yield pd.DataFrame(rows, columns=_FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, hit words, items, and merged spans to remove."""
    blocks = Blocks(items, item_col, item_text_col)
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out_type = "id string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"

    def whole(search):
        return rows.mapInPandas(tidied(lambda batches: _told(search(batches))), out_type)

    if blocks.count == 1:
        [told] = [whole(_searcher(block)) for block in blocks]
    else:
        # A row has one number for all blocks.
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
        parts = [materialise(rows.mapInPandas(tidied(_searcher(block)), f"row long, id string, text string, {_ROW}")) for block in blocks]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        found = materialise(every.groupBy("row").agg(F.first("id").alias("id"), F.max("text").alias("text"), F.first("words").alias("words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("first", "last", "items"))))
        for part in (rows, *parts):
            forget(part)
        told = found.mapInPandas(_told, out_type)
    id_type = docs.schema[id_col].dataType.simpleString()
    return told.select(F.col("id").cast(id_type).alias(id_col), *_FOUND[1:])


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window hits."""
    blocks = Blocks(items, item_col, item_text_col)
    left, former = docs, None
    for block in blocks:
        left = _clean(left, docs.columns.index(text_col), block)
        if blocks.count > 1:
            left = materialise(left)
            forget(former)
            former = left
    return left


def _clean(docs: DataFrame, place: int, block) -> DataFrame:
    def judge(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard([t or "" for batch in held for t in batch.column(place).to_pylist()])
        shard.search(block.value)
        total = np.concatenate([[0], np.cumsum(shard.hit)])
        clean = total[shard.starts[1:]] == total[shard.starts[:-1]]
        at = 0
        for batch in held:
            yield batch.filter(pa.array(clean[at : at + len(batch)]))
            at += len(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.column(place).nbytes for b in held) >= SHARD_BYTES:
                yield from judge(held)
                held = []
        if held:
            yield from judge(held)

    return map_batches(docs, run)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the merged spans, each of which leaves a line break."""
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], "\n"]
        at = end
    return "".join([*out, text[at:]])
