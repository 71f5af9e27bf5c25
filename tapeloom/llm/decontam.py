"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of WINDOW words of the benchmark items (a shorter item is one window). For each pattern
length a shift table tells, for a block of BLOCK words, how far the search may jump before a pattern can end:
texts are read about every ninth word. Where the shift is 0 the block's bucket names the patterns that end with it,
and direct comparison confirms an occurrence.

A benchmark of at most ``part_bytes`` of text is broadcast. A larger one is dealt into parts of about that size, whose
tables tasks build once and write to the shared folder; each task searches its texts, in stretches of HELD bytes, for
one part after the other, and holds the tables of one: arrays of a bounded size, about 20 times the part's text.

Defined results: null or wordless texts have no words and no hits; very long texts are searched whole; an item without
words can't occur; an item without an id hits words but is not listed; repeated items count once, and items of one id
are one; ids are listed in order as text; repeated rows get equal results; an empty table gives no rows, an empty
benchmark no hits; columns named like a result are replaced.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import filesystem, fresh_path, slices

WINDOW = 10
HELD = 32 << 20
BLOCK = 2
#: A word is a run of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; all else becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Search:
    """Wu-Manber tables for the windows of one length, as arrays.

    shift: for each slot of a block's checksum the least jump of any block that falls into it; a shared slot only makes
    a jump shorter. Windows are known by a sorted 64-bit hash, their place in the texts and their item; the text itself
    confirms an occurrence. About 30 bytes a window and 8 to 16 a block's slot, beside the texts once.
    """

    def __init__(self, length: int, text: bytes, start: np.ndarray, end: np.ndarray, item: np.ndarray, key: np.ndarray, shift: np.ndarray):
        self.length, self.block, self.far = length, min(BLOCK, length), length - min(BLOCK, length) + 1
        self.text, self.start, self.end, self.item, self.key, self.shift = text, start, end, item, key, shift
        self.mask = len(shift) - 1

    @classmethod
    def build(cls, length: int, items: list[tuple[int, list[bytes]]]) -> Search:
        """Tables over (item, words); an item's text is kept once, its words joined by spaces."""
        block = min(BLOCK, length)
        n = sum(len(w) - length + 1 for _, w in items)
        shift = np.full(1 << max(10, (8 * n * (length - block + 1)).bit_length() - 1), length - block + 1, np.uint8)
        mask, parts, start, end, item, key, at = len(shift) - 1, [], [], [], [], [], 0
        for number, words in items:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            text = b" ".join(words)
            slots = np.fromiter((zlib.crc32(text[b:e]) & mask for b, e in zip(begins[: len(words) - block + 1].tolist(), ends[block - 1 :].tolist(), strict=True)), np.int64, len(words) - block + 1)
            for jump in range(length - block + 1):  # a block that ends jump words before a window does
                np.minimum.at(shift, slots[length - block - jump : len(slots) - jump], np.uint8(jump))
            for b, e in zip(begins[: len(words) - length + 1].tolist(), ends[length - 1 :].tolist(), strict=True):
                start.append(at + b)
                end.append(at + e)
                item.append(number)
                key.append(xxhash.xxh64_intdigest(text[b:e]))
            parts.append(text)
            at += len(text)
        order = np.argsort(np.array(key, np.uint64), kind="stable")
        return cls(length, b"".join(parts), np.array(start, np.int64)[order], np.array(end, np.int64)[order], np.array(item, np.int32)[order], np.array(key, np.uint64)[order], shift)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of every occurrence."""
        end, n, shift, mask, crc, two = self.length, len(words), self.shift.data, self.mask, zlib.crc32, self.block == 2
        while end <= n:
            jump = shift[crc(words[end - 2] + b" " + words[end - 1] if two else words[end - 1]) & mask]
            if jump:
                end += jump
                continue
            window = b" ".join(words[end - self.length : end])
            own = np.uint64(xxhash.xxh64_intdigest(window))
            at = int(self.key.searchsorted(own))
            items = set()
            while at < len(self.key) and self.key[at] == own:
                if self.text[self.start[at] : self.end[at]] == window:
                    items.add(int(self.item[at]))
                at += 1
            if items:
                yield end - self.length, items
            end += 1


def tables(items: list[tuple[str | None, bytes]]) -> tuple[list[str | None], list[Search]]:
    """(ids, searches): the searches of every length of window, by the place of an item's id."""
    ids = [i for i, _ in items]
    by: dict[int, list] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        if words:
            by.setdefault(min(WINDOW, len(words)), []).append((number, words))
    return ids, [Search.build(size, own) for size, own in sorted(by.items())]


def _saved(made: tuple[list[str | None], list[Search]]) -> bytes:
    ids, searches = made
    arrays = {f"{k}{c}": getattr(x, c) for k, x in enumerate(searches) for c in ("start", "end", "item", "key", "shift")}
    arrays |= {f"{k}text": np.frombuffer(x.text, np.uint8) for k, x in enumerate(searches)} | {"lengths": np.array([x.length for x in searches], np.int64)}
    names = json.dumps(ids).encode()
    np.savez(out := io.BytesIO(), ids=np.frombuffer(names, np.uint8), **arrays)
    return out.getvalue()


def _loaded(data: bytes) -> tuple[list[str | None], list[Search]]:
    with np.load(io.BytesIO(data)) as x:
        searches = [Search(int(n), x[f"{k}text"].tobytes(), *(x[f"{k}{c}"] for c in ("start", "end", "item", "key", "shift"))) for k, n in enumerate(x["lengths"])]
        return json.loads(x["ids"].tobytes()), searches


def _files(items: DataFrame, n: int) -> list[str]:
    """The tables of the items in n files in the shared folder, dealt by a hash of id and text and built by tasks."""
    path = fresh_path(items.sparkSession, "benchmark")

    def run(batches):
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        own = [(i, t) for b in batches for i, t in zip(b.column(0).cast(pa.string()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
        if own:
            with fs.open_output_stream(attempt := f"{base}/_attempt-{task.taskAttemptId()}") as sink:
                sink.write(_saved(tables(own)))
            fs.move(attempt, name := f"{base}/part-{task.partitionId():07d}.npz")
        yield pa.RecordBatch.from_arrays([pa.array([name] if own else [], pa.string())], names=["name"])

    dealt = items.withColumn("__part", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")).repartitionById(n, "__part").drop("__part")
    whole = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((whole if whole != "file://" else "") + r["name"] for r in dealt.mapInArrow(run, "name string").collect())


def _read(name: str) -> tuple[list[str | None], list[Search]]:
    fs, path = filesystem(name)
    with fs.open_input_stream(path) as source:
        return _loaded(source.read())


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", part_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, n_hit and hit_items (ids as text, sorted)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("t") + 16)).first()[0] or 0
    if size <= part_bytes:  # a proven bound of what is collected and sent
        held = docs.sparkSession.sparkContext.broadcast([(r["i"], bytes(r["t"])) for r in items.collect()])
        parts = [lambda: tables(held.value)]
    else:
        parts = [partial(_read, name) for name in _files(items, -(-size // part_bytes))]
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items")]
    at = docs.columns.index(text_col)
    schema = docs.select(*names).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit_items": F.array().cast("array<string>")}).schema

    def stretches(batches):
        held, room = [], 0
        for b in slices(batches):
            held.append(b)
            room += b.column(at).nbytes
            if len(parts) == 1 or room >= HELD:
                yield held
                held, room = [], 0
        if held:
            yield held

    def run(batches):
        only = parts[0]() if len(parts) == 1 else None
        for held in stretches(batches):
            texts = [x for b in held for x in b.column(at).cast(pa.binary()).to_pylist()]
            marks: dict[int, np.ndarray] = {}
            items: dict[int, set] = {}
            counts = [0] * len(texts)
            for part in parts:
                ids, searches = only or part()
                for i, text in enumerate(texts):
                    words = words_of(text)
                    counts[i] = len(words)
                    for s in searches:
                        for start, own in s.find(words):
                            mark = marks.get(i)
                            if mark is None:
                                mark = marks[i] = np.zeros(len(words) + 1, np.int32)
                            mark[start] += 1
                            mark[start + s.length] -= 1
                            items.setdefault(i, set()).update(ids[k] for k in own)
            n_hit = [int((np.cumsum(marks[i]) > 0).sum()) if i in marks else 0 for i in range(len(texts))]
            listed = [sorted(items.get(i, set()) - {None}) for i in range(len(texts))]
            done = 0
            for b in held:
                own = slice(done, done := done + b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.names.index(c)) for c in names), pa.array(counts[own], pa.int64()), pa.array(n_hit[own], pa.int64()), pa.array(listed[own], pa.list_(pa.string()))],
                    names=[*names, "n_words", "n_hit", "hit_items"],
                )

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark window."""
    return scan(docs, benchmark, **options).where("n_hit = 0").select(*docs.columns)
