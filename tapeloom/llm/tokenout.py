"""Token-ID output as Arrow files with fixed-size lists, for zero-copy random access to equal-length sequences.

Texts are encoded where they lie; the ids, half the size of the texts, are then dealt by ranges of doc_id and sorted,
and each task writes one Arrow IPC file to the shared folder, first under a name of its attempt and then renamed, so
a lost executor leaves no half file. A row of a file is a sequence: ``ids`` and two bit masks of SEQ entries each
(``mask``: a token, not padding; ``last``: the last token of a document), and ``docs``, the ids of the documents that
end in it. Only a file's last sequence is padded. Nothing is compressed, so a memory map gives row i of a batch by
its offset alone.

Encoding is by the tokenizers library. Where its pre-tokenizer is the byte-level one, the boundaries of its words are
found for many texts at once by arrays over their bytes: changes of class between letters, digits, white space and the
rest, for ASCII and the Latin letters of two bytes. What stands between two spaces with any other character, an
apostrophe or an added token stays one piece. The library's merges run once for each different word, and its whole
encoder for each different piece; both are remembered for a while, and the ids gathered as arrays.

Defined results: null counts as the empty text and yields the end id alone; rows of one doc_id stand together in order
of a hash of the text, then of their ids; null ids come first; very long texts are encoded whole; an empty table gives
no rows; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import filesystem, fresh_path, slices

SEQ = 2048
ROWS = 256  # sequences of a record batch
END_ID = 2
GROUP = 8_000_000  # bytes encoded at once
MEMO = 250_000  # pieces that a worker process remembers, about 200 bytes each
#: Classes of bytes. The last two: the end of a text (no byte of UTF-8), and what only the library can part.
LETTER, DIGIT, OTHER, WHITE, END, ODD = range(6)
END_BYTE = 255
CLASS = np.full(256, ODD, np.uint8)
for _c in range(33, 127):
    CLASS[_c] = LETTER if chr(_c).isalpha() else DIGIT if chr(_c).isdigit() else OTHER
CLASS[[9, 10, 11, 12, 13, 32]], CLASS[ord("'")], CLASS[END_BYTE] = WHITE, ODD, END
CLASS[0xC3:0xCA] = CLASS[0x80:0xC0] = LETTER  # U+00C0 to U+027F; others have an odd first byte


class Encoder:
    """Whole texts to their ids, little-endian unsigned."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.dtype("<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        plain = all(not (t.lstrip or t.rstrip or t.single_word) and not any(c.isspace() for c in t.content) for t in added)
        self.direct = plain and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {b: x for c in map(chr, range(0x280)) for b, x in zip(c.encode(), spell(c)[0][0])}
        self.memo: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, new: list[bytes]) -> list[bytes]:
        """Ids of words as the pre-tokenizer parts them: the merges alone."""
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(x)] for x in bytes([END_BYTE]).join(new).decode("latin-1").translate(self.spelled).split(chr(END_BYTE))] if new else []
        raw, cut = np.array([i for x in found for i in x], self.dtype).tobytes(), (np.cumsum([len(x) for x in found]) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def boundaries(self, data: np.ndarray, texts: bytes) -> np.ndarray:
        """Where the words begin, by the byte-level rules; each end of a text is a word too."""
        kind = CLASS[data]
        kind[:-1][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = ODD  # the signs among the letters
        for token in self.added:
            at = texts.find(token)
            while at >= 0:
                kind[at : at + len(token)] = ODD
                at = texts.find(token, at + len(token))
        before, own = kind[:-1], kind[1:]
        text = (own != WHITE) & (own != END)
        cut = (before != own) & ~((data[:-1] == 32) & text)  # a space goes with the word behind it
        cut |= before == END
        cut[:-1] |= (before[:-1] == WHITE) & (own[:-1] == WHITE) & text[1:]  # of more white space the last only
        if (kind == ODD).any():
            safe = (before == END) | (own == END)
            safe[:-1] |= (data[1:-1] == 32) & text[1:] & (own[1:] != ODD)
            stretch = np.concatenate([[0], np.cumsum(safe, dtype=np.int32)])
            odd = np.bincount(stretch[kind == ODD], minlength=int(stretch[-1]) + 1) > 0
            cut = safe | (cut & ~odd[stretch[1:]])
        return np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id behind each, and how many there are of each text."""
        end, width = np.array([END_ID], self.dtype).tobytes(), self.dtype.itemsize
        if not self.direct:
            raw = [x + end for x in self.whole([x.decode() for x in texts])]
            return np.frombuffer(b"".join(raw), self.dtype), np.array([len(x) // width for x in raw], np.int64)
        joined = bytes([END_BYTE]).join([*texts, b""])
        data = np.frombuffer(joined, np.uint8)
        at = self.boundaries(data, joined)
        coded = pc.dictionary_encode(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)]))
        kinds, memo = coded.dictionary.to_pylist(), self.memo
        if len(memo) > MEMO:  # what this group has too is likely to come again
            memo = self.memo = {x: memo[x] for x in kinds if x in memo}
        memo[bytes([END_BYTE])] = end
        edges = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(kinds)]
        letters = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
        odd = np.logical_or.reduceat(CLASS[letters] == ODD, edges).tolist()
        if added := [t for t in self.added if t in joined]:
            odd = [o or any(t in x for t in added) for x, o in zip(kinds, odd, strict=True)]
        new = [x for x, o in zip(kinds, odd) if not o and x not in memo]
        memo.update(zip(new, self.words(new), strict=True))
        new = [x for x, o in zip(kinds, odd) if o and x not in memo]
        memo.update(zip(new, self.whole([x.decode() for x in new]), strict=True))
        entries = [memo[x] for x in kinds]
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // width
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(entries), self.dtype)
        of = coded.indices.to_numpy()
        long = size[of]
        upto = np.cumsum(long)
        ends = upto[data[at[:-1]] == END_BYTE]
        return flat[np.repeat(start[of] - (upto - long), long) + np.arange(upto[-1])], np.diff(ends, prepend=0)


#: The encoder of each vocabulary that this worker process has loaded; later tasks of the process use it again.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Stretches of about GROUP bytes, a text at least."""
    at = room = 0
    for i, n in enumerate(sizes):
        if i > at and room + n > GROUP:
            yield slice(at, i)
            at, room = i, 0
        room += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def encoded(docs: DataFrame, tokenizer: str, bounds: list[int | None], *, id_col: str, text_col: str) -> DataFrame:
    """(shard, doc_id, place, ids) of every row: place orders equal doc_ids, and spreads an id that fills several shards."""
    edges = np.array(bounds, np.int64)

    def run(batches):
        coder = encoder(tokenizer)
        for b in batches:
            doc, place = b.column(0), b.column(1).to_numpy()
            some, key = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
            share = (place.astype(np.float64) + 2.0**63) / 2.0**64
            shard = np.where(some, low + np.floor(np.minimum(share, 1 - 1e-12) * (high - low + 1)).astype(np.int64), 0).astype(np.int32)
            texts = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            for part in _groups([len(x) for x in texts]):
                ids, sizes = coder.encode(texts[part])
                offsets = pa.py_buffer((np.concatenate([[0], np.cumsum(sizes)]) * coder.dtype.itemsize).astype(np.int32).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(shard[part]), doc[part], b.column(1)[part], binary], names=["shard", "doc_id", "place", "ids"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("place"), text.alias("text"))
    return rows.mapInArrow(run, "shard int, doc_id long, place long, ids binary")


class ShardWriter:
    """Packs documents into sequences and writes them in batches of ROWS."""

    def __init__(self, sink, dtype: np.dtype, seq: int):
        self.seq, self.dtype = seq, dtype
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, seq)), ("mask", pa.list_(pa.bool_(), seq)), ("last", pa.list_(pa.bool_(), seq)), ("docs", pa.list_(pa.int64()))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.room = self.total = 0

    def add(self, docs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents one behind the other: their names, all their ids, and how many each has."""
        self.held.append(ids)
        self.ends.append(self.room + np.cumsum(sizes) - 1)
        self.docs.append(docs)
        self.room += len(ids)
        self.total += len(ids)
        if self.room >= 4 * ROWS * self.seq:
            self.flush(False)

    def flush(self, final: bool) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.held])
        ends, docs = np.concatenate([np.zeros(0, np.int64), *self.ends]), pa.concat_arrays([pa.array([], pa.int64()), *self.docs])
        rows = -(-len(flat) // self.seq) if final else len(flat) // self.seq
        size, whole = rows * self.seq, min(rows * self.seq, len(flat))
        ids = np.concatenate([flat[:whole], np.zeros(size - whole, self.dtype)])
        inside = int(np.searchsorted(ends, whole))
        last = np.zeros(size, bool)
        last[ends[:inside]] = True
        upto = np.searchsorted(ends[:inside], np.arange(rows + 1) * self.seq)
        named = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), docs[:inside])
        columns = [pa.FixedSizeListArray.from_arrays(x, self.seq) for x in (pa.array(ids), pa.array(np.arange(size) < whole), pa.array(last))]
        if rows:
            self.out.write_table(pa.Table.from_arrays([*columns, named], schema=self.schema), max_chunksize=ROWS)
        self.held, self.ends, self.docs = [flat[whole:].copy()], [ends[inside:] - whole], [docs[inside:]]
        self.room = len(flat) - whole

    def close(self) -> None:
        self.flush(True)
        self.out.close()


def shard_bounds(docs: DataFrame, *, id_col: str, shards: int | None, shard_rows: int) -> list[int]:
    """doc_ids that part the rows into about equal shards: quantiles from one pass over the ids alone."""
    n = docs.count()
    shards = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_rows))
    if shards < 2 or not n:
        return []
    at = [k / shards for k in range(1, shards)]
    return docs.agg(F.percentile_approx(F.col(id_col).cast("long"), at, max(10_000, 20 * shards)).alias("q")).first()["q"] or []


def write(docs: DataFrame, tokenizer: str, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", seq: int = SEQ, shards: int | None = None, shard_rows: int = 250_000) -> tuple[str, list[tuple[int, int]]]:
    """Encode and write all docs; the folder, and the manifest: (shard, ids in it), a pair of numbers a file."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    bounds = shard_bounds(docs, id_col=id_col, shards=shards, shard_rows=shard_rows)

    def run(batches):
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, own = f"{base}/shard-{task.partitionId():07d}.arrow", f"{base}/_attempt-{task.taskAttemptId()}"
        dtype, n = encoder(tokenizer).dtype, 0
        with fs.open_output_stream(own) as sink:
            to = ShardWriter(sink, dtype, seq)
            for b in batches:
                raw = b.column(1)
                at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                ids = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype) if len(raw) else np.zeros(0, dtype)
                to.add(b.column(0), ids, np.diff(at) // dtype.itemsize)
                n += len(raw)
            to.close()
        if n:
            fs.move(own, name)
        else:
            fs.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([to.total], pa.int64())], names=["shard", "n_docs", "n_ids"])

    dealt = encoded(docs, tokenizer, bounds, id_col=id_col, text_col=text_col).repartitionById(len(bounds) + 1, "shard")
    rows = dealt.sortWithinPartitions("doc_id", "place", "ids").select("doc_id", "ids").mapInArrow(run, "shard long, n_docs long, n_ids long").collect()
    return path, sorted((r["shard"], r["n_ids"]) for r in rows if r["n_docs"])


def sequences(path: str, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Batches of a shard: ids, mask and last as flat arrays, and the list of doc ids."""
    from pyarrow import fs as pafs

    fs, base = filesystem(path)
    name = f"{base}/shard-{shard:07d}.arrow"
    with pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name) as source:
        file = pa.ipc.open_file(source)
        for i in range(file.num_record_batches):
            b = file.get_batch(i)
            yield b.column(0).flatten().to_numpy(), *(b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2)), b.column(3).flatten()


def read_documents(spark: SparkSession, path: str, manifest: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    before, rows = 0, []
    for shard, n in manifest:
        rows.append((shard, before))
        before += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in slices(batches):
            for shard, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                crc = n = 0
                for ids, mask, last, docs in sequences(path, shard):
                    ids = ids[: int(mask.sum())]  # padding stands at the end only
                    cut = np.flatnonzero(last) + 1
                    out, at = [], 0
                    for doc, to in zip(docs.to_pylist(), cut.tolist(), strict=True):
                        crc = zlib.crc32(ids[at:to].astype("<u4").tobytes(), crc)
                        out.append((doc, start, n + to - at, crc))
                        start, crc, n, at = start + n + to - at, 0, 0, to
                    crc, n = zlib.crc32(ids[at:].astype("<u4").tobytes(), crc), n + len(ids) - at
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "shard long, start long")
    return table.repartition(len(rows)).mapInArrow(run, schema)
