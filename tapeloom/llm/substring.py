"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark.

Documents are parted into chunks that follow the order of their ids, so what starts earlier lies in the same chunk or
in one before it. A chunk's task hashes all its windows (a polynomial over 64-bit word hashes, and TAG further bits of
a second polynomial, 80 bits in all), keeps each different hash once and deals them into buckets by their first bits:
a row is a bucket's sorted hashes of one chunk, packed by bytes. A bucket's task counts in how many chunks each hash
stands and tells every chunk but the first. Back with the texts, a window is a repeat if its hash was told or stands
earlier in the chunk; repeats merge into maximal removal intervals.

Texts are shuffled once, by chunk; both uses of them read the same exchange. What a task holds is a chunk (``chunk_bytes``
of text, and one document at least) or a bucket; a passage that a third of all documents share is one hash in each
chunk. Bounds of the chunks are quantiles of the ids, a number a chunk; an id or a missing id that many rows share is
spread over several chunks by a hash of the text.

Defined results: null, empty and wordless texts have no words and keep the empty text; texts of fewer than WINDOW words
lose nothing; very long texts are read whole. Rows without an id come last. Rows of one id stand in the order of a hash
of their texts, then of the texts; repeated rows of the same id and text are one document and get equal results. An
empty table gives no rows; columns named like a result are replaced. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
CHUNK_BYTES, LEAST_CHUNK, MOST_CHUNKS = 8 << 20, 1 << 20, 1 << 16
BUCKET_KEYS = 1 << 22
#: Odd bases of the two polynomials over the integers modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
RESULTS = ("n_words", "n_removed", "removed", "kept_text")
FENCE = 256


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """The polynomial hash of every window of ``size`` hashes, put together from windows of powers of two."""
    span, power, have = 1, np.uint64(base), hashes
    out, taken = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & span:
                n = len(hashes) - taken - span + 1
                piece = have[taken : taken + n]
                out = piece if out is None else out[:n] * power + piece
                taken += span
            if taken == size:
                break
            have = have[: len(have) - span] * power + have[span:]
            power, span = power * power, span * 2
        out = out ^ (out >> np.uint64(32))
        out = out * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def window_keys(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits for each window."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    h = word_hashes(words)
    return rolling(h, size, BASES[0]), (rolling(h, size, BASES[1]) >> np.uint64(48)).astype(np.uint16)


def sorted_order(key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and tag, stable; where in that order a new pair begins)."""
    order = np.argsort(key, kind="stable")
    k, t = key[order], tag[order]
    same = k[1:] == k[:-1]
    if (same & (t[1:] != t[:-1])).any():
        order = np.lexsort((tag, key))
        k, t = key[order], tag[order]
        same = k[1:] == k[:-1]
    return order, np.concatenate([np.ones(min(1, len(key)), bool), ~same | (t[1:] != t[:-1])])


def pack(key: np.ndarray, tag: np.ndarray) -> bytes:
    """Sorted keys byte by byte: the first planes hardly change, so that they compress."""
    return key.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() + tag.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 10
    key = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view(">u8").reshape(-1).astype(np.uint64)
    return key, np.frombuffer(data, np.uint16, n, 8 * n)


def stands_in(key: np.ndarray, tag: np.ndarray, told: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of the pairs stand in the told ones."""
    out = np.zeros(len(key), bool)
    if not told or not len(key):
        return out
    k, t = np.concatenate([x[0] for x in told]), np.concatenate([x[1] for x in told])
    order, _ = sorted_order(k, t)
    k, t = k[order], t[order]
    lo, hi = np.searchsorted(k, key), np.searchsorted(k, key, "right")
    one = hi == lo + 1
    out[one] = t[lo[one]] == tag[one]
    for i in np.flatnonzero(hi > lo + 1).tolist():  # equal keys of different tags
        out[i] = tag[i] in t[lo[i] : hi[i]]
    return out


def intervals(repeat: np.ndarray, n_words: int, size: int) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) of words that windows marked in repeat cover."""
    if not repeat.any():
        return []
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(repeat)
    edge[at] += 1
    np.subtract.at(edge, at + size, 1)
    covered = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
    turn = np.diff(covered)
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True))


def _chunk_of(bounds: list[int], key: Column, spread: Column) -> Column:
    """The number of bounds below key; a key that equals several is spread over their chunks by ``spread`` in [0, 1)."""
    if not bounds:
        return F.lit(0)
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    fence = F.split(F.lit(",".join(map(str, bounds[::FENCE]))), ",").cast("array<bigint>")

    def below(test) -> Column:
        block = F.greatest(F.size(F.filter(fence, test)) - 1, F.lit(0)) * FENCE
        return block + F.size(F.filter(F.slice(every, block + 1, F.lit(FENCE)), test))

    low = below(lambda b: b < key)
    return (low + F.floor(spread * (below(lambda b: b <= key) - low))).cast("int")


def dedupe(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, least_chunk: int = LEAST_CHUNK) -> DataFrame:
    """docs with n_words, n_removed, removed (intervals of words, start and end exclusive) and kept_text (kept words, a space between)."""
    own = [c for c in docs.columns if c not in RESULTS]
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1).cast("long"))
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count("*")).first()
    parallel = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(chunk_bytes, total // MOST_CHUNKS)
    n_chunks = max(1, min(rows, max(-(-total // size), min(parallel, -(-total // least_chunk)))))
    quantiles = [i / n_chunks for i in range(1, n_chunks)]
    bounds = sorted(docs.agg(F.percentile_approx(order, quantiles, 20 * n_chunks)).first()[0] or []) if quantiles else []
    n_buckets = max(1, min(parallel, -(-total // least_chunk)), -(-total // (4 * BUCKET_KEYS)))
    hash_of = F.xxhash64(text_col)
    spread = F.shiftrightunsigned(hash_of, 11).cast("double") / float(1 << 53)
    told_apart = docs.select(*own).withColumns({"__order": order, "__spread": spread, "__chunk": _chunk_of(bounds, order, spread)})
    ranged = told_apart.repartition(n_chunks, "__chunk")
    text_at, chunk_at = own.index(text_col), len(own) + 2

    def texts_of(table: pa.Table) -> list[bytes | None]:
        return [x for c in table.column(text_at).chunks for x in c.cast(pa.binary()).to_pylist()]

    def hashed(table: pa.Table) -> pa.Table:
        parts = [window_keys((t or b"").split(), window) for t in texts_of(table)]
        key, tag = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order, new = sorted_order(key, tag)
        key, tag = key[order][new], tag[order][new]
        cut = np.searchsorted(key, (np.arange(1, n_buckets, dtype=object) * (1 << 64) // n_buckets).astype(np.uint64))
        edges = [0, *cut.tolist(), len(key)]
        full = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        chunk = table.column(chunk_at)[0].as_py()
        return pa.table({"bucket": pa.array([i for i, _, _ in full], pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "keys": pa.array([pack(key[a:b], tag[a:b]) for _, a, b in full], pa.binary())})

    def counted(table: pa.Table) -> pa.Table:
        """For each chunk the hashes of the bucket that an earlier chunk has too."""
        by = sorted(zip(table.column("chunk").to_pylist(), table.column("keys").to_pylist(), strict=True))
        got = [unpack(k) for _, k in by]
        key, tag = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        whose = np.repeat(np.arange(len(by)), [len(g[0]) for g in got])
        order, new = sorted_order(key, tag)  # stable: of equal hashes the earliest chunk comes first
        later = order[~new]
        later = later[np.argsort(whose[later], kind="stable")]
        edges = np.searchsorted(whose[later], np.arange(len(by) + 1)).tolist()
        out = [(by[i][0], pack(key[x], tag[x])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a for x in [later[a:b]]]
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "keys": pa.array([k for _, k in out], pa.binary())})

    def marked(table: pa.Table, told: pa.Table) -> pa.Table:
        texts = texts_of(table)
        place = list(zip(table.column(len(own)).to_pylist(), table.column(len(own) + 1).to_pylist(), texts, strict=True))
        at = sorted(range(len(texts)), key=lambda i: (place[i][0], place[i][1], place[i][2] or b""))
        first: list[int] = []  # one row of each document
        twin: dict[int, int] = {}
        for i in at:
            if first and place[first[-1]] == place[i]:
                twin[i] = first[-1]
            else:
                first.append(i)
        parts = [window_keys((texts[i] or b"").split(), window) for i in first]
        key, tag = (np.concatenate([p[j] for p in parts]) if parts else np.empty(0, kind) for j, kind in ((0, np.uint64), (1, np.uint16)))
        order, new = sorted_order(key, tag)
        lead = order[new]
        repeat = np.ones(len(key), bool)
        repeat[lead] = stands_in(key[lead], tag[lead], [unpack(k) for k in told.column("keys").to_pylist()])
        result: list[tuple] = [()] * len(texts)
        done = 0
        for i, (k, _) in zip(first, parts, strict=True):
            words = (texts[i] or b"").split()
            spans = intervals(repeat[done : done + len(k)], len(words), window)
            done += len(k)
            kept, upto = [], 0
            for a, b in spans:
                kept += words[upto:a]
                upto = b
            kept += words[upto:]
            result[i] = (len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept))
        for i, j in twin.items():
            result[i] = result[j]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        more = [pa.array([r[0] for r in result], pa.int64()), pa.array([r[1] for r in result], pa.int64()), pa.array([r[2] for r in result], span), pa.array([r[3] for r in result], pa.binary()).cast(pa.string())]
        return pa.table([*(table.column(i) for i in range(len(own))), *more], names=[*own, *RESULTS])

    keys = ranged.groupBy("__chunk").applyInArrow(hashed, "bucket int, chunk int, keys binary")
    told = keys.groupBy("bucket").applyInArrow(counted, "chunk int, keys binary")
    schema = docs.select(*own).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.array().cast("array<struct<start:bigint,end:bigint>>"), "kept_text": F.lit("")}).schema
    return ranged.groupBy("__chunk").cogroup(told.groupBy("chunk")).applyInArrow(marked, schema)
