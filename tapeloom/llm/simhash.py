"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint has 64 bits, so 8 positional bytes. Two that differ in at most MAX_BITS = 4 bits share at least 4 of
the 8 in place: the guaranteed minimum. The index therefore lists fingerprints under triples of positional bytes.
Of the 56 triples 20 suffice to hold one inside every set of four positions, so no link is missed. In a list, shared bytes
are tallied per pair, pairs below the minimum are dropped, and the bits of the rest are compared.

Equal fingerprints are one entry, whatever the number of copies. A list longer than ``heavy`` is parted by a further
byte: two of its fingerprints that link share one more of the other five positions, so they meet in a list of four
bytes. A list is searched outward from one entry at a time, each found entry leaving the list, so links that span the
list come out and never all its pairs.

Defined results: texts without a word (null, empty) have fingerprint 0 and are linked like any others; very long texts
are read whole; repeated rows are in one group; a null doc_id is never the least id, and a group of null ids only has
a null component; an empty table gives no rows; ids are whole numbers; deduplicate() keeps columns of any name.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, stash
from tapeloom.llm.components import components

SHINGLE = 4
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
BLOCK = 1 << 14


def position_triples() -> list[tuple[int, int, int]]:
    """Triples such that any four of the 8 positions contain one: in a ring of three parts, those within a part
    and those with two in a part and one in the next."""
    parts = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for p in parts for t in combinations(p, 3)]
    for i, p in enumerate(parts):
        out += [tuple(sorted((*two, one))) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return sorted(out)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles; a bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, tally, own = len(words) - size + 1, np.zeros(64, np.int64), [words[i:] for i in range(size)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*own)), repeat(42)), np.uint64, n)
    for at in range(0, n, BLOCK):
        tally += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * tally > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long, for every row."""

    def run(batches):
        for b in slices(batches):
            fp = np.fromiter(map(fingerprint, b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b) -> np.ndarray:
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    return (shared >= MIN_BYTES) & (np.bitwise_count(x) <= MAX_BITS)


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the links among fps join: a search from one entry to all those not yet reached."""
    links, left = [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            own = front.pop()
            near = _near(left, own)
            hits = left[near]
            links += [(int(own), int(x)) for x in hits]
            front += list(hits)
            left = left[~near]
    return links


def _linked(key: np.ndarray, fp: np.ndarray, long_list: int) -> list[tuple[int, int]]:
    """Links within each stretch of equal keys."""
    if not len(key):
        return []
    edge = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    out: list[tuple[int, int]] = []
    for b, e in zip(begin[(many := end - begin > long_list)].tolist(), end[many].tolist(), strict=True):
        out += spanning_links(fp[b:e])
    few = np.repeat(~many, end - begin)
    at = np.flatnonzero(few)
    for lag in range(1, long_list):  # short lists: all pairs of a list by their distance, over all lists at once
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        hit = at[_near(fp[at], fp[at + lag])]
        out += zip(fp[hit].tolist(), fp[hit + lag].tolist(), strict=True)
    return out


def _entries(fps: DataFrame, heavy: int) -> DataFrame:
    """(fp, key): every fingerprint under its triples of bytes, or under four bytes where the triple's list is long."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))
    triples = position_triples()
    keys = [F.lit(n << 24).cast("long") + F.shiftleft(byte(i), 16) + F.shiftleft(byte(j), 8) + byte(k) for n, (i, j, k) in enumerate(triples)]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    long_keys = stash(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(F.col("key").alias("long_key")), "simhash-long")
    told = index.join(long_keys, F.col("key") == F.col("long_key"), "left")
    rest = F.element_at(F.array(*(F.array(*(F.lit(p) for p in range(8) if p not in t)) for t in triples)), (F.shiftrightunsigned("key", 24) + 1).cast("int"))
    fourth = F.transform(rest, lambda p: F.col("key") + F.shiftleft(F.lit(1).cast("long"), 45) + F.shiftleft(p.cast("long"), 40) + F.shiftleft(F.element_at(F.array(*(byte(i) for i in range(8))), p + 1), 32))
    return told.select("fp", F.explode(F.when(F.col("long_key").isNull(), F.array("key")).otherwise(fourth)).alias("key"))


def links(fps: DataFrame, *, long_list: int = 8, heavy: int = 4096) -> DataFrame:
    """(a, b): links between the different fingerprints fp that span all links of MAX_BITS or fewer bits."""

    def search(batches):
        """Whole lists: what is held is one list, and the batch that ends it."""
        keys, fps, held = [], [], None
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if held is not None and key[0] != held or key[0] != key[-1]:  # the last list may go on in the next batch
                cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
                yield from found(_linked(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]), long_list))
                keys, fps, key, fp = [], [], key[cut:], fp[cut:]
            held = key[-1]
            keys.append(key)
            fps.append(fp)
        if keys:
            yield from found(_linked(np.concatenate(keys), np.concatenate(fps), long_list))

    def found(pairs):
        if pairs:
            ab = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab.min(1)), pa.array(ab.max(1))], names=["a", "b"])

    return _entries(fps, heavy).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(search, "a long, b long").distinct()


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    marked = stash(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    kinds = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-kinds")
    roots = components(links(kinds.select("fp")))
    linked = kinds.join(roots, kinds["fp"] == roots["node"]).select("fp", "root", "least")
    ids = linked.join(linked.groupBy("root").agg(F.min("least").alias("linked_id")), "root").select(F.col("fp").alias("__fp"), "linked_id")
    # Every fingerprint has one row here, so the join adds none; Spark splits the stretch of a frequent one.
    known = stash(kinds.join(ids, kinds["fp"] == ids["__fp"], "left").select(F.col("fp").alias("__fp"), F.coalesce("linked_id", "least").alias("component_id")), "simhash-ids")
    return marked.join(known, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def hex_fp(fp="fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the least doc_id.

    Ids that stand once need only a semi join; rows of an id that repeats, or is null, are told apart by fingerprint.
    """
    found = stash(groups(docs, id_col=id_col, text_col=text_col), "simhash-groups")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = found.groupBy("doc_id").agg(F.count("*").alias("__rows"))
    single = rows.where("__rows = 1 AND doc_id IS NOT NULL")
    sure = keep.join(single, "doc_id", "left_semi").select(F.col("doc_id").alias("__id"))
    kept = docs.join(sure, docs[id_col] == F.col("__id"), "left_semi")
    odd_ids = rows.where("__rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id"))
    odd = docs.join(odd_ids, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
    own = odd.columns
    one = keep.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct()

    at = own.index(text_col)

    def mark(batches):
        for b in slices(batches):
            fp = np.fromiter(map(fingerprint, b.column(at).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "__own"])

    schema = odd.withColumn("__own", F.lit(0).cast("long")).schema
    marked = odd.mapInArrow(mark, schema).join(one, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp")), "left_semi")
    return kept.unionByName(marked.dropDuplicates([id_col, "__own"]).select(*own))
