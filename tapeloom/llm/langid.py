"""Language identification by prediction with partial matching (PPM).

Per language a byte context tree of order ORDER is counted over a bounded sample of labelled texts and then
frozen. The cost of a byte is that of its longest known context, with method C escapes to shorter ones down
to the uniform order -1; a text's code length is the exact sum over all its bytes. The language of the
shortest code wins (ties: the lower name), and its posterior under equal priors is the score.

Learning reads about ``per_lang`` texts of each language, by a hash of their ids, and keeps every language and every
context that occurs in them. The tree is kept sparse, as sorted strings of one to four bytes for each language, so
its size follows the sample's text alone. Counts of up to PART_STRINGS strings are collected and broadcast (16 bytes each);
of more, groups of languages of that size are written to the shared folder by tasks, and the driver sees one row a
language. Workers read the groups one after the other and keep those ready that fit HELD_STRINGS. Texts are coded by their different four-byte strings: each is priced once
for all languages, and remembered by the worker for a while.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled text every
row is ``und``; very long texts are coded whole, in blocks; repeated rows get equal results; columns named like a
result are replaced.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import filesystem, fresh_path, held_out, slices, stash

ORDER = 3
PAD = b"\0" * ORDER
BLOCK = 1 << 22  # bytes coded at once
MEMO_BYTES = 16 << 20  # prices that a worker remembers
PRICED_BYTES = 64 << 20  # prices of one block: fewer bytes are coded at once where there are many languages
PART_STRINGS, HELD_STRINGS = 1 << 21, 1 << 23  # strings that the driver collects, or a part holds; and that a worker keeps ready
_TABLES: dict[str, Tables] = {}


def sample(docs: DataFrame, *, per_lang: int, seed: int) -> DataFrame:
    """About per_lang texts of each language from outside the held-out fold."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = stash(own.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")), "langs")  # of known size, so that no text moves
    return own.join(counts, F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) * F.col("__n") < per_lang).drop("__lang", "__n")


def _grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte string that ends at each byte of the pieces but their first ORDER, and how many of each piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    if len(data) <= ORDER:
        return np.zeros(0, np.uint32), np.array([max(0, len(x) - ORDER) for x in pieces], np.int64)
    gram = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    own, sizes = np.ones(len(gram), bool), np.array([len(x) for x in pieces], np.int64)
    for back in range(ORDER):  # strings over the edge of two pieces
        edge = np.cumsum(sizes)[:-1] - 1 - back
        own[edge[(edge >= 0) & (edge < len(gram))]] = False
    return gram[own], sizes - ORDER


def train(docs: DataFrame, *, per_lang: int = 400, seed: int = 7, part_strings: int = PART_STRINGS) -> dict:
    """Frozen counts of (language, four-byte string): arrays up to part_strings strings, else the files of groups of languages."""

    def grams(batches):
        """Counts of the four-byte strings per language; what a task holds is bounded by its batch."""
        for b in slices(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                code, n = np.unique(_grams([PAD + x for k, x in zip(langs, texts, strict=True) if k == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = stash(sample(docs, per_lang=per_lang, seed=seed).select("lang", "text").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ppm-counts")
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if sum(sizes.values()) > part_strings:
        return _parted(counted, sizes, part_strings)
    table = counted.toArrow()
    lang = np.array(table.column("lang").to_pylist(), dtype=object)
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    of = np.searchsorted(langs, lang) if langs else np.zeros(0, np.int64)
    order = np.lexsort((gram, of))
    return {"langs": langs, "of": of[order].astype(np.int32), "gram": gram[order].astype(np.uint32), "n": n[order], "id": f"{len(gram)}-{int(n.sum())}-{int((gram * (n + 1) % 1_000_003).sum())}-{per_lang}"}


def _parted(counted: DataFrame, sizes: dict[str, int], part_strings: int) -> dict:
    """The model as files: neighbouring languages by groups of about part_strings strings, one language at least."""
    groups: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        if not groups or room + sizes[lang] > part_strings:
            groups.append([])
            room = 0
        groups[-1].append(lang)
        room += sizes[lang]
    spark, path = counted.sparkSession, fresh_path(counted.sparkSession, "ppm")
    last = [r["b"] for r in counted.select(F.col("gram").bitwiseAND(255).cast("int").alias("b")).distinct().collect()]
    known = np.zeros(256, bool)
    known[last] = True
    of = spark.createDataFrame([(x, g) for g, own in enumerate(groups) for x in own], "lang string, part int")

    def save(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        at = np.searchsorted(groups[part], np.array(t.column("lang").to_pylist(), object))
        gram, n = t.column("gram").to_numpy(), t.column("n").to_numpy()
        order = np.lexsort((gram, at))
        np.savez(out := io.BytesIO(), of=at[order].astype(np.int32), gram=gram[order].astype(np.uint32), n=n[order])
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        own, name = f"{base}/_attempt-{part}-{uuid.uuid4().hex}", f"{base}/part-{part:07d}.npz"
        with fs.open_output_stream(own) as sink:
            sink.write(out.getvalue())
        fs.move(own, name)
        return pa.table({"part": pa.array([part], pa.int32()), "name": [name]})

    whole = path.split("://")[0] + "://" if "://" in path and not path.startswith("file://") else ""
    names = {r["part"]: whole + r["name"] for r in counted.join(F.broadcast(of), "lang").groupBy("part").applyInArrow(save, "part int, name string").collect()}
    return {"langs": sorted(sizes), "known": known, "parts": [(own, names[g]) for g, own in enumerate(groups)]}


class Tables:
    """Per language and order: the known strings with their costs, and the known contexts with their escapes."""

    def __init__(self, model: dict):
        gram, n, of = model["gram"], model["n"].astype(np.float64), model["of"]
        known = model.get("known")
        if known is None:
            known = np.zeros(256, bool)
            known[gram & 255] = True
        self.symbol = np.where(known, np.arange(256), 0).astype(np.uint8)  # unknown bytes are alike, and like the padding
        parts = [self.symbol[(gram >> s) & 255].astype(np.uint32) << s for s in (24, 16, 8, 0)]
        gram = parts[0] | parts[1] | parts[2] | parts[3]
        self.orders = []
        for k in range(len(model["langs"])):
            own, per = of == k, []
            for order in range(ORDER, -1, -1):
                keys, where = np.unique(gram[own] & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
                count = np.bincount(where, weights=n[own], minlength=len(keys))
                contexts, of_key = np.unique(keys >> 8, return_inverse=True)
                total, kinds = np.bincount(of_key, weights=count), np.bincount(of_key).astype(np.float64)
                per.append((keys, np.log2((total + kinds)[of_key] / count), contexts, np.log2((total + kinds) / kinds)))
            self.orders.append(per)
        self.strings = len(gram)
        self.memo = MEMO_BYTES // (4 * (len(self.orders) + 1))
        self.block = min(BLOCK, max(1 << 12, PRICED_BYTES // (4 * (len(self.orders) + 1))))
        self.seen, self.bits = np.zeros(0, np.uint32), np.zeros((len(self.orders), 0), np.float32)

    def price(self, grams: np.ndarray) -> np.ndarray:
        """bits[language, string] of different strings."""
        out = np.zeros((len(self.orders), len(grams)), np.float32)
        for bits, per in zip(out, self.orders, strict=True):
            left = np.arange(len(grams))
            for order, (keys, cost, contexts, escape) in zip(range(ORDER, -1, -1), per, strict=True):
                key = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
                at, c = np.searchsorted(keys, key), np.searchsorted(contexts, key >> 8)
                at[at == len(keys)], c[c == len(contexts)] = 0, 0
                hit, met = keys[at] == key, contexts[c] == key >> 8
                bits[left] += np.where(hit, cost[at], np.where(met, escape[c], 0)).astype(np.float32)
                left = left[~hit]
            bits[left] += 8  # order -1: a byte is one of 256
        return out

    def known(self, grams: np.ndarray) -> np.ndarray:
        """price(), with what is remembered."""
        at = np.searchsorted(self.seen, grams)
        at[at == len(self.seen)] = 0
        fresh = self.seen[at] != grams if len(self.seen) else np.ones(len(grams), bool)
        if fresh.any():
            new = np.sort(grams[fresh])
            if len(self.seen) + len(new) > self.memo:
                self.seen, self.bits = self.seen[:0], self.bits[:, :0]
                new = np.sort(grams)
            both, bits = np.concatenate([self.seen, new]), np.concatenate([self.bits, self.price(new)], axis=1)
            order = np.argsort(both, kind="stable")
            self.seen, self.bits = both[order], bits[:, order]
            at = np.searchsorted(self.seen, grams)
        return self.bits[:, at]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """bits[text, language] of whole texts."""
        total = np.zeros((len(texts), len(self.orders)))
        held: list[tuple[int, bytes]] = []
        room = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), self.block):
                piece = (PAD if at == 0 else text[at - ORDER : at]) + text[at : at + self.block]
                if room and room + len(piece) > self.block:
                    self._add(held, total)
                    held, room = [], 0
                held.append((i, piece))
                room += len(piece)
        if held:
            self._add(held, total)
        return total

    def _add(self, held: list[tuple[int, bytes]], total: np.ndarray) -> None:
        data = b"".join(x for _, x in held)
        mapped = self.symbol[np.frombuffer(data, np.uint8)].tobytes()
        cut = np.cumsum([0, *(len(x) for _, x in held)]).tolist()
        grams, sizes = _grams([mapped[a:b] for a, b in zip(cut, cut[1:])])
        coded = pa.array(grams).dictionary_encode()
        prices, at = self.known(coded.dictionary.to_numpy()), coded.indices.to_numpy()
        of, begin = np.array([i for i, _ in held]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for k, price in enumerate(prices):
            np.add.at(total[:, k], of, np.add.reduceat(price[at], begin, dtype=np.float64))


def _tables(model: dict) -> Tables:
    """Tables of a model, or of one part of it, kept ready while they fit."""
    if model["id"] not in _TABLES:
        made = Tables(model | _loaded(model["file"]) if "file" in model else model)
        while _TABLES and made.strings + sum(t.strings for t in _TABLES.values()) > HELD_STRINGS:
            _TABLES.pop(next(iter(_TABLES)))
        _TABLES[model["id"]] = made
    return _TABLES[model["id"]]


def _loaded(name: str) -> dict:
    fs, path = filesystem(name)
    with fs.open_input_stream(path) as source, np.load(io.BytesIO(source.read())) as x:
        return {k: x[k] for k in ("of", "gram", "n")}


def lengths(texts: list[bytes], model: dict) -> np.ndarray:
    """bits[text, language] of whole texts, group of languages by group."""
    parts = [{"langs": own, "known": model["known"], "file": name, "id": name} for own, name in model["parts"]] if "parts" in model else [model]
    return np.concatenate([_tables(p).lengths(texts) for p in parts], axis=1)


def code_lengths(text: bytes, model: dict) -> np.ndarray:
    """Bits of the whole text under each language."""
    return lengths([text], model)[0]


def predict(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tagged = docs.drop("lang_pred", "lang_score").withColumn("__letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    at, names = tagged.columns.index(text_col), tagged.columns
    schema = tagged.drop("__letter").withColumn("lang_pred", F.lit("")).withColumn("lang_score", F.lit(0.0)).schema

    def run(batches):
        m = shared.value
        for b in slices(batches, max(64, min(4096, (1 << 21) // max(1, len(m["langs"]))))):
            texts, letters = b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names) - 1).to_numpy(zero_copy_only=False)
            pred, post = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            some = np.flatnonzero(letters) if m["langs"] else np.zeros(0, int)
            if len(some):
                bits = lengths([texts[i] for i in some], m)
                best = bits.argmin(1)
                pred[some] = np.array(m["langs"], object)[best]
                post[some] = 1 / np.exp2(np.minimum(0, bits.min(1)[:, None] - bits)).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names) - 1)), pa.array(pred.tolist(), pa.string()), pa.array(post)], names=[*names[:-1], "lang_pred", "lang_score"])

    return tagged.mapInArrow(run, schema)
