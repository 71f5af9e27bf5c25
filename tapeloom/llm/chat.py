"""Chat formatting with prefix-target expansion.

Every assistant turn is a training example of its own: its text holds all turns before it as context
[0, context_end), and its loss mask is 1 on [target_start, target_end), the text of the turn, and 0 elsewhere. A
conversation of n turns thus takes up to n * n / 2 turns of text. Where turns follow the last assistant turn, one
more row without a target holds the whole conversation, so nothing of it is lost.

The examples are written as Parquet; ``read_back`` parses each of them and checks that it begins with the example
before it. Texts are read where they lie: only digests and trainable texts are shuffled.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (in roles also a line end ``\\n``), so no control string stands there and reading undoes it exactly.

Defined results: null text or role counts as empty; a null conv_id is a conversation; turns with equal numbers are
ordered by role and text, null turns come first; repeated turns all count; very long texts stand whole; conversations
without an assistant have turns but no example; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh_path, slices

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s) if "\\" in s else s


def format_conversations(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """The exploded examples: conv_id, pos of the last turn, text, and the context and trainable span of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    t = t.withColumn("rendered", F.concat("head", "body", F.lit(END)))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("rendered").cast("long")
    t = t.withColumns({"pos": F.row_number().over(by), "start": F.sum(size).over(upto) - size, "parts": F.collect_list("rendered").over(upto), "more": F.lead(F.lit(True), 1, False).over(by)})
    t = t.where((F.col("role") == loss_role) | ~F.col("more"))
    target = F.when(F.col("role") == loss_role, F.col("start") + F.length("head"))
    return t.select("conv_id", "pos", F.array_join("parts", "").alias("text"), F.when(target.isNotNull(), F.col("start")).alias("context_end"), target.alias("target_start"), (target + F.length("body")).alias("target_end"))


def expand(formatted: DataFrame) -> DataFrame:
    """The training examples alone, without the rows that only close a conversation."""
    return formatted.where("target_start IS NOT NULL")


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)


def read_back(formatted: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Per conversation: turns, loss text and sizes, parsed from the examples.

    Each example must be whole turns, as many as its position, end with its trainable turn, mask that turn's text,
    and begin with the text of the example before it; anything else is an error.
    """

    def digest(conv, pos, text, context_end, first, last):
        turns, at, n, prior, own = hashlib.sha256(), 0, 0, 0, 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                break
            own, at, n = at, m.end(), n + 1
            role, body = unescape(m[1]), unescape(m[2])
            turns.update(f"{role}\n{body}\n".encode())
            if role == loss_role and n < pos:
                prior = at
        whole = at == len(text) and n == pos
        masked = (context_end, first, last) == (own, m.start(2), m.end(2)) and role == loss_role if first is not None else whole and role != loss_role
        if not (whole and masked):
            raise ValueError(f"conversation {conv}: the example of turn {pos} is not its prefix and target")
        sha = lambda x: hashlib.sha256(x.encode()).digest()
        return conv, pos, len(text), first is not None, None if first is None else unescape(text[first:last]), sha(text[:prior]) if prior else b"", sha(text), turns.hexdigest()

    kinds = {"conv_id": pa.int64(), "pos": pa.int64(), "chars": pa.int64(), "example": pa.bool_(), "loss": pa.string(), "prior": pa.binary(), "own": pa.binary(), "turns": pa.string()}

    def run(batches):
        for b in slices(batches, 64):
            rows = [digest(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    read = formatted.select(F.col("conv_id").cast("long"), F.col("pos").cast("long"), "text", "context_end", "target_start", "target_end")
    rows = read.mapInArrow(run, "conv_id long, pos long, chars long, example boolean, loss string, prior binary, own binary, turns string")
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "chars", "example", "loss", "prior", "own", "turns"))).alias("e"))
    last, e = F.element_at("e", -1), F.col("e")
    loss = F.array_join(F.filter(F.transform(e, lambda x: x["loss"]), lambda x: x.isNotNull()), "")
    before = F.concat(F.array(F.lit(b"")), F.transform(e, lambda x: x["own"]))
    chained = F.forall(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.get(e, i)["prior"] == F.get(before, i))
    return found.select(
        "conv_id", last["pos"].alias("n_turns"), F.when(chained, last["turns"]).otherwise(F.raise_error(F.lit("an example does not begin with the one before it"))).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), last["chars"].alias("formatted_chars"), F.size(F.filter(e, lambda x: x["example"])).cast("long").alias("n_examples"),
    )


def write(turns: DataFrame) -> DataFrame:
    """The examples, written to the shared folder as Parquet and read again; zstd keeps repeated prefixes small."""
    made = format_conversations(turns)
    path = fresh_path(made.sparkSession, "chat")
    made.write.option("compression", "zstd").parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)
