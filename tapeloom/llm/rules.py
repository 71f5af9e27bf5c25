"""Quality rules as a bitmask ledger. DataFrame functions only.

measure() evaluates every rule once and keeps the measurements and one failure bit a rule; apply_policy()
reads the bits under a versioned mask, and ablations() tells by bitwise aggregation what each rule of a policy
decides alone. Texts stay in one pass: no join, no shuffle.

Defined results: a null text has no words and fails only ``few_words``; very long texts are measured whole; of equal
lines or windows all but the first line, and all windows, count; repeated rows get equal results; an empty table gives
no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACE, WORD

WINDOW = 8
#: name -> SQL over the measurements that is true where the rule fails; a rule's bit is its place here.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "capitals": "n_words >= 5 AND 10 * n_capitals > 5 * word_chars",
}
BITS = {name: i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that each enforces.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "corpus-1": tuple(RULES),
}
BASE = ("few_words", "repeated_words")


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << BITS[n] for n in names)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in WINDOW-word windows found twice or more in the text.

    Windows are compared by 64-bit hashes, each word hashed once and the hashes joined by twos, fours and eights; most texts have no equal pair and stop there. Else the
    hashes are sorted with their places, and the stretch from each repeated window to the next one is counted.
    """

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = lambda s: F.transform(F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x)), lambda x: x["i"])
        covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(pairs, lambda s: F.sort_array(twice(s))), covered))

    def joined(h: Column, apart: int) -> Column:
        """Hashes of twice the length: each with the one that begins where it ends."""
        n = F.size(h) - apart
        return F.zip_with(F.slice(h, 1, n), F.slice(h, apart + 1, n), lambda a, b: F.xxhash64(a, b))

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        hashes = reduce(lambda h, apart: _let(h, lambda x: joined(x, apart)), (1, 2, 4), hashes)  # WINDOW words at last
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(_let(hashes, count))

    return _let(words, of)


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the measurements and rule_bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\r\x0b\x0c"))) > 0)
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    out = docs.withColumns({
        "__words": words,
        "__lines": lines,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
    }).drop("__words", "__lines")
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits + F.when(F.expr(fails), F.lit(1 << BITS[name])).otherwise(0)
    return out.withColumn("rule_bits", bits)


def apply_policy(ledger: DataFrame, policy: str, *, out: str = "kept") -> DataFrame:
    return ledger.withColumn(out, F.col("rule_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were dropped.

    The ledger is first counted per bitmask (2 ** rules groups at most), so nothing large is shuffled.
    """
    m = mask(POLICIES[policy])
    counts = ledger.groupBy(F.col("rule_bits").bitwiseAND(F.lit(m).cast("long")).alias("__bits")).agg(F.count("*").alias("__n"))
    aggs = []
    for name in POLICIES[policy]:
        b = 1 << BITS[name]
        hit, rest = F.col("__bits").bitwiseAND(F.lit(b).cast("long")) != 0, F.col("__bits").bitwiseAND(F.lit(m & ~b).cast("long"))
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0))
        aggs.append(F.struct(F.lit(name).alias("rule"), total(hit).alias("n_failed"), total(hit & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without")))
    return counts.agg(F.array(*aggs).alias("__r")).select(F.inline("__r"))
