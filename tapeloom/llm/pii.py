"""Personal data: base patterns and bootstrapped contextual extraction. DataFrame functions only.

Base spans come from one pattern a kind. The bootstrap then looks for identifiers that the patterns miss. Texts are
read as units: what stands between white space, or a run of grouped digits. A unit with a digit, or with a sign
between letters or digits, may be an identifier of any kind; which kind, if any, only its contexts tell. A lexical
pattern is a context of a seed: the one or two words before it, the one or two behind it, or the word on either side.

Each round takes the patterns that stand around at least ``min_seeds`` different seeds of a kind, and counts over the
whole corpus how often their words stand together at all, whatever stands between them. Those that point to seeds in at
least ``min_precision`` of these places form a graph with the units they surround. It is scored in turns: a pattern by
the share of its places that hold credible instances, an instance by its patterns (the best before it and the best
behind it as independent evidence, or the best on both sides). Instances of ``accept`` or more become spans, and
seeds of the next round, so they may bring patterns that no base span has. Rounds end when nothing is accepted.

Counts are pre-aggregated before each shuffle, so a frequent pattern or instance is one row a task. Words and pairs of
words are counted by 64-bit hashes. Spans are code points, end exclusive.

Defined results: null counts as the empty text and has no spans; very long texts are read whole; repeated rows get
equal results; rows need no unique doc_id; a tie between kinds goes to the first of KINDS; an empty table gives no
rows; columns named base, spans or added are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_stash, stash

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a failing run of characters isn't tried again from its middle:
#: \G lets a match begin where the last one ended, possessive quantifiers never give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A unit of text: digits in groups, or what stands between white space.
UNIT = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|\S++"
#: Marks that no text keeps: around matches, the first character of a seed of each kind, and a blank inside a seed.
MARK, SEED, BLANK = "\ue010", {"email": "\ue000", "ip": "\ue001", "card": "\ue002", "phone": "\ue003"}, "\ue004"
MARKS = "".join((MARK, BLANK, *SEED.values()))
#: Stripped from the ends of units, where it is punctuation of the sentence.
PUNCT = "\"'()<>[]{}.,;:!?#$%&*|"
#: What may be an identifier: it has a digit, or a sign between letters or digits.
LIKELY = r"[0-9]|[\p{L}0-9][^\p{L}0-9\s]+[\p{L}0-9]"
SIDES = ("l1", "l2", "r1", "r2", "both")
PREFIX_BLOCK = 128
FEW = 1000  # keys that become part of the plan; more of them are joined


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, pattern: str) -> Column:
    """What lies before, in and behind the matches, by turns: matches have odd places. One pass of the pattern."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def _upto(sizes: Column) -> Column:
    """Running sums of an array of int, in blocks, so that no long array is copied at each step."""

    def run(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("pos"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["pos"] + x).alias("pos"), F.array_append(a["out"], a["pos"] + x).alias("out")))["out"]

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PREFIX_BLOCK).cast("int")), lambda i: F.slice(v, i * PREFIX_BLOCK + 1, PREFIX_BLOCK))
        starts = lambda p: F.concat(F.array(F.lit(0)), run(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)), F.lit(0)))
        return _let(parts, lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("v"), F.slice(starts(p), 1, F.size(p)).alias("s")), lambda z: run(z["v"], z["s"]))))

    return _let(sizes, lambda v: F.when(F.size(v) <= PREFIX_BLOCK, run(v, F.lit(0))).otherwise(blocks(v)))


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the matches, or null without any."""

    def place(p: Column) -> Column:
        ends = _upto(F.transform(p, F.length))
        at = lambda e: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: F.struct(F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), F.get(p, i).alias("m")))
        return F.when(F.size(p) > 1, _let(ends, at))

    return _let(_pieces(text, pattern), place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """The digits' check sum, every second one from the right doubled, ends in 0."""
    d = F.split(F.reverse(_digits(m)), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").cast("long") <= 255) & F.forall(F.split(m, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")) <= 3),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _passing(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: F.coalesce(CHECKS[kind](s["m"]), F.lit(False)))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _clean(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(text.rlike(f"[{MARKS}]"), F.translate(text, MARKS, "\ufffd" * len(MARKS))).otherwise(text)


def _masked(text: Column, hide: int | None) -> Column:
    """The text with each seed as one word that begins with its kind's mark, all of the same length.

    Of overlapping matches the first kind's counts. With ``hide``, a seeded ``hide``-th of the instances stay as they are.
    """

    def mask(of: Column, k: str) -> Column:
        seed = lambda x: F.coalesce(CHECKS[k](x), F.lit(False)) & (F.lit(True) if hide is None else F.pmod(F.xxhash64(x), F.lit(hide)) != 0)
        word = lambda x: F.concat(F.lit(SEED[k]), F.translate(F.substring(x, 2, 1 << 30), " ", BLANK))
        marked = lambda p: F.array_join(F.transform(p, lambda x, i: F.when((i % 2 == 1) & seed(x), word(x)).otherwise(x)), "")
        return _let(_pieces(of, PATTERNS[k]), lambda p: F.when(F.size(p) == 1, p[0]).otherwise(marked(p)))

    return reduce(mask, KINDS, text)


def _is_seed(word: Column) -> Column:
    return word.between(F.lit(SEED["email"]), F.lit(SEED["phone"] + "\uffff"))


def _words(units: Column) -> Column:
    """A hash of each unit as a word of a context; seeds of a kind are alike."""
    return F.transform(units, lambda x: F.xxhash64(F.when(_is_seed(x), F.substring(x, 1, 1)).otherwise(F.lower(x))))


def _text_words(text: Column, hide: int | None) -> Column:
    """_words of a whole text. Without a digit or @ its units are what white space parts, and none is a seed."""
    bare = lambda x: F.btrim(x, F.lit(PUNCT))
    units = _let(_pieces(_masked(text, hide), UNIT), lambda p: F.transform(F.filter(p, lambda x, i: i % 2 == 1), bare))
    plain = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(bare(x)))
    return F.when(text.contains("@") | text.rlike("[0-9]"), _words(units)).otherwise(plain)


def _candidates(masked: Column) -> Column:
    """array<struct<inst, seed, start, end, and the hashed contexts by SIDES>> of the units that may be identifiers."""

    def likely(u: Column) -> Column:
        return _is_seed(u) | (u.rlike(LIKELY) & ~u.rlike(f"[{''.join(SEED.values())}]"))

    def rows(p: Column) -> Column:
        bare = F.transform(F.filter(p, lambda x, i: i % 2 == 1), lambda x: F.btrim(x, F.lit(PUNCT)))

        def build(u: Column) -> Column:
            def of(z: Column) -> Column:
                ends, h = z["e"], z["h"]

                def one(c: Column) -> Column:
                    i, inst = c["i"], c["u"]
                    left, right = F.get(h, i - 1), F.get(h, i + 1)
                    start = F.get(ends, 2 * i) + F.instr(F.get(p, 2 * i + 1), inst) - 1
                    seed = reduce(lambda a, k: F.when(F.startswith(inst, F.lit(SEED[k])), F.lit(k)).otherwise(a), KINDS, F.lit(None).cast("string"))
                    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))
                    both = F.when(left.isNotNull() & right.isNotNull(), F.xxhash64(left, right, F.lit(1)))
                    sides = (left, pair(F.get(h, i - 2), left), right, pair(right, F.get(h, i + 2)), both)
                    return F.struct(F.lower(inst).alias("inst"), seed.alias("seed"), start.alias("start"), (start + F.length(inst)).alias("end"), *(x.alias(k) for k, x in zip(SIDES, sides, strict=True)))

                return F.transform(z["c"], one)

            found = F.filter(F.transform(u, lambda x, i: F.struct(i.alias("i"), x.alias("u"))), lambda c: likely(c["u"]))
            return _let(found, lambda c: F.when(F.size(c) > 0, _let(F.struct(c.alias("c"), _upto(F.transform(p, F.length)).alias("e"), _words(u).alias("h")), of)))

        return _let(bare, build)

    return _let(_pieces(masked, UNIT), rows)


CANDIDATE = "array<struct<inst:string,seed:string,start:int,end:int," + ",".join(f"{k}:bigint" for k in SIDES) + ">>"


def base_spans(docs: DataFrame, *, text_col: str = "text", hide: int | None = None) -> DataFrame:
    """docs with __base, an array per kind in KINDS order of struct<start, end, m>, and __cands."""
    text = _clean(text_col)
    some = text.contains("@") | text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    spans = [F.coalesce(F.when(some, _passing(_located(text, PATTERNS[k]), k)), none).alias(k) for k in KINDS]
    cands = F.when(text.rlike(LIKELY), _let(F.when(some, _masked(text, hide)).otherwise(text), _candidates))
    return docs.withColumns({"__base": F.struct(*spans), "__cands": F.coalesce(cands, F.array()).cast(CANDIDATE)})


def _sides(occurrences: DataFrame, *columns) -> DataFrame:
    """A row per context of an occurrence: side and key, beside the columns given."""
    contexts = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("key")) for k in SIDES)))
    return occurrences.select(*columns, contexts.alias("c")).select(*columns, "c.side", "c.key").where("key IS NOT NULL")


def places(docs: DataFrame, keys: DataFrame, *, text_col: str = "text", hide: int | None = None) -> DataFrame:
    """(key, places): how often a word, two words one behind the other, or two with one between them stand in docs."""
    few = [r["key"] for r in keys.limit(FEW + 1).collect()]

    def grams(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        around = F.zip_with(h, F.slice(h, 3, F.size(h)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b, F.lit(1))))
        every = F.concat(h, pairs, around)
        return F.filter(every, lambda x: x.isin(few)) if len(few) <= FEW else every

    found = docs.select(F.explode(_let(_text_words(_clean(text_col), hide), grams)).alias("key"))
    return (found if len(few) <= FEW else found.join(keys, "key")).groupBy("key").agg(F.count("*").alias("places"))


def score(graph: DataFrame, *, turns: int = 3) -> DataFrame:
    """(kind, inst, s): credibility of each instance of graph (side, key, kind, inst, n, is_seed, places)."""
    fresh = graph.select("kind", "inst", F.col("is_seed").cast("double").alias("s")).groupBy("kind", "inst").agg(F.max("s").alias("s"))
    for _ in range(turns):
        weighed = graph.join(fresh, ["kind", "inst"])
        trust = weighed.groupBy("side", "key", "kind").agg((F.sum(F.col("n") * F.col("s")) / (F.max("places") + 1)).alias("t"))
        best = lambda sides: F.coalesce(F.max(F.when(F.col("side").isin(*sides), F.col("t"))), F.lit(0.0))
        left, right = best(("l1", "l2")), best(("r1", "r2"))
        told = F.greatest(best(("both",)), 1 - (1 - left) * (1 - right))
        fresh = stash(graph.join(trust, ["side", "key", "kind"]).groupBy("kind", "inst").agg(F.when(F.max("is_seed"), F.lit(1.0)).otherwise(F.least(told, F.lit(1.0))).alias("s")), "pii-scores")
    return fresh


def discover(docs: DataFrame, occurrences: DataFrame, *, text_col: str = "text", hide: int | None = None, rounds: int = 4, min_seeds: int = 3, min_precision: float = 0.5, accept: float = 0.9) -> DataFrame:
    """Accepted unseen instances (inst, kind, round), by rounds of patterns, their counts and scores."""
    accepted = stash(occurrences.select("inst", F.col("seed").alias("kind"), F.lit(0).alias("round")).limit(0), "pii-accepted")
    counts = None
    for turn in range(1, rounds + 1):
        known = occurrences.join(accepted.select("inst", F.col("kind").alias("__new")), "inst", "left").withColumn("kind", F.coalesce("seed", "__new")).drop("__new")
        seeds = _sides(known.where("kind IS NOT NULL"), "kind", "inst").groupBy("side", "key", "kind", "inst").agg(F.count("*").alias("n"))
        patterns = stash(seeds.groupBy("side", "key", "kind").agg(F.count("*").alias("seeds"), F.sum("n").alias("hits")).where(F.col("seeds") >= min_seeds), "pii-patterns")
        if patterns.isEmpty():
            break
        keys = patterns.select("key").distinct()
        new = places(docs, keys if counts is None else keys.join(counts, "key", "left_anti"), text_col=text_col, hide=hide)
        counts = stash(new if counts is None else new.unionByName(counts), "pii-counts")
        good = stash(patterns.join(counts, "key").where(F.col("hits") >= min_precision * (F.col("places") + 1)).select("side", "key", "kind", "places"), "pii-good")
        drop_stash(patterns)
        if good.isEmpty():
            break
        around = _sides(known.withColumnRenamed("kind", "own"), "own", "inst")
        graph = stash(around.join(good, ["side", "key"]).where("own IS NULL OR own = kind").groupBy("side", "key", "kind", "inst").agg(F.count("*").alias("n"), F.max(F.col("own").isNotNull()).alias("is_seed"), F.first("places").alias("places")), "pii-graph")
        scores = score(graph)
        rank = reduce(lambda a, i: F.when(F.col("kind") == KINDS[i], F.lit(-i)).otherwise(a), range(len(KINDS)), F.lit(None).cast("int"))
        fresh = scores.where(F.col("s") >= accept).join(known.where("kind IS NOT NULL").select("inst").distinct(), "inst", "left_anti").groupBy("inst").agg(F.max_by("kind", F.struct("s", rank)).alias("kind")).withColumn("round", F.lit(turn))
        fresh = stash(fresh, "pii-fresh")
        if fresh.isEmpty():
            break
        accepted = stash(accepted.unionByName(fresh), "pii-accepted")
    return accepted


def find(docs: DataFrame, *, text_col: str = "text", hide: int | None = None, **bootstrap) -> DataFrame:
    """docs without the text, with base, added and spans: arrays of struct<kind, start, end> in contract order.

    docs is read again for each round's counts. With ``hide``, every ``hide``-th base instance (by hash) is unknown to
    the bootstrap and listed in the column hidden, so that added tells how well it finds them again; see ``recovery``.
    """
    own = docs.drop("base", "spans", "added")
    found = stash(base_spans(own, text_col=text_col, hide=hide).withColumn("__rid", F.monotonically_increasing_id()).drop(text_col), "pii-base")
    occ = found.select("__rid", F.inline("__cands"))
    new = discover(own, occ, text_col=text_col, hide=hide, **bootstrap)
    span = lambda k, s, e: F.struct(k.alias("kind"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    added = occ.where("seed IS NULL").join(new.select("inst", "kind"), "inst").groupBy("__rid").agg(F.collect_set(span(F.col("kind"), F.col("start"), F.col("end"))).alias("__added"))
    flat = lambda k: F.transform(F.col(f"__base.{k}"), lambda s: span(F.lit(k), s["start"], s["end"]))
    out = found.join(added, "__rid", "left").withColumn("added", F.coalesce(F.sort_array("__added"), F.array().cast("array<struct<kind:string,start:int,end:int>>"))).withColumn("base", F.concat(*(flat(k) for k in KINDS)))
    if hide is not None:
        unknown = lambda k: F.transform(F.filter(F.col(f"__base.{k}"), lambda s: F.pmod(F.xxhash64(s["m"]), F.lit(hide)) == 0), lambda s: span(F.lit(k), s["start"], s["end"]))
        out = out.withColumn("hidden", F.concat(*(unknown(k) for k in KINDS)))
    per_kind = [F.sort_array(F.array_union(flat(k), _of_kind(F.col("added"), k))) for k in KINDS]
    return out.withColumn("spans", F.concat(*per_kind)).drop("__rid", "__base", "__cands", "__added")


def recovery(found: DataFrame) -> DataFrame:
    """One row of a table that find(hide=...) made: hidden base spans, those found again, and all added spans."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return found.agg(total(F.col("hidden")).alias("n_hidden"), total(F.array_intersect("hidden", "added")).alias("n_again"), total(F.col("added")).alias("n_added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(_of_kind(spans, kind)).cast("long")
