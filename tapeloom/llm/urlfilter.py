"""URL filter: host and path rules, and link-graph propagation for what no rule decides. DataFrame functions only.

Edges join the hosts of pages: absolute links in the html, and the step between a host and its parent domain (two
labels at least) in both directions. Personalised PageRank spreads trust from hosts with allowed pages along the
edges, and distrust from hosts with blocked pages against them; both walks run in the same rounds. A host is
blocked where its distrust is more than ``threshold`` of both together, each as a share of its walk's total: hosts
without an edge onward hand their weight back to the seeds, which is the same but for a factor. Rounds go on until
no further host is reached and neither walk changes by more than ``tolerance`` of its total; a bound that is met
before is an error. Several rounds are one job, and each job reads a written table and writes the next.

Pages are counted per host and links per pair of hosts before anything is shuffled, so a host that holds a third of
the pages is a row a task.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed; hosts that
no walk reaches, and hosts with equal shares of both, are allowed; of rules that fit the longest wins; very long urls
and pages are read whole; repeated rows get equal results; null html has no links; an empty table gives no rows;
columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_stash, lower_ascii, stash

#: The contract's rules: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. rules is a short list that becomes part of the plan."""
    fits = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = F.when(((host == own) | host.endswith("." + own)) & path.startswith("/" + rest), F.lit(rule)).otherwise(fits)
    return fits


def _verdict(rule: Column, rules=RULES) -> Column:
    v = F.lit(None).cast("string")
    for what, name in rules:
        v = F.when(rule == name, F.lit(what)).otherwise(v)
    return v


def host_edges(pages: DataFrame, *, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, and the steps to and from parent domains."""
    host = host_of(F.col(url_col))
    href = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>/?#]+)"""), F.lit(1)), lambda x: lower_ascii(F.regexp_extract(x, r"//(.*)$", 1))))
    links = pages.select(host.alias("src"), F.explode(href).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(host.alias("h")).where("h <> ''").distinct()
    labels = F.split("h", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.where(F.size(labels) > 2).select(F.explode(F.filter(F.arrays_zip(chain.alias("a"), F.slice(F.concat(chain, F.array(F.lit(""))), 2, F.size(labels)).alias("b")), lambda z: z["b"] != "")).alias("z")).select(F.col("z.a").alias("src"), F.col("z.b").alias("dst")).distinct()
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-3, max_rounds: int = 1000, stride: int = 4) -> DataFrame:
    """(host, trust, distrust). seeds: (host, trust, distrust), each column summing to 1 or 0.

    Runs until it has converged, or just ``rounds`` rounds where they are given, ``stride`` of them a job.

    Trust moves along the edges and distrust against them, as two kinds of rows of one edge table.
    """
    walk = edges.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = walk.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    walk = stash(walk.join(out, ["kind", "a"]).select("kind", F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("total")).alias("p")), "links")
    start = stash(seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("s")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("s")))).alias("x")).select("x.kind", "host", "x.s").where("s > 0"), "seeds")
    again = start.select("kind", "host", (F.col("s") * (1 - damping)).alias("s"), F.lit(0.0).alias("old"))

    def parts(ranks: DataFrame) -> DataFrame:
        moved = ranks.join(walk, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("s") * F.col("p") * damping).alias("s"), F.lit(0.0).alias("old"))
        return moved.unionByName(again)

    ranks, done, most = start, 0, max_rounds if rounds is None else rounds
    while done < most:
        now = ranks
        for _ in range(own := min(stride, most - done)):
            summed = parts(now)
            now = summed.groupBy("kind", "host").agg(F.sum("s").alias("s"))
        before = ranks.select("kind", "host", F.lit(0.0).alias("s"), F.col("s").alias("old"))
        seen = Observation()
        both = summed.unionByName(before).groupBy("kind", "host").agg(F.sum("s").alias("s"), F.sum("old").alias("old"))
        moved = lambda k: F.sum(F.when(F.col("kind") == k, F.abs(F.col("s") - F.col("old")))) / F.sum(F.when(F.col("kind") == k, F.col("s")))
        fresh = stash(both.observe(seen, F.greatest(moved("t"), moved("d")).alias("change"), F.count(F.when((F.col("old") == 0) & (F.col("s") > 0), 1)).alias("reached")).drop("old"), "ranks")
        if done:
            drop_stash(ranks)
        ranks, done = fresh, done + own
        if rounds is None and not seen.get["reached"] and (seen.get["change"] or 0.0) <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"scores have not converged in {max_rounds} rounds")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("s"))), F.lit(0.0))
    found = stash(ranks.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust")), "host-ranks")
    for x in (walk, start, *([ranks] if done else [])):
        drop_stash(x)
    return found


def judge(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = 0.5, **walk) -> DataFrame:
    """pages with host, path, rule, verdict, host_trust and host_distrust."""
    parsed = pages.drop("verdict", "host_trust", "host_distrust").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = _verdict(F.col("rule"), rules)
    votes = stash(parsed.where("host <> ''").groupBy("host").agg(F.count(F.when(by_rule == "allow", 1)).alias("a"), F.count(F.when(by_rule == "block", 1)).alias("b")), "host-votes")
    sums = votes.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")).first()
    seeds = votes.select("host", (F.col("a") / max(1, sums["sa"] or 0)).alias("trust"), (F.col("b") / max(1, sums["sb"] or 0)).alias("distrust"))
    ranks = propagate(host_edges(pages, url_col=url_col, html_col=html_col), seeds, **walk)
    sums = ranks.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    trust, distrust = F.col("trust") / (sums["t"] or 1.0), F.col("distrust") / (sums["d"] or 1.0)
    bad = distrust > threshold * (trust + distrust)
    hosts = ranks.select(F.col("host").alias("__h"), F.col("trust").alias("host_trust"), F.col("distrust").alias("host_distrust"), bad.alias("__bad"))
    out = parsed.join(hosts, F.col("host") == F.col("__h"), "left")
    verdict = F.coalesce(by_rule, F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).drop("__h", "__bad")
