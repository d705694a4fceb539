"""URL filter: rules first, then gradient-boosted trees on lexical features, all DataFrame functions.

The trees learn from labelled URLs: those that the rules decide in the table
at hand, and a few examples that ship with the operator (so that a table
without any decided URL still gets a model).  Training covers every labelled
row: features are cut at quantiles, rows that fall into the same bins are
summed to one *cell* by an aggregate, and each level of a tree is one
aggregate of gradients by (node, feature, bin) over the written cells.  What
reaches the driver is that histogram, at most
``2**(depth - 1) * features * bins`` rows.  Sums are of whole millionths, so
that the model does not depend on the order of additions.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import cut, release

#: Fixed values: (verdict, host/path), a rule fits its host and the subdomains.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Labelled examples: pages that hold text, and addresses of trackers, sessions, searches and machine-made hosts.
EXAMPLES = [
    ("https://www.site.example/articles/how-rivers-meander", 0),
    ("https://journal.example/2021/05/history-of-printing.html", 0),
    ("http://blog.site.example/en/notes-on-bread/", 0),
    ("https://docs.site.example/guide/getting-started", 0),
    ("https://news.site.example/world/1207", 0),
    ("https://museum.example/collection/paintings#top", 0),
    ("https://library.example/", 0),
    ("https://forum.site.example/thread/42", 0),
    ("http://a8f3e91c.ads.example/click?id=99817263544&pub=33817&cb=1618033988&sid=0a9f8e7d6c5b", 1),
    ("https://track.site.example/r.php?u=aHR0cHM6Ly9leGFtcGxl&c=88123&t=1699999999&k=Zx81Qp07", 1),
    ("http://10-0-22-71.pool.example/login.cgi?session=4f1d2c9b8a7e6f50&next=%2F&try=3", 1),
    ("https://shop.example/cart?add=7718263&qty=1&ref=email&utm_source=x&utm_medium=y&utm_campaign=z", 1),
    ("http://x1y2z3w4.example/p/8/1/7/2/6/3/index.php?a=1&b=2&c=3&d=4", 1),
    ("https://search.example/results?q=cheap+pills+online&page=31&sort=asc&filter=all", 1),
    ("https://cdn7731.example/pixel.gif?uid=00172635411982&rnd=0.7716253", 1),
    ("http://win-prize-4471.example/claim/99120/88172/77163?code=QX81-ZZ07-1182", 1),
]
#: Slots that the statistics of host suffixes are held in; suffixes of one slot share them.
SLOTS = 1024
UNIT = 1_000_000


# ------------------------------------------------------------------ parts and rules
def parts(url: Column) -> tuple[Column, Column]:
    """Host (``A-Z`` lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    after = F.substring(url, at + 3, F.char_length(url))
    known = url.isNotNull() & (at > 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (nulls if none does); of equal ones a block, then the one listed first."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in reversed(ranked):
        at = rule.find("/") if "/" in rule else len(rule)
        on, begins = rule[:at].lower(), rule[at:]
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(begins))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


# ------------------------------------------------------------------ features
def entropy(text: Column) -> Column:
    """Bits per character: runs of the sorted characters, summed in one pass."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def step(acc, c):
        same = acc["last"] == c
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
                        F.when(same, acc["sum"]).otherwise(acc["sum"] + weight(acc["run"])).alias("sum"))

    n = F.char_length(text)
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda acc: acc["sum"] + weight(acc["run"]))
    return F.when(n > 0, F.round(F.log2(n.cast("double")) - total / n, 6)).otherwise(F.lit(0.0))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of an address that need no statistics; a null address counts as empty."""
    text = F.coalesce(url, F.lit(""))
    n = F.char_length(text)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    count = lambda s, inside: n_of(s, inside).cast("double")
    n_of = lambda s, inside: F.char_length(s) - F.char_length(F.regexp_replace(s, inside, ""))
    return {
        "length": n.cast("double"),
        "depth": count(path, "/"),
        "digit_ratio": F.when(n > 0, F.round(n_of(text, "[0-9]") / n, 6)).otherwise(F.lit(0.0)),
        "entropy": entropy(text),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "labels": F.when(host == "", 0.0).otherwise(count(host, r"\.") + 1),
        "host_digits": count(host, "[0-9]"),
    }


def suffixes(host: Column) -> dict[str, Column]:
    """Slots of the host's last label and of its last two."""
    slot = lambda s: F.pmod(F.xxhash64(s), F.lit(SLOTS)).cast("int")
    return {"suffix": slot(F.substring_index(host, ".", -1)), "domain": slot(F.substring_index(host, ".", -2))}


@dataclass
class Model:
    """Trees over named features: a node is (feature, edge, left, right), a leaf a number."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    #: log odds by slot, of the last label and of the last two
    odds: dict[str, list[float]] = field(default_factory=dict)

    def score(self) -> Column:
        """Log odds of a block from the feature columns."""
        def spelled(t):
            if isinstance(t, float):
                return F.lit(t)
            name, edge, low, high = t
            return F.when(F.col(name) <= edge, spelled(low)).otherwise(spelled(high))

        return functools.reduce(operator.add, map(spelled, self.trees), F.lit(self.base))


def with_features(urls: DataFrame, odds: dict[str, list[float]] | None = None) -> DataFrame:
    """Adds ``host``, ``path``, the lexical features and, with ``odds``, the statistics of the suffixes, to ``url``."""
    host, path = parts(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    slots = suffixes(F.col("host"))
    out = out.withColumns(features(F.col("url"), F.col("host"), F.col("path")) | {f"{k}_slot": v for k, v in slots.items()})
    if odds is None:
        return out
    table = lambda k: F.split(F.lit(",".join(map(str, odds[k]))), ",").cast("array<double>")
    return out.withColumns({f"{k}_odds": F.when(F.col("host") == "", F.lit(0.0)).otherwise(F.get(table(k), F.col(f"{k}_slot"))) for k in slots})


FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "labels", "host_digits", "suffix_odds", "domain_odds")


# ------------------------------------------------------------------ training
def suffix_odds(labelled: DataFrame, prior: float = 4.0) -> dict[str, list[float]]:
    """Smoothed log odds of a block by slot, over all labelled rows (at most ``2 * SLOTS`` rows reach the driver)."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_slot").alias("slot")) for k in ("suffix", "domain")])).alias("x")
    counted = labelled.select(both, "blocked").groupBy("x.kind", "x.slot").agg(F.count("*").alias("n"), F.sum("blocked").alias("bad")).collect()
    odds = {k: [0.0] * SLOTS for k in ("suffix", "domain")}
    for r in counted:
        odds[r["kind"]][r["slot"]] = round(math.log((r["bad"] + prior) / (r["n"] - r["bad"] + prior)), 4)
    return odds


def _edges(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Up to ``bins - 1`` cuts of each feature, at its quantiles over all labelled rows (a mergeable sketch)."""
    share = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(c, share, 1000).alias(c) for c in FEATURES]).first()
    return {c: sorted(set(got[c] or [])) for c in FEATURES}


def _split(histogram: dict, features_: list[tuple[str, list[float]]], regular: float):
    """The best (gain, feature, bin) of a node from its gradients by (feature, bin); None if nothing gains."""
    best = None
    for f, (_, edges) in enumerate(features_):
        g = [histogram.get((f, k), (0, 0))[0] / UNIT for k in range(len(edges) + 1)]
        h = [histogram.get((f, k), (0, 0))[1] / UNIT for k in range(len(edges) + 1)]
        all_g, all_h, low_g, low_h = sum(g), sum(h), 0.0, 0.0
        for k in range(len(edges)):
            low_g, low_h = low_g + g[k], low_h + h[k]
            if low_h <= 0 or all_h - low_h <= 0:
                continue
            gain = (low_g ** 2 / (low_h + regular) + (all_g - low_g) ** 2 / (all_h - low_h + regular) - all_g ** 2 / (all_h + regular))
            gain = round(gain, 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, f, k
    return best


def boost(cells: DataFrame, edges: dict[str, list[float]], rounds: int, depth: int, rate: float, regular: float, base: float) -> list:
    """Trees on ``cells`` (bins ``b0, b1, ...``, rows ``n``, blocked ones ``bad``)."""
    named = [(c, edges[c]) for c in FEATURES]
    score, trees = F.lit(base), []
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("bin")) for i in range(len(named))])).alias("x")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-score))
        pull = F.round((F.col("bad") - F.col("n") * p) * UNIT).cast("long")
        bend = F.round(F.col("n") * p * (1 - p) * UNIT).cast("long")
        rows = cells.withColumns({"g": pull, "h": bend})
        node: Column = F.lit(1)  # heap numbers: children of k are 2k and 2k + 1
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        open_ = [1]
        for level in range(depth):
            found = rows.select(node.alias("node"), "g", "h", each).where(F.col("node").isin(open_)).groupBy("node", "x.f", "x.bin").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by: dict[int, dict] = {k: {} for k in open_}
            for r in found:
                by[r["node"]][r["f"], r["bin"]] = r["g"], r["h"]
            following = []
            for k in open_:
                best = _split(by[k], named, regular)
                total = [v for (f, _), v in by[k].items() if f == 0]
                g, h = sum(v[0] for v in total) / UNIT, sum(v[1] for v in total) / UNIT
                leaves[k] = round(rate * g / (h + regular), 6)
                if best is None:
                    continue
                _, f, cut_at = best
                splits[k] = f, cut_at
                low = [v for (i, b), v in by[k].items() if i == f and b <= cut_at]
                low_g, low_h = sum(v[0] for v in low) / UNIT, sum(v[1] for v in low) / UNIT
                for child, cg, ch in ((2 * k, low_g, low_h), (2 * k + 1, g - low_g, h - low_h)):
                    leaves[child] = round(rate * cg / (ch + regular), 6)
                    following.append(child)
                node = F.when((node == k) & (F.col(f"b{f}") <= cut_at), 2 * k).when(node == k, 2 * k + 1).otherwise(node) if level + 1 < depth else node
            open_ = following
            if not open_:
                break

        def spelled(k):
            if k not in splits:
                return leaves[k]
            f, cut_at = splits[k]
            return named[f][0], float(named[f][1][cut_at]), spelled(2 * k), spelled(2 * k + 1)

        def scored(k):
            if k not in splits:
                return F.lit(leaves[k])
            f, cut_at = splits[k]
            return F.when(F.col(f"b{f}") <= cut_at, scored(2 * k)).otherwise(scored(2 * k + 1))

        if 1 not in splits:
            break  # nothing left to learn
        trees.append(spelled(1))
        score = score + scored(1)
    return trees


def examples(spark) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(b).alias("blocked")) for u, b in EXAMPLES])
    return spark.range(1).select(F.inline(rows))


def fit(labelled: DataFrame, rounds: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.3, regular: float = 1.0) -> Model:
    """A model from ``url, blocked`` (0 or 1; rows where either is null are left out) and the shipped examples."""
    spark = labelled.sparkSession
    known = labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where("url IS NOT NULL AND blocked IS NOT NULL")
    rows = with_features(known.unionByName(examples(spark)))
    odds = suffix_odds(rows)
    rows = with_features(known.unionByName(examples(spark)), odds)
    edges = _edges(rows, bins)
    # the bin of a value: how many edges lie below it
    bin_of = lambda c: functools.reduce(operator.add, [(F.col(c) > e).cast("int") for e in edges[c]], F.lit(0))
    binned = rows.select("blocked", *[bin_of(c).alias(f"b{i}") for i, c in enumerate(FEATURES)])
    cells = cut(binned.groupBy(*[f"b{i}" for i in range(len(FEATURES))]).agg(F.count("*").alias("n"), F.sum("blocked").alias("bad")), "url-cells")
    n, bad = cells.agg(F.sum("n"), F.sum("bad")).first()
    base = round(math.log((bad + 1) / (n - bad + 1)), 6)
    trees = boost(cells, edges, rounds, depth, rate, regular, base)
    release(cells)
    return Model(base, trees, odds)


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``url, blocked`` of the rows that the rules decide."""
    host, path = parts(F.col("url"))
    src = pages.select(pages["url"].cast("string").alias("url")).withColumns({"host": host, "path": path})
    _, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return src.select("url", (verdict == "block").cast("int").alias("blocked")).where("blocked IS NOT NULL")


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    ``verdict`` is the rule's where one fits, else ``block`` if the model's
    log odds ``score`` are above 0.  A null or empty address, or one without
    ``://``, has an empty host and path and is judged by the model.  Repeated
    rows each give a row; an empty table gives none; other columns are
    ignored.
    """
    src = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    src = with_features(src, model.odds)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules if rules is not None else RULES)
    src = src.withColumns({"rule": name, "said": verdict, "score": F.round(model.score(), 6)})
    return src.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def judge_table(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``judge`` with a model learnt from the rows of ``pages`` that the rules decide."""
    rules = rules if rules is not None else RULES
    return judge(pages, fit(labelled_by_rules(pages, rules)), rules)
