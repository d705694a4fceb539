"""Secret scan: fixed patterns, and character Markov models for everything else.

All of it is DataFrame functions.  Positions of a pattern's matches come from
the text between them (``split`` by the pattern) and the matches themselves,
summed up; they count code points.

Two first-order Markov models over the characters of candidates - random
strings and ordinary identifiers - give each candidate token a log-likelihood
ratio.  Both are trained from labelled samples, half shipped and half found in
the documents at hand, each part with its own probabilities so that neither
drowns the other.  Random: what a fixed pattern matched anywhere, and shipped
strings drawn evenly from the base64 alphabet.  Ordinary: every other string of
six or more candidate characters in all documents (digits, slashes and all), in
lower, upper and title case alike, and shipped numbers, dates, paths, versions
and constants.  A corpus that marks no secret still has both models.  Counts
are sums over all documents, at most 67 * 67 rows per model.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, by kind in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Cheap tests that every match passes.
_MAYBE = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"' :=]", "access": r"AKIA", "hex": HEX}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: What the ordinary model learns from.
PLAIN = r"[A-Za-z0-9+/_=-]{6,}"
#: Prior odds of about 1 : 1000 against a token being random.
THRESHOLD = 6.9

_SPAN = "struct<start:int,kind:int,stop:int>"


def _matches(text: Column, pattern: str, kind: int, part: int | None = None, at_least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches; with ``part``, only those whose group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    tail = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(part)), F.length) if part else F.transform(whole, F.length)
    rows = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), tail.alias("tail"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        ok = x["size"].isNotNull() & (x["tail"] >= at_least)
        return F.struct(stop.alias("at"), F.when(ok, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rows, start, step)["found"]


def _empty() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind."""
    parts = []
    for kind, (name, pattern, part, least) in enumerate((("assign", ASSIGN, 2, 6), ("access", ACCESS, None, 0), ("hex", HEX, None, 0))):
        parts.append(F.when(text.rlike(_MAYBE[name]), _matches(text, pattern, kind, part, least)).otherwise(_empty()))
    return F.array_sort(F.concat(*parts))


def shipped_random(n: int = 400) -> list[str]:
    """Strings drawn evenly from letters, digits, ``+`` and ``/`` by a fixed rule."""
    chars = ALPHABET[:64]
    return ["".join(chars[b % 64] for b in hashlib.sha512(f"random sample {i}".encode()).digest()) for i in range(n)]


#: Ordinary words of programs; the shipped ordinary samples are built from them.
COMMON = ("account address application archive authentication build cache certificate client cluster comment component config connection content controller "
          "customer database default delete description development directory document download element endpoint environment error event example export "
          "factory feature file filter folder format function general group handler header history identifier image import index instance interface "
          "invoice item language library license location manager message method model module network notification number object operation option order "
          "package page parameter password payment permission picture policy process product profile project property provider public query queue record "
          "reference register release report repository request resource response result schema script search security server service session setting "
          "source start status storage string structure summary support system table template test title token transaction update upload user value "
          "variable version view warning website window worker").split()


def shipped_ordinary() -> list[str]:
    """Identifiers, constants, paths, numbers, dates, times, versions, rulers and a few longer words, built from ``COMMON`` and counters."""
    out = [c * 40 for c in ALPHABET]  # rulers and fillers
    out += ["schifffahrtsgesellschaft", "quick", "brown", "jumped", "lazy", "over", "zwischen", "wahrscheinlichkeit", "rechtsanwalt", "aujourdhui", "quelques",
            "beaucoup", "naturellement", "desarrollo", "construccion", "exactly", "awkward", "rhythm", "knowledge", "throughout", "lymph", "subject", "zigzag"] * 5
    for i, w in enumerate(COMMON):
        x, y, z = (COMMON[(i * k + k) % len(COMMON)] for k in (7, 11, 13))
        four = [w, x, y, z]
        out += ["_".join(four), "-".join(four), "/".join(four), "/".join(four).upper(), "_".join(four).upper(), w + "".join(v.title() for v in four[1:]), "".join(v.title() for v in four),
                f"/{w}/{x}/{y}/{z}", f"{w}_{i}/{x}-{i * 7}", f"{w}={x}", f"{w}{i}"]
    for i in range(400):
        n = int(hashlib.sha512(f"number {i}".encode()).hexdigest(), 16)
        y, mo, d, h = 1970 + n % 80, 1 + n // 97 % 12, 1 + n // 1301 % 28, n // 7919 % 24
        out += [str(n)[:6 + i % 40], f"{y}{mo:02d}{d:02d}", f"{y}-{mo:02d}-{d:02d}", f"{y}/{mo:02d}/{d:02d}", f"{y}{mo:02d}{d:02d}/{y}{mo:02d}{d:02d}",
                f"{y}-{mo:02d}-{d:02d}T{h:02d}", f"{i}-{n % 10}-{n % 7}", f"+{str(n)[:11]}", "0123456789" * 2]
    return out


def _pairs(samples: list[str]) -> dict[str, float]:
    counts: dict[str, float] = {}
    for v in samples:
        for a, b in zip(v, v[1:]):
            counts[a + b] = counts.get(a + b, 0) + 1
    return counts


def _cased(counts: dict[str, float]) -> dict[str, float]:
    """Pairs in upper and title case too: a word shouted or at the start of a sentence is as ordinary."""
    out = dict(counts)
    for pair, n in counts.items():
        if pair.islower() and pair.isalpha():
            for other, share in ((pair.upper(), 0.1), (pair.title(), 0.05)):
                out[other] = out.get(other, 0) + share * n
    return out


def _rows(counts: dict[str, float], smooth: float = 0.3) -> list[list[float]]:
    """Probability of each next character, row by row."""
    rows = []
    for a in ALPHABET:
        row = [counts.get(a + b, 0) + smooth for b in ALPHABET]
        total = sum(row)
        rows.append([v / total for v in row])
    return rows


def shipped_model() -> list[float]:
    """Log-likelihood ratio of each character pair by the shipped samples alone."""
    return _ratios(_shipped(True), _shipped(False))


def _shipped(random: bool) -> list[list[float]]:
    return _rows(_pairs(shipped_random())) if random else _rows(_cased(_pairs(shipped_ordinary())))


def _ratios(random: list[list[float]], ordinary: list[list[float]]) -> list[float]:
    return [round(math.log(r) - math.log(o), 4) for a, b in zip(random, ordinary) for r, o in zip(a, b)]


def fit(docs: DataFrame, own: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair, row by row over ``ALPHABET``.

    ``own`` is the weight of the documents' samples against the shipped ones; a model that the documents give no
    sample for is the shipped one.  Long strings that are random by the shipped models are no ordinary sample.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    marked = F.col("text").rlike("(?:" + _MAYBE["access"] + "|" + _MAYBE["hex"] + ")") | F.col("text").rlike(_MAYBE["assign"])
    values = [F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
              F.regexp_extract_all("text", F.lit(HEX), F.lit(0))]
    random = F.transform(F.filter(F.concat(*values), lambda v: F.length(v) >= 16), lambda v: F.struct(v.alias("v"), F.lit(True).alias("random")))
    rest = F.when(F.col("marked"), F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")).otherwise(F.col("text"))
    plain = F.transform(F.regexp_extract_all(rest, F.lit(PLAIN), F.lit(0)), lambda v: F.struct(v.alias("v"), F.lit(False).alias("random")))
    found = F.concat(F.when(F.col("marked"), random).otherwise(F.array().cast("array<struct<v:string,random:boolean>>")), plain)
    src = docs.select(text.alias("text")).withColumn("marked", marked)
    tokens = src.select(F.explode(found).alias("x")).groupBy("x.v", "x.random").agg(F.count("*").alias("n"))
    odd = ~F.col("random") & F.col("v").rlike("^" + TOKEN) & (ratio(F.col("v"), shipped_model()) > THRESHOLD)
    tokens = tokens.where(~odd)
    chars = F.split("v", "")
    pairs = tokens.withColumn("c", chars).select(
        "random", "n", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    counted = pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 * 68 * 68 rows
    model = {}
    for k in (True, False):
        model[k] = _shipped(k)
        mine = {r["pair"]: float(r["n"]) for r in counted if r["random"] == k}
        if mine:
            mixed = zip(model[k], _rows(mine if k else _cased(mine)))
            model[k] = [[(1 - own) * g + own * m for g, m in zip(a, b)] for a, b in mixed]
    return _ratios(model[True], model[False])


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ``ALPHABET`` characters, random over ordinary."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(place, 1, F.length(token) - 1), F.slice(place, 2, F.length(token) - 1), lambda a, b: a * size + b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(table, i))


def markov_spans(text: Column, base: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans of tokens that look random and touch no base span."""
    found = _matches(text, TOKEN, 3)
    token = lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"])
    free = F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    random = F.filter(free, lambda s: ratio(token(s), model) > threshold)
    return F.when(text.rlike(TOKEN), random).otherwise(_empty())


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def _scanned(docs: DataFrame, model: list[float]) -> DataFrame:
    src = docs.withColumn("_text", F.coalesce(docs["text"].cast("string"), F.lit("")))
    src = src.withColumn("_base", base_spans(F.col("_text")))
    return src.withColumn("_all", F.array_sort(F.concat("_base", markov_spans(F.col("_text"), F.col("_base"), model))))


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_markov`` of every row.

    Null and empty texts have no spans.  Repeated rows each give a row.
    """
    count = lambda k: F.size(F.filter("_all", lambda s: s["kind"] == k)).cast("long")
    return _scanned(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"), count(3).alias("n_markov"))


def redact(docs: DataFrame, model: list[float]) -> DataFrame:
    """The rows with ``redacted``: the text with every span replaced by ``[kind]``; overlapping spans share one mark."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        ahead = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring("_text", acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(ahead, piece).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate("_all", start, step)
    text = F.when(F.size("_all") == 0, F.col("_text")).otherwise(
        F.concat(walked["out"], F.substring("_text", walked["at"] + 1, F.length("_text"))))
    return _scanned(docs, model).withColumn("redacted", text).drop("_text", "_base", "_all")
