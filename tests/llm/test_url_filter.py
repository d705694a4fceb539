import math
import random
from collections import Counter

from ticklake.llm import url_filter as U

SCHEMA = "page_id long, url string"
ODD = ["http://org/", "http://org", "HTTP://A.ORG/x?y#z", "https://www.Example.org/es/1", "https://example.org/en/19", "https://example.org/en/2",
       "https://x.example.com/fr/1", "https://example.com/fr", "https://a.com/de/", "http://notexample.org/es/", "http://xorg/", "http://a.net?q=/de/",
       "http://a.com#/de/", "no scheme org/", "", None, "://org/x", "http://", "http:///path", "a://b://c.org/d", "http://a.com:80/de/x", "http://a.com/de/é?ü",
       "http://com/de/" + "x" * 100_000, "http://ÀB.ORG/É", "http://a.org/line\nbreak?x"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def plain_rule(host, path, rules):
    fits = [(len(r), r, v) for v, r in rules
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def plain_features(url):
    host, path = plain_parts(url)
    t = url or ""
    n = len(t)
    counts = Counter(t)
    q = t.split("#", 1)[0]
    q = q.split("?", 1)[1] if "?" in q else ""
    return {
        "length": n, "depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in t) / n if n else 0,
        "entropy": -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0, "parameters": q.count("&") + 1 if q else 0,
        "labels": host.count(".") + 1 if host else 0, "host_digits": sum(c in "0123456789" for c in host)}


def test_hosts_paths_and_rules(spark):
    got = U.judge(spark.createDataFrame(list(enumerate(ODD)), SCHEMA), U.Model(odds={k: [0.0] * U.SLOTS for k in ("suffix", "domain")})).collect()
    assert len(got) == len(ODD)
    for r in got:
        host, path = plain_parts(ODD[r["page_id"]])
        rule, verdict = plain_rule(host, path, U.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), ODD[r["page_id"]]
        assert r["verdict"] == (verdict or "allow")


def test_features(spark):
    rows = U.with_features(spark.createDataFrame(list(enumerate(ODD + [u for u, _ in U.EXAMPLES])), SCHEMA)).collect()
    for r in rows:
        for k, v in plain_features(r["url"]).items():
            assert abs(r[k] - v) < 2e-6, (r["url"][:60] if r["url"] else r["url"], k)


def plain_boost(cells, edges, rounds, depth, rate, regular, base):
    """The same trees by a loop over cells in memory."""
    names = list(U.FEATURES)
    score = [base] * len(cells)
    out = []

    def grow(members, g, h, left):
        total_g, total_h = sum(g[i] for i in members) / U.UNIT, sum(h[i] for i in members) / U.UNIT
        best = None
        for f, c in enumerate(names):
            for k in range(len(edges[c])):
                low = [i for i in members if cells[i][0][f] <= k]
                lg, lh = sum(g[i] for i in low) / U.UNIT, sum(h[i] for i in low) / U.UNIT
                if lh <= 0 or total_h - lh <= 0:
                    continue
                gain = round(lg**2 / (lh + regular) + (total_g - lg)**2 / (total_h - lh + regular) - total_g**2 / (total_h + regular), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, k
        if best is None or left == 0:
            value = round(rate * total_g / (total_h + regular), 6)
            for i in members:
                score[i] += value
            return value
        _, f, k = best
        return (names[f], float(edges[names[f]][k]), grow([i for i in members if cells[i][0][f] <= k], g, h, left - 1),
                grow([i for i in members if cells[i][0][f] > k], g, h, left - 1))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [round((bad - n * q) * U.UNIT) for (_, n, bad), q in zip(cells, p)]
        h = [round(n * q * (1 - q) * U.UNIT) for (_, n, _), q in zip(cells, p)]
        out.append(grow(list(range(len(cells))), g, h, depth))
    return out


def close(a, b):
    if isinstance(a, float):
        return isinstance(b, float) and abs(a - b) < 2e-5
    return a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3])


def test_trees_equal_a_plain_boosting(spark):
    rng = random.Random(3)
    cells = {}
    for _ in range(400):
        bins = tuple(rng.randrange(4) for _ in U.FEATURES)
        n, bad = cells.get(bins, (0, 0))
        cells[bins] = n + 1, bad + (bins[1] + bins[3] > 3 and rng.random() < 0.9)
    edges = {c: [1.0, 2.0, 3.0] for c in U.FEATURES}
    rows = [(*k, n, int(bad)) for k, (n, bad) in cells.items()]
    schema = ", ".join(f"b{i} int" for i in range(len(U.FEATURES))) + ", n long, bad long"
    got = U.boost(spark.createDataFrame(rows, schema), edges, 3, 3, 0.3, 1.0, -0.5)
    want = plain_boost([(r[:-2], r[-2], r[-1]) for r in rows], edges, 3, 3, 0.3, 1.0, -0.5)
    assert len(got) == 3 and all(close(a, b) for a, b in zip(got, want))


def urls(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.4:
            q = "&".join(f"{rng.choice('abcxyz')}={rng.randrange(10**9)}" for _ in range(rng.randrange(3, 7)))
            out.append((f"http://c{rng.randrange(10**5)}.{rng.choice(['net', 'biz'])}/{rng.randrange(10**6)}?{q}", 1))
        else:
            out.append((f"https://www.site{rng.choice('abc')}.{rng.choice(['net', 'info'])}/{rng.choice(['story', 'guide', 'notes'])}/{rng.choice(['rivers', 'bread', 'lamps'])}-{rng.randrange(99)}", 0))
    return out


def test_held_out_urls(spark):
    rng = random.Random(11)
    model = U.fit(spark.createDataFrame(urls(rng, 600), "url string, blocked int"), rounds=4)
    test = urls(rng, 300)
    got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)], SCHEMA), model, []).collect()}
    right = sum((got[i] == "block") == bool(b) for i, (_, b) in enumerate(test))
    assert right >= 0.95 * len(test)


def test_unlabelled_and_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 5, 6), (1, "http://a.net/x", 5, 6), (2, None, 0, 0)], SCHEMA + ", host long, score long")
    got = U.judge_table(pages).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2] and all(r["rule"] is None for r in got)
    assert U.judge_table(spark.createDataFrame([], SCHEMA)).collect() == []
