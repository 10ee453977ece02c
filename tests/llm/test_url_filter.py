"""URL rules and the template tree against a plain version."""

import math
import re
from collections import Counter, defaultdict

from boardlake.llm import url_filter


def plain_rule(host, path):
    fits = [(len(t), t, v) for t, v in url_filter.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0]))
            and path.startswith("/" + t.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def plain(urls):
    """(host, path, rule, verdict) of each url, with the default parameters."""
    rows = []
    for u in urls:
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            cut = re.search("[/?#]", rest)
            host = rest[:cut.start()] if cut else rest
            path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        segments = [s for s in path.split("/") if s]
        shaped = []
        for s in segments:
            if re.match(r"[0-9]+(\.|$)", s):
                s = re.sub(r"^[0-9]+", "{n}", s, count=1)
            elif re.match(r"(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}(\.|$)", s):
                s = re.sub(r"^[0-9a-f-]{8,}", "{x}", s, count=1)
            shaped.append(s)
        rows.append((host, path, *plain_rule(host, path), tuple(shaped)))
    count = Counter((r[0], r[4]) for r in rows)
    kids = defaultdict(Counter)
    above = lambda p, d: (p[0] if d else None, tuple(s if s.startswith("{") else "w" for s in p[:d]), d)
    for (h, p), n in count.items():
        for d, s in enumerate(p):
            kids[h, above(p, d)][s] += n
    wild = {k for k, c in kids.items() if sum(c.values()) >= 8 and len(c) > 0.5 * sum(c.values())}
    named = {(h, p): tuple("*" if (h, above(p, d)) in wild else s for d, s in enumerate(p)) for h, p in count}
    cells, branch, host_n = defaultdict(Counter), Counter(), Counter()
    for (h, p), n in count.items():
        t = named[h, p]
        cells[h, t[:1]][t[1:]] += n
        branch[h, t[:1]] += n
        host_n[h] += n
    pooled = defaultdict(Counter)
    for (h, _), c in cells.items():
        pooled[h].update(c)
    like = {k for k, c in cells.items() if round(2 * sum(max(n / branch[k] - pooled[k[0]][s] / host_n[k[0]], 0) for s, n in c.items()), 9)
            <= 0.25 + math.sqrt(len(c) / branch[k])}
    template = {k: (("*",) if (k[0], t[:1]) in like else t[:1]) + t[1:] for k, t in named.items()}
    seen, known, bad = Counter(), Counter(), Counter()
    for h, _, rule, verdict, p in rows:
        key = h, template[h, p]
        seen[key] += 1
        known[key] += rule is not None
        bad[key] += verdict == "block"
    out = []
    for h, path, rule, verdict, p in rows:
        key = h, template[h, p]
        rejected = (bad[key] + 5) / (known[key] + 10) >= 0.8 and known[key] >= 0.5 * seen[key]
        out.append((h, path, rule, verdict or ("block" if rejected else "allow")))
    return out


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/EN/1", "x://example.com/en/1", "http://www.example.com/en/9?u=a://b.net/es/",
        "http://example.com/en/2#top", "http://example.com/english", "http://example.com/en", "http://com/", "http://com", "http://notcom.org/es/1",
        "http://a.net/es/x", "http://a.net/fr/", "http://a.net/de/1", "http://net/es/1", "http://xnet/es/1", "http://b.org?q=/net/es/",
        "http://b.org/a//b///c", "http://b.org/1234.html/deadbeef01/0a-f", "ftp://c.org:8080/p/q", "http://é.net/ES/1", "http://d.org/\nx"]
URLS += [f"http://shop.net/{'es' if i % 3 else 'fr'}/item-{i}" for i in range(60)] + [f"http://shop.net/de/item-{i}" for i in range(20)]
URLS += [f"http://shop.net/img/{i}/{'a' if i % 2 else 'b'}.png" for i in range(12)]
URLS += [f"http://news.org/{y}/{i}.html" for y in (2020, 2021, 2022) for i in range(9)] + ["http://news.org/about"] * 4


def test_equals_plain_version(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, host int").repartition(4)
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect())
    want = [(i, *x) for i, x in enumerate(plain(URLS))]
    assert got == want
    verdicts = {r[4] for r in got if r[3] is None}
    assert verdicts == {"allow", "block"}


def test_edges(spark):
    df = spark.createDataFrame([(None, "http://a.com/x"), (1, None), (1, None)], "page_id long, url string")
    got = sorted((tuple(r)[:5] for r in url_filter.judge_urls(df).collect()), key=repr)
    assert got == sorted([(None, "a.com", "/x", "com/", "allow"), (1, "", "", None, "allow"), (1, "", "", None, "allow")], key=repr)
    assert url_filter.judge_urls(df.limit(0)).count() == 0
