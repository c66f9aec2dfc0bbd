import random
import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import url_filter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def shape(path):
    own = [x for x in path.split("/") if x]
    return tuple("*" if re.fullmatch(r"[0-9._-]+(\.[A-Za-z]{1,5})?", x) or len(x) >= 12 and re.search("[0-9]", x) else x for x in own)


def brute(rows, labelled=None):
    seen = defaultdict(lambda: [0, 0, 0])
    for _, url in rows:
        if (hp := parts(url))[0]:
            v = ruled(*hp)[1] if labelled is None else None
            for i, x in enumerate((1, v == "block", v is not None)):
                seen[hp[0], shape(hp[1])][i] += x
    for url, bad in labelled or []:
        for i, x in enumerate((1, bad, 1)):
            seen[parts(url)[0], shape(parts(url)[1])][i] += x
    at = dict.fromkeys(seen, "")
    segment = lambda own, k: own[k] if k < len(own) else ""
    for k in range(max((len(x) for _, x in seen), default=0)):
        child = defaultdict(lambda: [0, 0, 0])
        for key, c in seen.items():
            for i in range(3):
                child[key[0], at[key], segment(key[1], k)][i] += c[i]
        rare = {x for x, c in child.items() if c[0] < uf.RARE and x[2] not in ("", "*")}
        wide = {n for n, c in Counter(x[:2] for x in rare).items() if c > uf.WIDE}
        few = {x for x in child if x[:2] in wide and (x in rare or x[2] == "*")}
        new = {}
        for (h, own), t in at.items():
            x = (h, t, segment(own, k))
            alike = [c for y, c in child.items() if y[:2] == x[:2] and (y in few) == (x in few)]
            (_, b, m), ab, am = child[x], sum(c[1] for c in alike), sum(c[2] for c in alike)
            p, two = (ab + 1) / (am + 2), m > 0 and am > m
            apart = two and abs(b / m - (ab - b) / (am - m)) > uf.Z * (p * (1 - p) * (1 / m + 1 / (am - m))) ** 0.5
            name = "" if x[2] == "" else "/*" if x[2] == "*" or x in few and not apart else "/~" if two and not apart else "/" + x[2]
            new[h, own] = t + name
        at = new
    sums = Counter(), Counter()
    for key, (_, b, m) in seen.items():
        sums[0][key[0], at[key]] += b
        sums[1][key[0], at[key]] += m
    prior = sum(sums[0].values()) / (sum(sums[1].values()) or 1)
    out = []
    for i, url in rows:
        h, p = parts(url)
        rule, verdict = ruled(h, p)
        t = at.get((h, shape(p)))
        reject = t is not None and sums[1][h, t] > 0 and (sums[0][h, t] + uf.STRENGTH * prior) / (sums[1][h, t] + uf.STRENGTH) >= uf.PURITY
        out.append((i, h, p, rule, verdict or ("block" if reject else "allow"), t))
    return sorted(out, key=str)


HARD = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://a.com?x=/y", "https://a.com#f", "x://WWW.Example.COM/en/1", "x://q.example.com/en/", "x://xexample.com/en/a",
        "a://b://c/d", "https://a.net/es/é/日本", "https://a.net/es", "http://h.org//a///b/c/d/e", "http://h.org/a%20b?q", "http://u:p@h.org:80/x\n/y"]


def rows():
    out = HARD + [f"https://hot.example.net/{lang}/{i}" for i in range(30) for lang in ("es", "en", "de")]
    out += [f"https://wide.example.org/u{i}/post" for i in range(40)] + [f"https://wide.example.com/tag{i % 30}/en/x" for i in range(60)]
    out += [f"https://deep.example.net/a/b/c/{s}/{'es/' * (i % 3)}q{i}" for i in range(40) for s in ("d", "e")] + [f"https://hot.example.net/{s}/{i}/x" for i in range(9) for s in ("fr", "it")]
    out += [f"https://s.example.com/{'en' if i % 2 else 'fr'}/page/{i}" for i in range(40)]
    return list(enumerate(out + HARD))


def test_same_as_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows()], "page_id long, url string, host string, template string")
    got = sorted(map(tuple, uf.url_filter(pages).collect()), key=str)
    assert got == brute(rows())
    assert {r[4] for r in got} == {"allow", "block"}


def test_labelled_urls_reject_a_template(spark):
    labelled = [(f"https://farm.example.org/pills/{i}", 1) for i in range(60)] + [(f"https://farm.example.org/news/{i}", 0) for i in range(60)]
    own = [(1, "https://farm.example.org/pills/999"), (2, "https://farm.example.org/news/999"), (3, "https://other.example.org/pills/1")]
    got = uf.url_filter(spark.createDataFrame(own, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad int"))
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(own, labelled)
    assert [r[4] for r in got] == ["block", "allow", "allow"]


def test_held_out_labels(spark):
    """Farms and clean branches on many hosts, about 60 URLs of each labelled with some noise; the rest is judged. (With
    about 20 labels a branch the smoothing leaves 0.85 of the bad URLs blocked.)"""
    rng = random.Random(5)
    urls = []
    for h in range(20):
        branches = {f"{rng.choice('abcdefgh')}{k}": rng.random() < 0.4 for k in range(6)}
        urls += [(f"https://site{h}.org/{b}/{i}/{rng.choice('xyz')}", int(bad)) for b, bad in branches.items() for i in range(120)]
    rng.shuffle(urls)
    known, rest = urls[: len(urls) // 2], urls[len(urls) // 2 :]
    known = [(u, bad if rng.random() < 0.97 else 1 - bad) for u, bad in known]
    got = verdicts(spark, [u for u, _ in rest], known)
    # What the tree blocks, of the URLs that were not labelled.
    hit = [(got[i][0] == "block", bad) for i, (_, bad) in enumerate(rest)]
    assert sum(b for b, bad in hit if bad) > 0.9 * sum(bad for _, bad in hit)
    assert sum(not bad for b, bad in hit if b) < 0.05 * sum(b for b, _ in hit)


def test_empty_table(spark):
    assert uf.url_filter(spark.createDataFrame([], "page_id long, url string")).collect() == []


def verdicts(spark, own, labelled=None):
    own = spark.createDataFrame(list(enumerate(own)), "page_id long, url string")
    labelled = labelled and spark.createDataFrame(labelled, "url string, bad int")
    return {r.page_id: (r.verdict, r.template) for r in uf.url_filter(own, labelled).collect()}


def test_branches_without_labels_are_not_rejected(spark):
    own = [f"https://h.net/{lang}/{i}" for lang in ("es", "fr", "de", "en") for i in range(30)] + ["https://q.net/es/1", "https://q.net/de/1"]
    got = verdicts(spark, own)
    assert [got[i] for i in (0, 30, 60, 90)] == [("block", "/~/*"), ("block", "/~/*"), ("allow", "/de/*"), ("allow", "/en/*")]
    assert got[120][0] == "block" and got[121] == ("allow", "/de/*")
    labelled = [(f"https://h.net/{s}/{i}", int(s != "good")) for s, n in (("bad", 60), ("worse", 60), ("good", 20)) for i in range(n)]
    got = verdicts(spark, ["https://h.net/new/1", "https://h.net/good/9", "https://h.net/bad/9", "https://else.net/x"], labelled)
    assert [got[i][0] for i in range(4)] == ["allow", "allow", "block", "allow"]


@pytest.mark.parametrize("clean", [True, False])
def test_frequent_branches_beside_rare_ones_stay_apart(spark, clean):
    labelled = [(f"https://f.org/pills/{i}", 1) for i in range(60)] + [(f"https://f.org/tag{i}x", 0) for i in range(40) if clean]
    own = [f"https://f.org/tag{i}x" for i in range(40)] + ["https://f.org/pills/99"]
    got = verdicts(spark, own, labelled)
    assert got[40] == ("block", "/pills/*")
    assert {got[i] for i in range(40)} == {("allow", "/*")}


def test_deep_branches_are_told_apart(spark):
    labelled = [(f"https://f.org/a/b/c/{s}/{i}", int(s == "spam")) for s in ("spam", "news") for i in range(60)] + [("https://g.org/" + "x/" * 40 + "y", 0)]
    got = verdicts(spark, ["https://f.org/a/b/c/spam/99", "https://f.org/a/b/c/news/99", "https://f.org/a/b", "https://f.org/", "https://g.org/" + "x/" * 40 + "z"], labelled)
    assert got == {0: ("block", "/a/b/c/spam/*"), 1: ("allow", "/a/b/c/news/*"), 2: ("allow", "/a/b"), 3: ("allow", ""), 4: ("allow", "/x" * 40 + "/z")}
