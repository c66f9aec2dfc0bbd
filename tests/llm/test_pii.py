import hashlib
import re

import pytest

from gridloom.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in each) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(RAW[k], text or "") if good(k, m[0])]


TEXTS = [
    None, "", "a@b.c", "x a.b+c@d-e.f.g, y@z", "a@b.c-x@d.e_y@z.w@q.r", "é日🙂 q@w.e 🙂 +1 (017) 555-7713.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255 1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "x4111111111111112 4929348385146306", "4111  1111 1111 1111", "+12345678 +1234567 +1", "+1 (2) 3.4-5 6 7 8 9", "+++4 5555 5555",
    "a@b..c@d.e", "@a.b", "a@-.-", "9" * 50, "1 " * 9000, "a." * 9000 + "@x.y", "q@" + "a." * 5000 + "b", "1." * 6000 + "1", "+1" + "(" * 9000, "a@b.c" * 300, "5" * 20000,
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, email int, wide string")
    got = {r.doc_id: r for r in pii.redactions(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t and t[:60]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base(t)) for k in pii.KINDS]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_learned_spans_are_added(spark):
    rows = [(i, f"call my phone +1 ({200 + i % 700}) 555-{1000 + i} or not") for i in range(300)]
    rows += [(1000, "call my phone (017) 555-7713 now"), (1001, "card 4111 1111 1111 1112"), (1002, "no number 12 here")]
    rows += [(2000 + i, f"number 4111 1111 1111 {1000 + i} x") for i in range(200)]
    got = {r.doc_id: r for r in pii.redactions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].spans == "phone:14:28" and got[1000].n_phone == 0
    assert got[1001].spans == got[1002].spans == ""
    assert sum(r.n_phone for r in got.values()) == 300


def planted():
    """Documents with numbers and addresses of which half follow a cue, and with part numbers that never do; id -> the
    span that should be added."""
    rows, want = [], {}
    for i in range(1200):
        cue = "call my phone " if i % 2 else "reach them on "
        rows.append((i, f"{cue}+1 ({200 + i % 700}) 555-{1000 + i} or not"))
        rows.append((10000 + i, f"part 12{i % 90 + 10}-{i % 800 + 100}-{i % 900 + 100}7 fits"))
        rows.append((20000 + i, f"{'contact ' if i % 2 else 'by '}name{i}@host{i}.org now"))
        if i % 3 == 0:
            rows.append((30000 + i, f"{cue}({200 + i % 700}) 555-{1000 + i} or not"))
            want[30000 + i] = f"phone:{len(cue)}:{len(cue) + 14}"
            start, address = ("contact ", "by ")[i // 3 % 2], f"name{i} [at] host{i} [dot] org"
            rows.append((40000 + i, f"{start}{address} now"))
            want[40000 + i] = f"email:{len(start)}:{len(start) + len(address)}"
    return rows, want


def test_planted_spans_are_found(spark):
    rows, want = planted()
    got = {r.doc_id: r for r in pii.redactions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i].spans == spans for i, spans in want.items()) >= 0.9 * len(want)
    assert all(got[10000 + i].spans == "" for i in range(1200))


def brute_added(rows, half):
    """The spans added, by Python's patterns and loops over all rows; what follows the counts (cue rates, trees,
    thresholds) is shared with the operator."""

    def meets(x, spans):
        return any(s < x[1] and x[0] < e for s, e in spans)

    def reached(x, edges):
        return sum(x >= e for e in edges)

    found = []
    for at, (_, text) in enumerate(rows):
        text = text or ""
        by_kind = {k: [(s, e) for kind, s, e in base(text) if kind == k] for k in pii.KINDS}
        for kind in pii.KINDS:
            end = 0
            matches = list(re.finditer(pii.WIDER[kind], text))
            for j, m in enumerate(matches):
                before = text[end : m.start()][-pii.CONTEXT :]
                after = text[m.end() : matches[j + 1].start() if j + 1 < len(matches) else None][: pii.CONTEXT]
                end = m.end()
                digits, span = re.sub("[^0-9]", "", m[0]), m.span()
                x = {"kind": pii.KINDS.index(kind), "digits": reached(len(digits), (1, 8, 11, 14, 16)), "gaps": reached(len(re.sub(r"[^ ().,:_\[\]-]", "", m[0])), (1, 2, 3, 4))}
                x |= {"bracket": int(bool(re.search(r"[(\[]", m[0]))), "before": int(bool(re.search("[A-Za-z0-9]$", before))), "after": int(bool(re.match("[A-Za-z0-9]", after)))}
                each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                wrong = any(meets(span, by_kind[k]) for k in pii.KINDS if k != kind)
                wrong |= kind == "card" and sum(y - 9 if y > 9 else y for y in each) % 10 != 0
                wrong |= kind == "ip" and any(int(p) > 255 for p in re.split("[.,:]", m[0]))
                label = "good" if meets(span, by_kind[kind]) else "bad" if wrong else "open"
                found.append((half[at], x, label, bool(re.search(pii.CUES[kind], before)), at, f"{kind}:{span[0]}:{span[1]}"))
    counts = []
    for h in (0, 1):
        own = {}
        for fh, x, label, cue, _, _ in found:
            if fh == h:
                r = own.setdefault(tuple(x.values()), x | dict.fromkeys(["good", "bad", "open", "good_cued", "bad_cued", "open_cued"], 0))
                r[label] += 1
                r[f"{label}_cued"] += cue
        counts.append([own[k] for k in sorted(own)])
    rates = pii.cue_rates(counts[0])
    trees = pii.boosted(pii.estimated(counts[0], rates))
    least = pii.thresholds(trees, pii.estimated(counts[1], rates))
    added = [[] for _ in rows]
    for _, x, label, _, at, span in found:
        if label == "open" and x["kind"] in least and sum(t.of(x) for t in trees) >= least[x["kind"]]:
            added[at].append(span)
    return added


def test_added_spans_same_as_brute_force(spark):
    from pyspark.sql import functions as F

    rows = planted()[0] + [(50000 + i, t) for i, t in enumerate(TEXTS) if len(t or "") < 1000]
    rows += [(60000 + i, f"card {4111111111111111 + 7 * i} and {370000000000002 + i} at 10.0.{i % 300}.1, 1:2:3:{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))).collect()}
    want = brute_added(rows, [half[i] for i, _ in rows])
    got = {r.doc_id: [f"{a.kind}:{a.start}:{a.stop}" for a in r.added] for r in pii.personal_data(docs).collect()}
    assert any(want) and [got[i] for i, _ in rows] == want


def test_null_and_repeated_ids(spark):
    rows = [(None, "a@b.c"), (None, "1.2.3.4"), (7, "x@y.z"), (7, None)]
    got = sorted(r.spans for r in pii.redactions(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["", "email:0:5", "email:0:5", "ip:0:7"]


def test_trees_in_columns_and_in_python(spark):
    shapes = [({**dict.fromkeys(pii.STEPS, 0), "digits": d, "gaps": g}, 50, 45 if (d > 2) != (g > 1) else 3) for d in range(6) for g in range(5)]
    trees = pii.boosted(shapes)
    df = spark.createDataFrame([tuple(x.values()) for x, _, _ in shapes], [*pii.STEPS])
    from pyspark.sql import functions as F

    x = F.struct(*pii.STEPS)
    got = [r[0] for r in df.select(sum((t.column(x) for t in trees), F.lit(0.0))).collect()]
    assert got == pytest.approx([sum(t.of(x) for t in trees) for x, _, _ in shapes])
    assert all((s > 0) == (pos > 25) for s, (_, _, pos) in zip(got, shapes, strict=True))


def test_empty_table(spark):
    assert pii.redactions(spark.createDataFrame([], "doc_id long, text string")).collect() == []
