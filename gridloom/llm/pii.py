"""Personal data by candidate gradient boosting, in DataFrame functions alone.

1. Base spans: fixed patterns for e-mail addresses, IPv4 addresses, card and phone numbers, with checks of range,
   length and check digit. They always stay.
2. Candidates: wider patterns of each kind (written-out addresses, numbers without a country code, other separators);
   they overlap the base spans and each other's kinds.
3. Labels come from checks that the trees don't see. A candidate that meets a base span of its kind is positive. One
   that a check refutes (the check digit or the octets are wrong, a base span of another kind covers a part of it) is
   negative and never added. The rest is open: cue words before a span tell how much of it is real. With c the share
   of positives that follow a cue and q that of negatives, a group of open candidates of which r follow a cue holds
   (r - q) / (c - q) real ones. Where positives follow cues no more often than negatives by ``LEAST_CUE``, cues
   say nothing and open candidates count as negative.
4. Boosted trees of depth two judge candidates by format and context features in a few steps each; the sign, the at,
   the check digit and the cue are no features. The features have at most ``MOST_SHAPES`` combinations; all candidates
   are counted by combination in Spark, and only these counts come to the driver.
5. Half of the documents fit the trees; on the other half each kind's threshold is calibrated to the lowest score
   whose candidates are positive with a lower confidence bound of at least ``PRECISION``. A kind without such a score
   adds nothing. Open candidates over the threshold are added.

Texts are scanned once; spans and features are kept in a narrow table. Patterns use possessive repetition, so they
neither backtrack over long runs nor need stack in proportion to them.

Defined results: a null text counts as empty and has no spans; every row gives a row; ties in a feature go to the
first pattern's match, leftmost and non-overlapping in each kind; without candidates nothing is added; a null doc_id is
a value like any other, and rows that repeat a doc_id each give their own row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, work_folder

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in forms that match the same spans in linear time. A match that follows another
#: directly may start within a run of characters, hence the \G.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Characters that a text must hold for a base pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.,:][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9])",
}
CUES = {"email": r"(?i)(mail|contact|write)", "ip": r"(?i)(\bip\b|address|host|server)", "card": r"(?i)(card|visa|credit|account)", "phone": r"(?i)(phone|tel|call|mobile|fax)"}
#: Steps of each feature.
STEPS = {"kind": 4, "digits": 6, "gaps": 5, "bracket": 2, "before": 2, "after": 2}
MOST_SHAPES = math.prod(STEPS.values())
TREES, SHRINK, LAMBDA = 24, 0.3, 1.0
PRECISION, CONFIDENCE = 0.95, 1.96
#: How much more often positives follow a cue than negatives, for cues to count.
LEAST_CUE = 0.1
CONTEXT = 24
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _found(pieces: Column, matches: Column) -> Column:
    """start, stop (code points), m, before, after of each match, from the pieces between matches."""
    none = F.lit([]).cast("array<struct<start:int,stop:int,m:string,before:string,after:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        piece, m, after = F.get(pieces, i), F.get(matches, i), F.get(pieces, i + 1)
        at = acc["at"] + F.length(piece)
        stop = at + F.length(m)
        one = F.struct(at.alias("start"), stop.alias("stop"), m.alias("m"), F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))
        return F.struct(stop.alias("at"), F.array_append(acc["out"], one).alias("out"))

    some = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, some).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits, not empty, passes the Luhn check."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(m))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["m"]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, half, and for each kind its valid base spans (``email`` ...) and candidates (``wide_email`` ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half"), text.alias("text"))
    patterns = {k: BASE[k] for k in KINDS} | {f"wide_{k}": WIDER[k] for k in KINDS}
    cut = []
    for name, pattern in patterns.items():
        needed = F.instr("text", NEEDS[name]) > 0 if name in NEEDS else F.col("text").rlike(r"@|[\[(]at[\])]" if name == "wide_email" else "[0-9]")
        pieces = F.when(needed, F.split("text", pattern, -1))
        cut += [pieces.alias(f"p_{name}"), F.when(needed, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m_{name}")]
    cut = own.select("doc_id", "half", *cut)
    spans = []
    for name in patterns:
        every = _found(F.col(f"p_{name}"), F.coalesce(F.col(f"m_{name}"), F.lit([]).cast("array<string>")))
        spans.append((_checked(name, every) if name in BASE else every).alias(name))
    return cut.select("doc_id", "half", *spans)


def _meets(span: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))


def _step(x: Column, *edges: int) -> Column:
    """The number of edges that x reaches."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _refuted(kind: str, s: Column) -> Column:
    """Whether a check speaks against a candidate that meets no base span of its kind."""
    other = F.lit(False)
    for k in KINDS:
        if k != kind:
            other = other | _meets(s, F.col(k))
    digits = _digits(s["m"])
    if kind == "card":
        return other | ~luhn(digits)
    return other | ~_valid("ip", F.regexp_replace(s["m"], "[,:]", ".")) if kind == "ip" else other


def _described(kind: str) -> Column:
    """A kind's candidates with their features, cue and label: 1 positive, 0 negative, null open."""

    def one(s: Column) -> Column:
        m = s["m"]
        return F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), F.lit(KINDS.index(kind)).alias("kind"),
            _step(F.length(_digits(m)), 1, 8, 11, 14, 16).alias("digits"), _step(F.length(F.regexp_replace(m, r"[^ ().,:_\[\]-]", "")), 1, 2, 3, 4).alias("gaps"),
            m.rlike(r"[(\[]").cast("int").alias("bracket"),
            s["before"].rlike(r"[A-Za-z0-9]$").cast("int").alias("before"), s["after"].rlike(r"^[A-Za-z0-9]").cast("int").alias("after"),
            s["before"].rlike(CUES[kind]).cast("int").alias("cue"),
            F.when(_meets(s, F.col(kind)), 1).when(_refuted(kind, s), 0).alias("label"),
        )

    return F.transform(f"wide_{kind}", one)


@dataclass(frozen=True)
class Tree:
    """Splits on the root, then on each side; a split is (feature, cut): left where the value is at most the cut."""

    root: tuple[str, int]
    sides: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def of(self, x: dict[str, int]) -> float:
        right = x[self.root[0]] > self.root[1]
        f, cut = self.sides[right]
        return self.leaves[2 * right + (x[f] > cut)]

    def column(self, x: Column) -> Column:
        def side(k: int) -> Column:
            f, cut = self.sides[k]
            return F.when(x[f] > cut, F.lit(self.leaves[2 * k + 1])).otherwise(F.lit(self.leaves[2 * k]))

        return F.when(x[self.root[0]] > self.root[1], side(1)).otherwise(side(0))


def boosted(shapes: list[tuple[dict[str, int], int, float]]) -> list[Tree]:
    """From (features, candidates, positives) of each combination, by Newton steps on the logistic loss."""
    score, trees = [0.0] * len(shapes), []
    splits = [(f, c) for f, n in STEPS.items() for c in range(n - 1)]

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple[float, tuple[str, int]]:
        """The split with the largest gain."""
        found = (-1.0, splits[0])
        for f, c in splits:
            part = [[0.0, 0.0], [0.0, 0.0]]
            for i in rows:
                side = part[shapes[i][0][f] > c]
                side[0] += g[i]
                side[1] += h[i]
            found = max(found, (sum(a * a / (b + LAMBDA) for a, b in part), (f, c)), key=lambda x: x[0])
        return found

    for _ in range(TREES if shapes else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [pos - n * q for (_, n, pos), q in zip(shapes, p, strict=True)]
        h = [n * q * (1 - q) for (_, n, _), q in zip(shapes, p, strict=True)]
        root = best(list(range(len(shapes))), g, h)[1]
        leaves, sides = [], []
        for right in (False, True):
            rows = [i for i, (x, _, _) in enumerate(shapes) if (x[root[0]] > root[1]) == right]
            f, c = best(rows, g, h)[1]
            sides.append((f, c))
            for high in (False, True):
                own = [i for i in rows if (shapes[i][0][f] > c) == high]
                leaves.append(SHRINK * sum(g[i] for i in own) / (sum(h[i] for i in own) + LAMBDA))
        trees.append(Tree(root, tuple(sides), tuple(leaves)))
        score = [s + trees[-1].of(x) for s, (x, _, _) in zip(score, shapes, strict=True)]
    return trees


def thresholds(trees: list[Tree], shapes: list[tuple[dict[str, int], int, float]]) -> dict[int, float]:
    """By kind: the lowest score down to which candidates are positive often enough."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = sorted(((sum(t.of(x) for t in trees), n, pos) for x, n, pos in shapes if x["kind"] == kind), reverse=True)
        n = pos = 0
        for i, (score, more, good) in enumerate(own):
            n, pos = n + more, pos + good
            if i + 1 < len(own) and own[i + 1][0] == score:
                continue
            z2, share = CONFIDENCE**2, min(max(pos / n, 0.0), 1.0)
            low = (share + z2 / (2 * n) - CONFIDENCE * math.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
            if low >= PRECISION:
                out[kind] = score - 1e-9
    return out


def cue_rates(counts: list[dict[str, int]]) -> dict[int, tuple[float, float]]:
    """By kind: the shares of positives and of negatives that follow a cue, where they are far enough apart."""
    out = {}
    for kind in range(len(KINDS)):
        n, cued, bad, bad_cued = (sum(r[x] for r in counts if r["kind"] == kind) for x in ("good", "good_cued", "bad", "bad_cued"))
        c, q = cued / n if n else 0.0, bad_cued / bad if bad else 0.0
        if c - q >= LEAST_CUE:
            out[kind] = (c, q)
    return out


def estimated(counts: list[dict[str, int]], rates: dict[int, tuple[float, float]]) -> list[tuple[dict[str, int], int, float]]:
    """(features, candidates, positives) of each combination. The share of an open group is not cut off at 0 and 1, so
    that sums over combinations are not pushed to one side."""
    out = []
    for r in counts:
        c, q = rates.get(r["kind"], (1.0, 0.0))
        real = (r["open_cued"] - q * r["open"]) / (c - q) if r["kind"] in rates else 0.0
        out.append(({f: r[f] for f in STEPS}, r["good"] + r["bad"] + r["open"], r["good"] + real))
    return out


def _is_kind(i: int):
    return lambda c: c["kind"] == i


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, stop) by kind, then start."""
    folder = work_folder(docs.sparkSession, "pii")
    found = stored(scanned(docs), folder, "found")
    wide = F.flatten(F.array(*(_described(k) for k in KINDS)))
    told = stored(found.select("doc_id", "half", *KINDS, wide.alias("wide")), folder, "told")
    names = list(STEPS)
    kinds = {"good": F.col("c.label") == 1, "bad": F.col("c.label") == 0, "open": F.col("c.label").isNull()}
    sums = [F.count_if(own).alias(name) for name, own in kinds.items()] + [F.count_if(own & (F.col("c.cue") == 1)).alias(f"{name}_cued") for name, own in kinds.items()]
    counted = told.select("half", F.explode("wide").alias("c")).groupBy("half", *(F.col(f"c.{f}").alias(f) for f in names)).agg(*sums)
    rows = [r.asDict() for r in sorted(counted.collect())]  # at most 2 * MOST_SHAPES rows
    rates = cue_rates([r for r in rows if r["half"] == 0])
    halves = [estimated([r for r in rows if r["half"] == half], rates) for half in (0, 1)]
    trees = boosted(halves[0])
    least = thresholds(trees, halves[1])

    def chosen(c: Column) -> Column:
        score = sum((t.column(c) for t in trees), F.lit(0.0))
        over = F.lit(False)
        for kind, at in least.items():
            over = over | ((c["kind"] == kind) & (score >= at))
        return over & c["label"].isNull()

    def listed(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    base = F.flatten(F.array(*(listed(k, F.col(k)) for k in KINDS)))
    picked = F.filter("wide", chosen)
    extra = F.flatten(F.array(*(listed(k, F.filter(picked, _is_kind(i))) for i, k in enumerate(KINDS))))
    return told.select("doc_id", base.alias("base"), extra.alias("added"))


def redactions(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = personal_data(docs)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    everything = F.flatten(F.array(*(F.array_sort(F.concat(of(F.col("base"), k), of(F.col("added"), k))) for k in KINDS)))
    return found.select("doc_id", *(F.size(of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(everything).alias("spans"))
