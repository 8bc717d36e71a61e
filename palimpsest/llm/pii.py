"""Personal data: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select.

Base spans follow fixed patterns and checks and always count.  Beside them each kind has a looser generator; its proposals may overlap one
another.  A proposal is described by a few small numbers of its format and context (`FEATURES`), and gradient-boosted trees of depth two
score it.

What the trees learn from is not whether a proposal is a base span, since that would teach them the base patterns and nothing else:

- Personal data are base spans and, for each of them, the ways of writing it that the base patterns miss (`dressed`: cards in groups of
  dots or of 15 digits, [at] and (dot), phones with 00 or without +, masked dots, IPv6), described at the span's own place in the corpus.
- Other things are proposals that fail the check of their kind (check digit, octets, digits of a phone number), that overlap a base span
  of another kind, or that are bare digits without any sign of a phone.  One in ten numbers passes the check digit by chance, so each nine
  failing cards stand for one passing one as well.
- Proposals that pass their checks and are no base spans are the ones to be judged; they are learnt from in neither way.

Spark counts all of these by their numbers, at most `CELLS` different ones, so boosting works on that bounded table alone.  One fold in
five (by a hash of the doc_id) is kept for calibration: a kind's threshold is the lowest score from which on the share of personal data
reaches `precision`, above any score at which other things are as many; a kind of which that fold has nothing takes the score that stands for that precision.  What passes and touches no
base span of its kind is added, leftmost first.

All of it is DataFrame functions.  The patterns are linear in the text: runs are entered at their start only, and repeats are possessive.

Defined results: a null text is empty and has no spans; rows are judged one by one, so copies get equal spans; an empty table gives an
empty result; a null doc_id is in the fitting folds; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")

# A match can only start where the text enters a run of the pattern's first class, or where the last match ended.
_RUN = r"(?:\G|(?<![{0}]))"
BASE = {
    "email": _RUN.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("0-9") + r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _RUN.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+)",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}+",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[\x20().\/-]{0,2}[0-9]){6,16}+",
}
MAY_HOLD = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9][.\[(]|:", "card": "[0-9]", "phone": "[0-9]"}
NEAR = {
    "email": r"(?i)(mail|contact|write|schreib|écri|correo|courriel)[^\n]*$",
    "ip": r"(?i)(\bip\b|addr|host|server|login)[^\n]*$",
    "card": r"(?i)(card|visa|master|amex|karte|carte|tarjeta|pay)[^\n]*$",
    "phone": r"(?i)(tel|phone|call|mobil|fax|ruf|appel|llam)[^\n]*$",
}

#: The numbers of a proposal, and how many values each has.
FEATURES = {"kind": 4, "digits": 6, "marks": 5, "check": 2, "sign": 2, "left": 3, "right": 3, "near": 2, "inside": 2}
CELLS = math.prod(FEATURES.values())


@dataclass(frozen=True)
class Params:
    trees: int = 30
    rate: float = 0.3
    l2: float = 1.0
    precision: float = 0.95
    context: int = 24


# --- spans in DataFrame functions -------------------------------------------------------------------------------------------------


def found(text: Column, pattern: str, may_hold: str) -> dict[str, Column]:
    """The matches of a pattern, and the lengths of what lies before each."""
    some = text.rlike(may_hold)
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<int>")
    return {
        "hit": F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "gap": F.when(some, F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))).otherwise(nothing),
    }


def placed(hit: Column, gap: Column, block: int = 64) -> Column:
    """Matches with their starts and ends (code points, end exclusive).

    Lengths are summed in blocks, then blocks, so that many matches in one text do not cost their square.
    """
    pairs = F.zip_with(hit, F.slice(gap, 1, F.size(hit)), lambda h, g: F.struct(h.alias("text"), g.alias("gap"), F.char_length(h).alias("size")))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hit) / block).cast("int") - 1), lambda k: F.slice(pairs, k * block + 1, F.lit(block)))

    def inside(part: Column, start: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["text"].alias("text")))).alias("out"),
        )
        return F.aggregate(part, F.struct(start.cast("int").alias("at"), empty.alias("out")), step)["out"]

    width = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
    starts = F.aggregate(cut, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + width(part))))
    whole = F.flatten(F.zip_with(cut, F.slice(starts, 1, F.size(cut)), inside))
    return F.when(F.size(hit) > 0, whole).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


_OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def valid(kind: str, text: Column) -> Column:
    n = F.length(digits_of(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(_OCTETS),
        "card": n.between(16, 19) & luhn(digits_of(text)),
        "phone": n.between(8, 15),
    }[kind]


#: Four numbers with dots, and dates.
_NO_PHONE = r"^[0-9]+(?:\.[0-9]+){3}$|^(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|^[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}$"


def checked(kind: str, text: Column) -> Column:
    """Whether a proposal, once its dressing is taken off, passes what can be checked of its kind."""
    n = F.length(digits_of(text))
    return {
        "email": text.rlike(r"[A-Za-z]{2,}$"),
        "ip": F.regexp_replace(text, r"[\[\]()]", "").rlike(_OCTETS) | text.contains(":"),
        "card": n.between(13, 19) & luhn(digits_of(text)),
        "phone": n.between(8, 15) & ~text.rlike(_NO_PHONE),
    }[kind]


def _bin(value: Column, *tops: int) -> Column:
    out = F.lit(len(tops))
    for k, top in reversed(list(enumerate(tops))):
        out = F.when(value <= top, k).otherwise(out)
    return out


def dressed(kind: str, text: Column) -> list[Column]:
    """Other ways of writing a base span, which the base patterns do not know."""
    digits = digits_of(text)
    fourteen = F.substring(digits, 1, 14)
    last = F.element_at(F.filter(F.array(*[F.lit(str(k)) for k in range(10)]), lambda c: luhn(F.concat(fourteen, c))), 1)
    octets = F.transform(F.split(text, r"\."), lambda x: F.lower(F.conv(x, 10, 16)))
    masked = lambda at, dot: F.regexp_replace(F.regexp_replace(text, r"\.(?=[A-Za-z0-9-]+$)", dot), "@", at)
    return {
        "email": [masked("[at]", "."), masked(" @ ", "."), masked("(at)", "(dot)"), masked("[at]", "[dot]")],
        "ip": [F.regexp_replace(text, r"\.", "[.]"), F.concat(F.lit("2001:db8:0:0:"), F.array_join(octets, ":"))],
        "card": [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1."), F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1/"), F.concat(fourteen, last)],
        "phone": [F.concat(F.lit("00"), F.substring(text, 2, 2**31 - 1)), F.substring(text, 2, 2**31 - 1), F.concat(F.lit("00"), digits), F.regexp_replace(text, r"^\+[0-9]{1,3}[\x20.-]+", "")],
    }[kind]


def bare(kind: str, text: Column, near: Column) -> Column:
    """Digits alone, where nothing says that they are a phone number."""
    return ~near & text.rlike("^(?!00)[0-9]+$") if kind == "phone" else F.lit(False)


def described(kind: str, text: Column, span: Column, context: int, inside: Column) -> Column:
    """The numbers of a proposal; inside: whether it overlaps a base span of another kind."""
    t, before = span["text"], F.substring(text, F.greatest(span["start"] - context, F.lit(0)) + 1, F.least(span["start"], F.lit(context)))
    side = lambda c: F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(1)
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": _bin(F.length(digits_of(t)), 0, 7, 11, 15, 19),
        "marks": _bin(F.length(F.regexp_replace(t, r"[A-Za-z0-9]", "")), 0, 1, 2, 4),
        "check": checked(kind, t).cast("int"),
        "sign": t.rlike(r"^\+|@").cast("int"),
        "left": side(F.substring(text, span["start"], F.when(span["start"] > 0, 1).otherwise(0))),
        "right": side(F.substring(text, span["end"] + 1, F.lit(1))),
        "near": before.rlike(NEAR[kind]).cast("int"),
        "inside": inside.cast("int"),
    }
    return F.struct(*[v.cast("int").alias(k) for k, v in values.items()])


def proposals(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id and by kind, for every row: the base spans, the proposals with their numbers, and the numbers of the dressed base spans.

    Proposals have `base` (whether they touch a base span of their kind) and `other` (whether they are known to be something else).
    """
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = text
    for name, patterns in (("base", BASE), ("more", LOOSE)):
        raw = raw.withColumns({f"{name}_{k}_{part}": c for k in KINDS for part, c in found(F.col("text"), patterns[k], MAY_HOLD[k]).items()})
    spans = raw.select("doc_id", "text", *[placed(F.col(f"{n}_{k}_hit"), F.col(f"{n}_{k}_gap")).alias(f"{n}_{k}") for n in ("base", "more") for k in KINDS])
    base = spans.withColumns({f"base_{k}": F.filter(f"base_{k}", _valid(k)) for k in KINDS})
    known = base.withColumns({f"more_{k}": F.transform(f"more_{k}", _numbered(k, params.context)) for k in KINDS} | {f"dressed_{k}": F.flatten(F.transform(f"base_{k}", _dressed(k, params.context))) for k in KINDS})
    return known.withColumns({f"base_{k}": F.transform(f"base_{k}", lambda s: F.struct(s["start"], s["end"])) for k in KINDS}).drop("text")


def _valid(kind: str):
    return lambda s: valid(kind, s["text"])


def _touches(kinds: list[str], s: Column) -> Column:
    return F.exists(F.concat(*[f"base_{k}" for k in kinds]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _numbered(kind: str, context: int):
    def one(s: Column) -> Column:
        x = described(kind, F.col("text"), s, context, _touches([k for k in KINDS if k != kind], s))
        other = (x["check"] == 0) | (x["inside"] == 1) | bare(kind, s["text"], x["near"] == 1)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("x"), _touches([kind], s).alias("base"), other.alias("other"))

    return one


def _dressed(kind: str, context: int):
    def all_ways(s: Column) -> Column:
        ways = [F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("text")) for t in dressed(kind, s["text"])]
        return F.array(*[described(kind, F.col("text"), w, context, F.lit(False)) for w in ways])

    return all_ways


# --- boosting ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Two levels of questions `value <= cut`; leaves by (first answer, second answer)."""

    first: tuple[str, int]
    second: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[tuple[float, float], tuple[float, float]]

    def value(self, x: dict[str, int]) -> float:
        a = int(x[self.first[0]] > self.first[1])
        f, cut = self.second[a]
        return self.leaves[a][int(x[f] > cut)]

    def column(self, x: Column) -> Column:
        def below(a: int) -> Column:
            f, cut = self.second[a]
            return F.when(x[f] <= cut, self.leaves[a][0]).otherwise(self.leaves[a][1])

        return F.when(x[self.first[0]] <= self.first[1], below(0)).otherwise(below(1))


def _best_split(rows: list[tuple[dict, float, float]], l2: float) -> tuple[float, tuple[str, int]]:
    """rows: (numbers, gradient, curvature).  The question that lowers the loss most; the first of equals."""
    best = (0.0, (next(iter(FEATURES)), FEATURES[next(iter(FEATURES))] - 1))
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for f, n in FEATURES.items():
        g, h = [0.0] * n, [0.0] * n
        for x, dg, dh in rows:
            g[x[f]] += dg
            h[x[f]] += dh
        left_g = left_h = 0.0
        for cut in range(n - 1):
            left_g += g[cut]
            left_h += h[cut]
            gain = left_g**2 / (left_h + l2) + (g_all - left_g) ** 2 / (h_all - left_h + l2) - g_all**2 / (h_all + l2)
            if gain > best[0] + 1e-12:
                best = (gain, (f, cut))
    return best


def boost(cells: list[tuple[dict[str, int], float, float]], params: Params) -> list[Tree]:
    """cells: (numbers, personal data, others).  Newton boosting of the logistic loss over the bounded table."""
    margin, trees = [0.0] * len(cells), []
    for _ in range(params.trees):
        rows = []
        for (x, yes, no), m in zip(cells, margin):
            p = 1 / (1 + math.exp(-m))
            rows.append((x, (yes + no) * p - yes, (yes + no) * p * (1 - p)))
        gain, first = _best_split(rows, params.l2)
        if gain <= 0:
            break
        second, leaves = [], []
        for a in (0, 1):
            own = [r for r in rows if int(r[0][first[0]] > first[1]) == a]
            _, (f, cut) = _best_split(own, params.l2)
            second.append((f, cut))
            leaves.append(tuple(-params.rate * sum(r[1] for r in part) / (sum(r[2] for r in part) + params.l2) for part in ([r for r in own if r[0][f] <= cut], [r for r in own if r[0][f] > cut])))
        tree = Tree(first, tuple(second), tuple(leaves))
        trees.append(tree)
        margin = [m + tree.value(x) for m, (x, _, _) in zip(margin, cells)]
    return trees


def thresholds(trees: list[Tree], cells: list[tuple[dict[str, int], float, float]], params: Params) -> dict[str, float]:
    """By kind, the lowest margin from which on the share of personal data is `precision` or more; infinite if there is none."""
    out = {}
    for k, kind in enumerate(KINDS):
        scored = sorted(((sum(t.value(x) for t in trees), yes, no) for x, yes, no in cells if x["kind"] == k), key=lambda s: -s[0])
        out[kind], yes, no = math.inf if scored else math.log(params.precision / (1 - params.precision)), 0.0, 0.0
        for i, (m, y, n) in enumerate(scored):
            yes, no = yes + y, no + n
            if i + 1 < len(scored) and scored[i + 1][0] == m:
                continue
            # what has this very score must be personal data more often than not, or the easy ones would carry it
            own = [s for s in scored[: i + 1] if s[0] == m]
            if sum(s[1] for s in own) <= sum(s[2] for s in own):
                break
            if yes >= params.precision * (yes + no):
                out[kind] = m
    return out


def by_chance(cells: list[tuple[dict[str, int], float, float]]) -> list[tuple[dict[str, int], float, float]]:
    """The cells with the cards that pass the check digit by chance, as those that fail it tell: one for every nine."""
    passing = [({**x, "check": 1}, 0.0, no / 9) for x, _, no in cells if x["kind"] == KINDS.index("card") and x["check"] == 0]
    summed: dict[tuple, list[float]] = {}
    for x, yes, no in [*cells, *passing]:
        at = summed.setdefault(tuple(x[f] for f in FEATURES), [0.0, 0.0])
        at[0], at[1] = at[0] + yes, at[1] + no
    return [(dict(zip(FEATURES, key)), yes, no) for key, (yes, no) in sorted(summed.items())]


def _selected(kind: str, trees: list[Tree], least: float) -> Column:
    if math.isinf(least) or not trees:
        return F.array().cast("array<struct<start:int,end:int>>")
    margin = lambda x: sum((t.column(x) for t in trees[1:]), trees[0].column(x))
    add = F.filter(f"more_{kind}", lambda s: ~s["base"] & (margin(s["x"]) >= F.lit(least - 1e-9)))
    return F.transform(add, lambda s: F.struct(s["start"], s["end"]))


def find_personal_data(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans, n_added) for every row."""
    proposed = materialise(proposals(documents, params))
    fold = (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)) % 5 == 0).alias("held_out")
    seen = proposed.select(fold, F.explode(F.concat(*[f"more_{k}" for k in KINDS])).alias("s")).where("s.base or s.other")
    shown = seen.select("held_out", "s.x", F.col("s.base").cast("int").alias("yes"))
    ways = proposed.select(fold, F.explode(F.concat(*[f"dressed_{k}" for k in KINDS])).alias("x")).select("held_out", "x", F.lit(1).alias("yes"))
    counted = shown.unionByName(ways).groupBy("held_out", "x").agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no"))
    cells: dict[bool, list] = {True: [], False: []}
    for r in counted.collect():  # CELLS rows of each fold at most
        cells[r["held_out"]].append((r["x"].asDict(), float(r["yes"]), float(r["no"])))
    trees = boost(by_chance(cells[False]), params)
    least = thresholds(trees, by_chance(cells[True]), params)

    out = proposed.withColumns({f"add_{k}": _selected(k, trees, least[k]) for k in KINDS})

    def said(k: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))

    base = F.array_join(F.concat(*[said(k, F.col(f"base_{k}")) for k in KINDS]), ",")
    spans = F.array_join(F.concat(*[said(k, F.concat(f"base_{k}", f"add_{k}")) for k in KINDS]), ",")
    return out.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"),
        sum((F.size(f"add_{k}") for k in KINDS[1:]), F.size(f"add_{KINDS[0]}")).cast("long").alias("n_added"),
    )
