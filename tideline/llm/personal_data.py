"""Personal data: base rules, overlapping candidates, boosted trees with calibrated thresholds; DataFrame functions only.

Base spans follow fixed rules by kind (email, ip, card, phone) and always stay. Generators with high recall propose further,
overlapping candidates: addresses with written-out signs, loose and tight runs of digits. Each candidate has six small integer features of its format
and of the words around it; none of them tells the base rule itself (no plus sign, check digit or range of parts). For
each kind, trees are boosted on labels that do not repeat the base rules:

- Right are the base spans of all texts, in copies of the texts in which each is rewritten so that its rule no longer finds it: an
  address with its signs in words or brackets, a card with a wrong check digit, a phone number without its plus sign. Nothing is added to ip addresses.
- The candidates of the texts as they are that meet no base span have no label: some are such missed forms, most are other things. Of those with the same features as many count as right as
  there should be if a person's data is missed once in `rarity` times, and all others as wrong. Competing runs, such as card-long ones whose check digit fails, therefore decide: where they
  are as many as the cards that pass, nearly all are wrong, and where they are few beside them, they are mistyped cards. Numbers pass a check digit one time in ten by
  chance; passing runs are discounted by a ninth of the failing ones of the same features.

Fitting uses counts of feature cells, of which there are at most 4,480 by the features' ranges; one half of the texts, by a hash of the id, fits, the other sets for each kind the
threshold at which at least `precision` of the candidates are right, by the same reckoning and with all competing runs. Candidates above it that overlap no base span
are added, best first where they overlap one another.

All is done within a text's row: positions come from the lengths of matches and of what lies between, counted in code points. There is no join
and no shuffle but that of the cell counts.

Defined results: a null text is empty and has no spans. Matches are leftmost and do not overlap within a kind; a match that fails its
kind's check is dropped and not tried again. Without a candidate, or of one class alone, nothing is added. Rows are judged one by one, so repeated
rows and ties do not matter; other columns are kept and must not begin with `pii_`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import boosting

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each equals its rule: possessive where no shorter match can help, and starts only where a leftmost match can start.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Generators of candidates
LOOSE = r"(?<![A-Za-z0-9])[0-9]++(?:[\x20().,/:-]{1,2}[0-9]++)++"
TIGHT = r"(?<![0-9])[0-9]{7,}+"
WRITTEN = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"

# Words that announce a kind of personal data
CUES = {"email": "mail email e-mail write contact", "ip": "ip host server address dns", "card": "card visa credit debit account iban", "phone": "phone tel call fax mobile cell number"}


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches in order: array of (start, end, value), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.length(x["m"])
        return F.struct(last.alias("at"), F.array_append(acc["out"], F.struct(first.alias("start"), last.alias("end"), x["m"].alias("value"))).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the check: from the right, every second one doubled, nines cast out."""
    digits = F.split(F.reverse(_digits(value)), "")

    def weigh(d: Column, i: Column) -> Column:
        n = F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))
        return F.when(i % 2 == 1, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules: array of (start, kind as an index of KINDS, end), in order."""
    n = lambda s: F.length(_digits(s["value"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    email = F.when(F.contains(text, F.lit("@")), _kind(matches(text, EMAIL), 0)).otherwise(none)
    ip = _kind(F.filter(matches(text, IP), lambda s: s["value"].rlike(_OCTETS)), 1)
    card = _kind(F.filter(matches(text, CARD), lambda s: luhn(s["value"])), 2)
    phone = F.when(F.contains(text, F.lit("+")), _kind(F.filter(matches(text, PHONE), lambda s: n(s).between(9, 15)), 3)).otherwise(none)
    numbers = F.when(text.rlike("[0-9]"), F.concat(ip, card, phone)).otherwise(none)
    return F.array_sort(F.concat(email, numbers))


def of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _cue(words: Column) -> Column:
    """1 to 4: the kind whose cue is among the words before; 0 if none is."""
    out = F.lit(0)
    for i in reversed(range(4)):
        out = F.when(words.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(CUES[KINDS[i]].split())})(?![a-z])"), i + 1).otherwise(out)
    return out


def _bin(value: Column, *cuts: int) -> Column:
    """How many of the cuts the value exceeds."""
    return sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.lit(0))


def candidates(text: Column) -> Column:
    """Candidates of all generators: array of (start, end, written, f), f an array of six features."""

    def featured(spans: Column, written: bool) -> Column:
        def one(s: Column) -> Column:
            v = s["value"]
            before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
            glued = F.when(F.substring(text, s["start"], 1).rlike(r"[\p{L}0-9=_\"]") & (s["start"] > 0), 1).when(F.substring(text, s["end"] + 1, 1).rlike(r"[\p{L}_\"]"), 1).otherwise(0)
            if written:
                low = F.lower(v)
                at = F.when(F.contains(v, F.lit("@")), 0).when(low.rlike(r"[(\[]at[)\]]"), 1).otherwise(2)
                dot = F.when(low.rlike(r"[(\[]dot[)\]]"), 1).when(F.contains(low, F.lit(" dot ")), 2).when(low.rlike(r"(?:at|@)[)\]]?.*(?:\.\x20|\x20\.)"), 3).otherwise(0)
                f = [at, dot, F.when(v.rlike(r"[.)\]\x20][A-Za-z]{2,6}$"), 1).otherwise(0), _bin(F.length(F.regexp_extract(v, r"^[^@\x20(\[]*", 0)), 1, 3, 20)]
            else:
                groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
                longest = F.array_max(F.transform(groups, F.length))
                dotted = F.contains(v, F.lit("."))
                spaced = v.rlike(r"[\x20()-]")
                f = [_bin(F.length(_digits(v)), 6, 8, 11, 15, 16, 19), F.when(dotted & spaced, 3).when(spaced, 2).when(dotted, 1).otherwise(0), _bin(F.size(groups), 1, 2, 3, 4), _bin(longest, 3, 4, 8)]
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(written).alias("written"), F.array(*[x.cast("int") for x in [*f, _cue(before), glued]]).alias("f"))

        return F.transform(spans, one)

    none = F.array().cast("array<struct<start:int,end:int,written:boolean,f:array<int>>>")
    numbers = F.when(text.rlike("[0-9]"), F.concat(featured(matches(text, LOOSE), False), featured(matches(text, TIGHT), False))).otherwise(none)
    written = F.when(text.rlike(r"(?i)@|\(at\)|\[at\]|\x20at\x20"), featured(matches(text, WRITTEN), True)).otherwise(none)
    return F.concat(numbers, written)


@dataclass(frozen=True)
class Model:
    """For each kind the trees, the probability from which a candidate is added (None adds nothing), and the features that a right candidate of the texts had; others add nothing."""

    trees: tuple[boosting.Model, ...]
    thresholds: tuple[float | None, ...]
    seen: tuple[tuple[int, ...], ...] = ((),) * 4


def _code(f: list) -> int | Column:
    """Six features, each below 8, as one number."""
    return sum((f[i] * 8**i for i in range(1, 6)), f[0])


def rewritten(text: Column, spans: Column, style: Column) -> Column:
    """struct(text, spans): the text with each span in a form that its rule does not find, by style 0 to 3, and where these forms are."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))
    signs = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(d).alias("dot")) for a, d in ((" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "."), (" @ ", "."))])
    sign = F.get(signs, style)

    def other(s: Column) -> Column:
        v = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        host = F.replace(F.substring_index(v, "@", -1), F.lit("."), sign["dot"])
        last = F.try_to_number(F.right(v, F.lit(1)), F.lit("9")).cast("int")
        return (
            F.when(s["kind"] == 0, F.concat(F.substring_index(v, "@", 1), sign["at"], host))
            .when(s["kind"] == 2, F.concat(F.substring(v, F.lit(1), F.length(v) - 1), ((last + 1) % 10).cast("string")))
            .when(s["kind"] == 3, F.ltrim(v, F.lit("+")))
            .otherwise(v)
        )

    def step(acc: Column, s: Column) -> Column:
        gap, own = F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), other(s)
        first = acc["size"] + F.length(gap)
        last = first + F.length(own)
        new = F.struct(first.alias("start"), s["kind"].alias("kind"), last.alias("end"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), last.alias("size"), F.concat(acc["out"], F.array(gap, own)).alias("out"), F.concat(acc["spans"], F.array(new)).alias("spans")))

    def end(acc: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))
        return F.struct(F.concat(F.array_join(acc["out"], ""), rest).alias("text"), acc["spans"].alias("spans"))

    return F.aggregate(spans, start, step, end)


def fit(docs: DataFrame, doc_id: str, text: str, precision: float = 0.95, rarity: int = 20) -> Model:
    """Boost trees on the counts of all texts; see the module's docstring."""
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(41)), F.lit(1_000_000))
    each = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), (F.pmod(draw, F.lit(2)) == 0).alias("fits"), (F.shiftright(draw, 1) % 4).cast("int").alias("style"))
    each = each.withColumn("base", base_spans(F.col("text")))
    other = each.where(F.size("base") > 0).select("fits", F.lit(False).alias("own"), F.inline(F.array(rewritten(F.col("text"), F.col("base"), F.col("style")))))
    each = each.select("fits", F.lit(True).alias("own"), "text", F.col("base").alias("spans")).union(other)
    each = each.withColumn("candidate", F.explode_outer(candidates(F.col("text")))).where("candidate IS NOT NULL")
    c = F.col("candidate")
    # Right is a candidate with the span's bounds, but for a sign at either end
    hit = [F.exists(of_kind("spans", k), lambda b: (F.abs(b["start"] - c["start"]) <= 1) & (F.abs(b["end"] - c["end"]) <= 1)).cast("long") for k in range(4)]
    met = F.exists("spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).cast("long")
    found = each.select("fits", "own", c["written"].alias("written"), c["f"].alias("f"), *[h.alias(f"k{k}") for k, h in enumerate(hit)], met.alias("met"))
    cells = found.where("own OR met > 0").groupBy("fits", "own", "written", "f").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("met") == 0).alias("none"), *[F.sum(f"k{k}").alias(f"k{k}") for k in range(4)])
    got = cells.collect()  # at most 4 x (4,480 + 480) rows by the features' ranges
    trees, thresholds, seen = [], [], []
    for k in range(4):
        parts: dict[bool, list] = {}
        for side in (True, False):
            here = {(r["own"], tuple(r["f"])): r for r in got if r["written"] == (k == 0) and r["fits"] == side}
            parts[side] = []
            for f in sorted({f for _, f in here}):
                own, copy = here.get((True, f)), here.get((False, f))
                free = own["none"] if own else 0
                right = copy[f"k{k}"] if copy and k != 1 else 0  # no form of an ip address is missed
                wrong = copy["n"] - right if copy else 0  # in the copies, what meets a span only in part
                if k == 2 and right:
                    passing = own["k2"] if own else 0
                    right *= max(0.0, 1 - free / (9 * passing)) if passing else 0.0
                if total := max(rarity * free, right) + wrong:
                    parts[side].append((f, total, right))
        model = boosting.fit(parts[True])
        trees.append(model)
        seen.append(tuple(sorted({_code(f) for side in parts.values() for f, _, hits in side if hits})))
        thresholds.append(boosting.threshold(model, parts[False], precision, 1) if model.trees else None)
    return Model(tuple(trees), tuple(thresholds), tuple(seen))


def find(docs: DataFrame, text: str, model: Model, base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """docs with two arrays of (start, kind, end): base spans, and these with the added ones."""
    import math

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(t))
    live = [k for k in range(4) if model.thresholds[k] is not None]
    if not live:
        return out.withColumn(spans, F.col(base))
    least = {k: math.log(model.thresholds[k]) - math.log1p(-min(model.thresholds[k], 1 - 1e-12)) - 1e-3 for k in live}  # a probability near 1 gives its log odds to a few digits only

    def judged(c: Column) -> Column:
        f = [F.get(c["f"], F.lit(i)) for i in range(6)]
        odds = [F.when((c["written"] == F.lit(k == 0)) & _code(f).isin(list(model.seen[k])), model.trees[k].log_odds(f)) for k in live]
        good = [F.when(o >= least[k], F.struct(o.alias("odds"), F.lit(-k).alias("rank"))) for k, o in zip(live, odds, strict=True)]
        best = good[0] if len(good) == 1 else F.greatest(*good)
        return F.struct((-best["odds"]).alias("odds"), c["start"].alias("start"), c["end"].alias("end"), (-best["rank"]).alias("kind"))

    free = F.filter(candidates(t), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    chosen = F.array_sort(F.filter(F.transform(free, judged), lambda c: c["kind"].isNotNull()))
    start = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def take(acc: Column, c: Column) -> Column:
        clash = F.exists(acc, lambda a: (a["start"] < c["end"]) & (c["start"] < a["end"]))
        return F.when(clash, acc).otherwise(F.array_append(acc, F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))

    return out.withColumn(spans, F.array_sort(F.concat(F.col(base), F.aggregate(chosen, start, take))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the first, or the longer of two, names the gap."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        label = F.concat(F.lit("["), F.upper(F.get(names, s["kind"])), F.lit("]"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, label))).otherwise(acc["out"]).alias("out"))
        )

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0))))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))
