"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and benchmark items become sequences of template words in which numbers, units after numbers, and names are typed placeholders, so
that a question with other numbers, units or names has the same template. Windows of `window` template words are
hashed, and the windows of all texts are joined with those of the items. A text holds an item if at least `percent` of
the item's distinct windows are found in it; then slots are checked: over all windows of a text and an item, a value of the item stands for one value of
the text and the other way round (the most frequent pairing counts, ties to the smaller value). Windows with another pairing
do not count, and the share is taken again.

Names are told by the item alone: each of its words that begins with a capital and has a small letter is a slot, at the beginning of a sentence too, and
stands for any one word of a text in any case. What is hashed of an item's window is the words from its first to its last one that is no slot, with
the slots between them as its form; there are 15 forms at most, and each place of a text is hashed in those that the items have. Where slots would leave
too little (over half of an item's words, or fewer than two other words in a window), a window is found literally in any case, or with
capitalised words of the text at exactly its slots; a window of slots alone is found literally. An item wholly in capitals has no slots for names.

Plan: a text's word hashes are made within its row, exploded by place, hashed in the forms that begin with the place's word and joined at once with the items' hashes, which are broadcast if they
are counted to be at most `most_broadcast` bytes, and otherwise shuffled. Only texts that pass are read again for their slots.

Template words, by white space: digits (with inner `.,:/`) become one number sign each, a unit right after a number one unit sign;
the rest is lower-cased and loses ASCII punctuation. Words of punctuation alone are dropped.

Defined results: null and empty texts hold nothing. An item of fewer words than a window is one window of all its words
if it has three at least, found only in a text of as many words; a shorter one is never found. Repeated items are one item each. Rows that repeat an id are judged together. Null ids are left
out. Other columns of either table are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import staged

WINDOW, PERCENT = 5, 80
# Signs of one byte each, so that a text of ASCII alone stays one
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
NAMES = -1  # the form of a window whose slots are the text's own capitalised words
SHORT = 1 << 10  # forms of items that are shorter than a window, and of texts as short: this and the slots' bits

# Units of measure in their common short and long forms
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents degree degrees percent"

_SPACE = r"[\x20\x09-\x0D]"


def canonical(text: Column, names: bool = False) -> Column:
    """The text with placeholders in lower case; white space, and so the number of words, stays as it is.

    With `names` a word that begins with a capital and has a small letter also gets the name sign in front.
    """
    t = F.regexp_replace(text, f"[{NUMBER}{NAME}{UNIT}]", "")
    if names:
        t = F.regexp_replace(t, rf"(?<![^\x20\x09-\x0D])(?=\p{{Punct}}*+\p{{Lu}}[^\x20\x09-\x0D\p{{Ll}}]*+\p{{Ll}})", NAME)
    t = F.regexp_replace(t, r"[0-9]++(?:[.,:/][0-9]++)*+", NUMBER)
    t = F.regexp_replace(t, rf"(?i)({NUMBER}\p{{Punct}}*+{_SPACE}?)(?:{'|'.join(UNITS.split())})(?![^\p{{Punct}}\x20\x09-\x0D])", f"$1{UNIT}")
    return F.regexp_replace(F.lower(t), r"\p{Punct}++", "")


def _words(text: Column) -> Column:
    return F.split(text, f"{_SPACE}++")


def _windows(words: Column, window: int, everywhere: bool = False, before: int = 0) -> Column:
    """Array of (at, size, w0, w1, ...), a struct for each window, or each place; of fewer words than a window, but at least three, one with nulls at its end.

    With `before`, b1, b2, ... are the words in front of the place.
    """

    def windows(h: Column) -> Column:
        last = F.greatest(F.size(h) - (1 if everywhere else window), F.lit(0))
        at = F.when(F.size(h) >= window, F.sequence(F.lit(0), last)).when(F.size(h) >= min(3, window), F.array(F.lit(0)))
        # get() reads one element; slice() would copy the whole array for each window
        own = lambda i: [F.get(h, i + k).alias(f"w{k}") for k in range(window)] + [F.get(h, i - k).alias(f"b{k}") for k in range(1, before + 1)]
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.size(h).alias("size"), *own(i)))

    # The words are bound once, so that each window reads them and does not make them again
    return F.get(F.transform(F.array(words), windows), F.lit(0))


def _named(word: Column) -> Column:
    return F.startswith(word, F.lit(NAME))


def _hash(form: Column, literal: list[Column], slot: list[Column]) -> Column:
    """Hash of a window in a form with its slots, whose words are free, left out."""
    return F.xxhash64(form, *[F.when(s, F.lit(0).cast("long")).otherwise(w) for w, s in zip(literal, slot, strict=True)])


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, w, item_slots, form, first, h: each window w of an item in each form in which texts may hold it, with the hash of its first word if that is no slot."""
    both = F.zip_with(_words(canonical(F.col("text"), names=True)), _words(F.col("text")), lambda c, raw: F.struct(c.alias("c"), _bare(raw).alias("raw")))
    out = items.withColumn("pairs", F.filter(both, lambda p: p["c"] != "")).withColumn("n_names", F.size(F.filter("pairs", lambda p: _named(p["c"]))))
    out = out.select("item_id", (2 * F.col("n_names") <= F.size("pairs")).alias("few"), F.inline_outer(_windows(F.col("pairs"), window))).where("at IS NOT NULL")
    words = [F.col(f"w{k}.c") for k in range(window)]
    literal = [F.when(w.isNull(), F.lit(1).cast("long")).otherwise(F.xxhash64(F.ltrim(w, F.lit(NAME)))) for w in words]
    slot = [F.coalesce(_named(w), F.lit(False)) for w in words]
    mask = sum((F.when(s, 1 << k).otherwise(0) for k, s in enumerate(slot)), F.lit(0))
    n_words = sum((F.when(w.isNotNull(), 1).otherwise(0) for w in words), F.lit(0))
    free = F.col("few") & (n_words - F.bit_count(mask) >= 2)
    none = [F.lit(False)] * window
    short = F.col("size") < window
    lead = F.when(short, 0)
    for k in range(window):
        lead = lead.when(~slot[k], k)
    # The words from the first that is no slot, in its form: a bit for each word that is none
    after = [F.get(F.array(*literal), lead + k) for k in range(window)]
    open_ = [F.coalesce(F.get(F.array(*slot), lead + k), F.lit(True)) for k in range(window)]
    pattern = sum((F.when(o, 0).otherwise(1 << k) for k, o in enumerate(open_)), F.lit(0))
    whole = (1 << window) - 1
    one = lambda form, h, by, first: F.struct(form.cast("int").alias("form"), h.alias("h"), by.cast("int").alias("by"), first.cast("long").alias("first"))
    here = F.when(~slot[0] & ~short, literal[0])
    masked = F.when(short, one(SHORT + mask, _hash(SHORT + mask, literal, slot), F.lit(0), F.lit(None))).otherwise(one(pattern, _hash(pattern, [F.coalesce(a, F.lit(0).cast("long")) for a in after], open_), lead, after[0]))
    as_is = F.when(short, F.lit(SHORT)).otherwise(F.lit(whole))
    plain = one(as_is, _hash(as_is, literal, none), F.lit(0), F.when(~short, literal[0]))
    strict = F.when((n_words > F.bit_count(mask)) & ~short, F.array(plain, one(F.lit(NAMES), _hash(F.lit(NAMES), literal, slot), F.lit(0), here))).otherwise(F.array(plain))
    slots = F.array(*[F.struct(F.lit(k).alias("k"), F.when(s, NAME).otherwise(w).alias("kind"), F.col(f"w{k}.raw").alias("value")) for k, (w, s) in enumerate(zip(words, slot, strict=True))])
    slots = F.filter(slots, lambda s: s["kind"].rlike(f"[{NUMBER}{NAME}{UNIT}]"))
    own = F.when(free, _hash(SHORT + mask, literal, slot)).otherwise(_hash(F.lit(0), literal, none))
    out = out.select("item_id", own.alias("w"), slots.alias("slots"), F.inline(F.when(free, F.array(masked)).otherwise(strict)))
    # A slot's place is counted from where the text's words begin, which are those before the place too
    placed = F.transform("slots", lambda s: F.struct((s["k"] - F.col("by") + window - 2).alias("k"), s["kind"].alias("kind"), s["value"].alias("value")))
    return out.select("item_id", "w", placed.alias("item_slots"), "form", "first", "h")


def _bare(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"^\p{Punct}++|\p{Punct}++$", "")


def _text_windows(df: DataFrame, window: int, forms: list[int], firsts: DataFrame | None = None, values: bool = False) -> DataFrame:
    """The columns of df but its text, and h: each place of a text in each of the forms; with `values` also the words around it as written, and `at`.

    firsts(first, form): the forms of windows that begin with a word, small enough to send out; a place is then hashed in the forms of its word alone.
    """
    names = NAMES in forms
    kept = [c for c in df.columns if c != "text"]
    marked = _words(canonical(F.col("text"), names))

    def word(c: Column) -> list[Column]:
        own = F.ltrim(c, F.lit(NAME)) if names else c
        return [F.xxhash64(own).alias("h"), *([_named(c).alias("named")] if names else [])]

    if values:
        both = F.filter(F.zip_with(marked, _words(F.col("text")), lambda c, raw: F.struct(c.alias("c"), raw.alias("raw"))), lambda p: p["c"] != "")
        words = F.transform(both, lambda p: F.struct(*word(p["c"]), _bare(p["raw"]).alias("raw")))
    else:
        words = F.transform(F.filter(marked, lambda c: c != ""), lambda c: F.struct(*word(c)) if names else word(c)[0])
    # The outer forms keep the optimiser from adding a filter on the array's size, which would make the words again for each window
    before = window - 2 if values else 0
    out = df.select(*kept, F.inline_outer(_windows(words, window, everywhere=True, before=before))).where("at IS NOT NULL")
    plain = not (names or values)
    literal = [F.coalesce(F.col(f"w{k}" if plain else f"w{k}.h"), F.lit(1).cast("long")) for k in range(window)]

    # One expression for all forms: a hash for each would make a method too long for the JVM to compile
    span = lambda f: window if f == NAMES else f.bit_length()
    asked = lambda own: F.array(*[F.struct(F.lit(f).alias("form"), F.lit(span(f)).alias("span")) for f in own]) if own else F.array().cast("array<struct<form:int,span:int>>")
    short, long = asked([f for f in forms if f >= SHORT]), asked([f for f in forms if f < SHORT])
    if firsts is not None:
        of_word = F.when(F.col("form") == NAMES, window).otherwise(F.length(F.bin("form"))).alias("span")
        by_word = firsts.where(F.col("form") < SHORT).groupBy("first").agg(F.collect_set(F.struct("form", of_word)).alias("own"))
        out = out.join(F.broadcast(by_word), literal[0] == F.col("first"), "left")
        long = F.coalesce("own", F.array().cast("array<struct<form:int,span:int>>"))
        if names:  # a window may begin with any name
            long = F.when(F.coalesce(F.col("w0.named"), F.lit(False)), F.concat(long, asked([NAMES]))).otherwise(long)
    out = out.withColumn("asked", F.explode(F.when(F.col("size") < window, short).otherwise(long)))
    form = F.col("asked.form")
    out = out.where((F.col("size") < window) | (F.col("at") + F.col("asked.span") <= F.col("size")))
    slot = [(form.bitwiseAND(1 << k) == 0) != (form >= SHORT) for k in range(window)]
    if names:
        slot = [F.when(form == NAMES, F.coalesce(F.col(f"w{k}.named"), F.lit(False))).otherwise(s) for k, s in enumerate(slot)]
    around = [F.col(f"b{k}.raw") for k in range(before, 0, -1)] + [F.col(f"w{k}.raw") for k in range(window)] if values else []
    more = ["at", F.array(*around).alias("values")] if values else []
    return out.select(*kept, *more, _hash(form, literal, slot).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = PERCENT, most_broadcast: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, n_consistent, n_slots, changed: a row for each text and item it holds; the ids' columns keep their names.

    `changed` says that some slot has another value than the item's, which is a re-parameterised question.
    """
    body = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    of_items = staged(_item_windows(asked, window), "items")
    keys = of_items.select("item_id", "w", "h").distinct()
    totals = keys.groupBy("item_id").agg(F.countDistinct("w").alias("n_windows"))
    forms = sorted(r["form"] for r in of_items.select("form").distinct().collect())  # at most 2 ** window and those of short items
    if not forms:
        forms = [(1 << window) - 1]
    # What is sent to every task is measured in bytes: the item's id and windows, and its slots with their values
    size = of_items.agg(F.sum(F.length(F.col("item_id").cast("string")) + 60 + F.aggregate("item_slots", F.lit(0), lambda n, s: n + 60 + F.length(s["value"])))).first()[0]
    small = (size or 0) <= most_broadcast

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    firsts = of_items.select("first", "form").where("first IS NOT NULL").distinct() if small else None
    hits = _text_windows(body, window, forms, firsts).join(sent(keys), "h").select("doc_id", "item_id", "w").distinct()
    enough = 100 * F.col("n_found") >= percent * F.col("n_windows")
    found = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_found")).join(sent(totals), "item_id").where(enough)
    found = staged(found, "found")

    again = body.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    met = _text_windows(again, window, forms, firsts, values=True).join(sent(of_items), "h").join(found, ["doc_id", "item_id"], "left_semi")
    held = F.filter("item_slots", lambda s: F.get("values", s["k"]).isNotNull())  # a slot at a window's end needs no word
    pair = F.transform(held, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("item"), F.get("values", s["k"]).alias("text")))
    met = staged(met.select("doc_id", "item_id", "w", "at", pair.alias("pairs")).distinct(), "windows")
    votes = met.select("doc_id", "item_id", F.explode("pairs").alias("p")).groupBy("doc_id", "item_id", "p").agg(F.count(F.lit(1)).alias("n"))
    # The best partner of each value, in both directions; the smaller value wins a tie
    order = F.struct((-F.col("n")).alias("n"), F.col("p"))
    forth = votes.groupBy("doc_id", "item_id", F.col("p.kind"), F.col("p.item")).agg(F.min(order).alias("b")).select("doc_id", "item_id", F.col("b.p").alias("p"))
    back = votes.groupBy("doc_id", "item_id", F.col("p.kind"), F.col("p.text")).agg(F.min(order).alias("b")).select("doc_id", "item_id", F.col("b.p").alias("p"))
    kept = forth.join(back, ["doc_id", "item_id", "p"]).groupBy("doc_id", "item_id").agg(F.collect_list("p").alias("kept"))
    judged = met.join(kept, ["doc_id", "item_id"], "left").withColumn("good", F.forall("pairs", lambda p: F.coalesce(F.array_contains("kept", p), F.lit(False))))
    counted = judged.groupBy("doc_id", "item_id").agg(
        F.countDistinct(F.when(F.col("good"), F.col("w"))).alias("n_consistent"),
        F.max(F.size(F.coalesce("kept", F.array()))).cast("long").alias("n_slots"),
        F.coalesce(F.max(F.exists("kept", lambda p: p["item"] != p["text"])), F.lit(False)).alias("changed"),
    )
    return found.join(counted, ["doc_id", "item_id"]).where(100 * F.col("n_consistent") >= percent * F.col("n_windows")).select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "n_windows", "n_found", "n_consistent", "n_slots", "changed")
