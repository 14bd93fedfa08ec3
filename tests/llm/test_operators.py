"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import boosting, bwt_repeats, cross_polytope, decontamination, hyperminhash, language_id, personal_data, perspectives, sentencepiece_codec, toxicity, warc
from tideline.llm.components import connected_components
from tideline.llm.queries import tokenizer_path

R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n: int) -> str:
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumns({"lang": F.lit("x"), "score": F.lit(1), "h": F.lit(2), "key": F.lit(3)})


# 1


def test_warc_round_trip(spark):
    big, other = "é" * 600, "x\r\n\r\ny" * 300
    rows = [(1, "u", big), (5, "u\nv", big), (3, None, big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", other), (8, "u", other), (8, "u", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = warc.read_archives(spark, warc.deduplicated_archive(df)).collect()
    assert sorted((r["id"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        [(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (2, "response", None), (4, "response", None), (6, "response", None), (7, "revisit", 8), (8, "response", None), (8, "response", None)],
        key=lambda r: (r[0], r[1]),
    )
    by = {r["id"]: r for r in got}
    assert by[1]["payload_bytes"] == 1200 and by[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert by[5]["payload"] == big and by[8]["payload"] == other and by[1]["payload"] == ""
    assert warc.read_archives(spark, warc.deduplicated_archive(df.limit(0))).count() == 0


def test_warc_of_null_ids_and_long_payloads(spark):
    big = "".join(chr(97 + R.randrange(26)) for _ in range(3_000_000))
    rows = [(None, None, big), (None, "u", big), (4, "u", big), (9, "u", "z" * 5000), (8, "u", None), (None, "u", "")]
    got = warc.read_archives(spark, warc.deduplicated_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    kinds = collections.Counter((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == {(None, "revisit", 4, 3_000_000): 2, (4, "response", None, 3_000_000): 1, (9, "response", None, 5000): 1, (8, "response", None, 0): 1, (None, "response", None, 0): 1}
    assert {r["payload"] for r in got if r["id"] == 4} == {big}


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(n, "u", "x" * size) for n, size in enumerate([10] * 40 + [150] * 12 + [3000] * 3)]
    resolved = warc.resolve_revisits(warc.records_of(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "page_id", "url", "html"))
    warc.write_archives(resolved, f"file://{tmp_path}/a", file_bytes=400, sizes=(20, 200))
    held = collections.Counter(r["f"] for r in warc.read_archives(spark, f"file://{tmp_path}/a").select(F.lit(1).alias("f")).collect())
    assert held[1] == len(rows)
    files = [f.read_bytes() for f in (tmp_path / "a").glob("*.gz")]
    sizes = [[r[2] for r in warc._parsed(warc._inflated(f), True)] for f in files]
    assert sorted(map(tuple, sizes)) == sorted([(10,) * 20] * 2 + [(150, 150)] * 6 + [(3000,)] * 3)


@pytest.mark.parametrize("step", [7, 100, 1 << 20])
def test_unpacking_is_bounded(step):
    raw = b"a" * 300_000 + bytes(R.randrange(256) for _ in range(3000))
    members = gzip.compress(raw) + gzip.compress(b"") + gzip.compress(raw[::-1])
    blocks = list(warc._inflated(members, step))
    assert b"".join(blocks) == raw + raw[::-1] and max(map(len, blocks)) <= step
    with pytest.raises(ValueError, match="within a gzip member"):
        list(warc._inflated(members[:-9], step))


# 2


def rotated_by_hand(turns):
    """dialogue, speaker, text, spans, one turn after the other."""
    out = {}
    for dialogue in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] if t[2] is not None else "unknown", t[3] or "") for t in turns if t[0] == dialogue))
        for speaker in {t[2] for t in own} - {"system"}:
            text, spans = "", []
            for _, _, role, said in own:
                head = "<|system|>" if role == "system" else "<|assistant|>" if role == speaker else f"<|user name={re.sub(r'[|\r\n]', '_', role)}|>"
                text += head + "\n"
                if role == speaker:
                    spans.append(f"{len(text)}:{len(text) + len(said) + 7}")
                text += said + "<|end|>\n"
            out[dialogue, speaker] = (text, ",".join(spans), len(own), len(spans))
    return out


def test_rotation_of_any_rows(spark):
    turns = [(c, R.choice([None, *range(9)]), R.choice([None, "", "system", "ann", "bob", "a|b\nc", "user", "Zoë 🙂"]), R.choice([None, "", "yes", "naïve 🙂 text", "a,b"])) for c in [1, 2, 3, None] for _ in range(25)]
    turns += [(7, n, R.choice(["x", "y"]), "word " * (n % 3)) for n in range(20_000)] + [(8, 1, "system", "alone")] + [(9, 1, "x", "twice")] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumns({"head": F.lit(1), "at": F.lit("z"), "speaker": F.lit(2), "first": F.lit(None).cast("date")})
    got = {(r["conv_id"], r["speaker"]): (r["rendered"], r["mask_spans"], r["n_turns"], r["n_own"]) for r in perspectives.rotate(df).collect()}
    assert got == rotated_by_hand(turns) and (8, "system") not in got
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "b|o", "yo"), (1, 3, "ann", None), (2, 0, "system", "only"), (None, 0, None, "é")]
    got = {(r["conv_id"], r["speaker"]): r for r in perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "b|o"), (None, "unknown")}
    r = got[1, "ann"]
    assert r["rendered"] == "<|system|>\nbe<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=b_o|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in r["mask_spans"].split(",")]
    assert [r["rendered"][a:b] for a, b in spans] == ["hi<|end|>", "<|end|>"] and r["n_turns"] == 4 and r["n_own"] == 2


# 3


def brute_components(rows, percent, words):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("percent", "words"), [(85, 3), (80, 5)])
def test_near_duplicates(spark, percent, words):
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "É one"), (6, prose(9000)), (7, "  \t one \n")]
    for g in range(6):
        base = prose(R.choice([12, 40, 150]))
        rows += [(100 * g + 10 + k, base if k % 5 == 0 else edited(base, R.randrange(1, 12))) for k in range(40)]
    got = hyperminhash.near_duplicates(frame(spark, rows), words=words, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, percent, words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (9, "a b c d"), (None, "z z")]
    got = hyperminhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (4, 4), (4, 4), (9, 4)]
    # An id with two texts carries the components of both
    rows = [(2, "a b c d e"), (5, "a b c d e"), (5, "p q r s t"), (8, "p q r s t"), (None, "p q r s t"), (None, "k l m"), (None, "k l m")]
    got = hyperminhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("2", "2", True), ("5", "2", False), ("5", "5", True), ("8", "5", False), ("None", "5", False), ("None", "None", True), ("None", "None", True)])
    left = hyperminhash.one_of_each(frame(spark, [*rows, (2, "a b c d e"), (7, None), (7, None)]), words=3, percent=85).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == [("2", "a b c d e"), ("5", "p q r s t"), ("7", "None"), ("7", "None"), ("None", "k l m")]
    assert hyperminhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_in_one_large_group(spark):
    """Texts at many distances from one base, whose edits are partly shared: hubs leave much open, the prefix join must find the rest."""
    base = prose(120).split()
    shared = [[R.randrange(118), f"s{k}"] for k in range(12)]
    rows = []
    for i in range(250):
        w = list(base)
        for k in R.sample(range(12), R.randrange(5)):
            w[shared[k][0]] = shared[k][1]
        for _ in range(R.randrange(9)):
            w[R.randrange(118)] = f"own{i}" if i % 3 else "any"
        rows.append((i, " ".join(w[: R.choice([120, 120, 104])])))
    for percent, words in ((85, 3), (80, 5)):
        got = hyperminhash.near_duplicates(frame(spark, rows), words=words, percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, percent, words)


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    e = hyperminhash.estimate(*[hyperminhash.registers(x)[None] for x in (a, b)], np.array([len(a)]), np.array([len(b)]))
    assert abs(e[0] - 1 / 3) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


# 4


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(w[k : k + length] for _, w in raw for k in range(len(w) - length + 1))
    out = []
    for i, w in raw:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if seen[w[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(w, np.uint8)[~gone])
        out.append((i, len(w), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [bwt_repeats.HOT_BYTES, 3000, 0])
def test_repeats(spark, hot):
    passage = prose(120)
    rows = [(0, "a" * 1500), (1, "ab" * 500), (2, None), (3, ""), (4, "x" * 399), (5, "é" * 500), (6, "é" * 200 + "q" + "é" * 250), (7, "abc" * 300 + "z" * 100), (7, "abc" * 300 + "z" * 100), (8, "z" * 100 + "abc" * 300)]
    rows += [(10 + k, f"{prose(R.randrange(60))} {passage} {prose(R.randrange(60))}") for k in range(30)]
    got = bwt_repeats.remove_repeats(frame(spark, rows), hot_bytes=hot).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute_repeats(rows, 400)
    assert bwt_repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_interval_expansion():
    rng = np.random.default_rng(2)
    for _ in range(60):
        block = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 200)).astype(np.uint8)
        length = int(rng.integers(1, 16))
        raw, n = block.tobytes(), len(block) - length + 1
        seen = collections.Counter(raw[i : i + length] for i in range(max(0, n)))
        assert bwt_repeats.shares_prefix(block, length)[: max(0, n)].tolist() == [seen[raw[i : i + length]] > 1 for i in range(max(0, n))]


# 5


def test_toxicity_on_held_out_rows(spark):
    docs = [(i, prose(60) + (" you absolute scumbag idiot" if i % 4 == 0 else "")) for i in range(600)] + [(9000, None), (9001, ""), (9002, "scumbagg idiots " + prose(20))]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(1, None)], "doc_id long, toxic int")
    df = frame(spark, docs)
    model = toxicity.fit(df, labels, "doc_id", "text", "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, "text", model, ("doc_id",)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[9002] >= 0.5 > got[9000] == got[9001]
    assert {r["score"] for r in toxicity.score(df, "text", toxicity.fit(df, labels.limit(0), "doc_id", "text", "toxic"), ("doc_id",)).collect()} == {0.0}


def test_toxicity_learns_from_long_texts_and_a_whole_sample(spark):
    rows = [(i, " ".join([prose(14_000), "vile scum" * (i % 2)] + ["vile"] * (3000 * (i % 2)))) for i in range(40)]
    assert min(len(t) for _, t in rows) > 60_000
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels, "doc_id", "text", "toxic")
    assert model.log_odds_by_row().any()
    ids = [(i, "vile scum" if i % 3 == 0 else "w1 w2") for i in range(12_000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12_000)], "doc_id long, toxic int")
    seen = []
    train, toxicity.train = toxicity.train, lambda texts, y, shift: seen.append(y) or train(texts[:50], y[:50], shift)
    try:
        toxicity.fit(frame(spark, ids), labels, "doc_id", "text", "toxic")
    finally:
        toxicity.train = train
    assert 2300 < seen[0].sum() < 2700 and 4700 < (1 - seen[0]).sum() < 5300


# 6


def test_neighbours_and_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:] += 2 * rng.normal(size=(8, 24)).astype(np.float32)[rng.integers(0, 8, 800)]
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2100, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1))
    got = collections.defaultdict(list)
    for r in sorted(cross_polytope.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, block=100).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, near in got.items():
        d = np.sqrt(np.square(x.astype(float) - x[q].astype(float)).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        assert near == sorted(near) and len(near) == 10
        assert all(abs(s - d[v]) < 1e-9 for s, v in near)
        hits += len(set(want.tolist()) & {v for _, v in near})
    assert got[0] == [(0.0, v) for v in range(50, 60)]
    assert hits >= 0.9 * 10 * len(got)


def exact_neighbours(rows, k=10):
    """Brute force over (id, vector) rows of one length: query id -> [(distance, id)]."""
    out = {}
    for q in {i for i, _ in rows if i % 100 == 0}:
        near = {}
        for j, v in rows:
            if j != q:
                d = min(float(np.sqrt(np.square(np.array(v) - np.array(u)).sum())) for i, u in rows if i == q)
                near[j] = min(d, near.get(j, d))
        out[q] = sorted((d, j) for j, d in near.items())[:k]
    return out


def test_neighbours_of_repeated_ids_common_vectors_and_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(90)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(100, 200)] + [(5, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (100, rows[7][1]), (0, [1.0, 2.0, 3.5]), (8, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (40, 4096):  # every bucket probed: the search is exact
        got = collections.defaultdict(list)
        for r in sorted(cross_polytope.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, share=1.0, block=block).collect(), key=lambda r: r["rank"]):
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert dict(got) == exact_neighbours(rows)
    few = df.where("vec_id in (0, 1, 2)")
    assert {r["vec_id"] for r in cross_polytope.neighbours(few, "vec_id", "embedding", F.col("vec_id") % 100 == 0, share=1.0).collect()} == {1, 2}
    assert cross_polytope.neighbours(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0


def test_fineness_and_recall_of_finer_buckets(spark):
    assert cross_polytope.fineness(2_000, 64) == ([64], 16)
    assert cross_polytope.fineness(2 * 128 * 256, 64)[0] == [64, 1]
    assert cross_polytope.fineness(10**9, 64)[0] == [64, 64, 64]
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(cross_polytope.fineness(3000, 32, 4)[0]) == 2
    hits = collections.defaultdict(set)
    for r in cross_polytope.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, per_bucket=4).collect():
        hits[r["query_id"]].add(r["vec_id"])
    found = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(np.square(x - x[q]).sum(axis=1))
        d[q] = np.inf
        found += len(hits[q] & set(np.argsort(d)[:10].tolist()))
    assert found >= 0.9 * 300


# 7

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(t):
    return [(m.start(), k, m.end()) for k, kind in enumerate(RULES) for m in re.finditer(RULES[kind], t or "") if passes(kind, m[0])]


def test_personal_data(spark):
    parts = ["1", "22", "4207051279108084", "@", "a", "b.c", ".", " ", "-", "+1", "(", "é", "😀", "255", "0255", "256", "4 0 5 8 ", "mail.x", "_", "%", "192.168.1.1", "+1 (956) 555-0122", "4058826588634783"]
    rows = [(i, "".join(R.choice(parts) for _ in range(R.randrange(30)))) for i in range(1500)] + [(9001, None), (9002, ""), (9003, "a" * 100_000), (9005, "1." * 20_000), (9006, "a@" * 20_000), (9007, "+" * 20_000)]
    df = frame(spark, rows)
    model = personal_data.fit(df, "doc_id", "text")
    got = {r["doc_id"]: r for r in personal_data.find(df, "text", model).collect()}
    for i, t in rows:
        base = [(s["start"], s["kind"], s["end"]) for s in got[i]["pii_base"]]
        assert base == sorted(brute_spans(t))
        assert set(base) <= {(s["start"], s["kind"], s["end"]) for s in got[i]["pii_spans"]}
    assert personal_data.find(df.limit(0), "text", personal_data.fit(df.limit(0), "doc_id", "text")).count() == 0


def test_personal_data_adds_what_the_rules_miss(spark):
    def digits(n):
        return "".join(R.choice("0123456789") for _ in range(n))

    def card(good=True):
        body = digits(15)
        s = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(int(c) for c in reversed(body)))
        return body + str((-s + (0 if good else 3)) % 10)

    rows = []
    for i in range(1200):
        kind = (f"{R.choice(WORDS)}.x{i}@mail{i % 9}.example.com", card(), f"+1 ({digits(3)}) 555-{digits(4)}", ".".join(str(R.randrange(256)) for _ in range(4)))[i % 4]
        rows.append((i, f"{prose(12)} and {kind} {prose(3)} at noon. Then {R.randrange(1900, 2030)} of {R.randrange(3000)} {prose(4)}"))
    odd = {5001: "anna.x9 (at) mail4.example (dot) com", 5002: card(False), 5003: f"1 ({digits(3)}) 555-{digits(4)}", 5004: "bob.x7 at mail3 dot example dot com"}
    rows += [(i, f"{prose(8)} and {t} {prose(8)}") for i, t in odd.items()] + [(6000, "we met at home. Then in 1999 and 2004 about 1200 came at noon. Later 37,500 left")]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in personal_data.find(df, "text", personal_data.fit(df, "doc_id", "text")).collect()}
    text = dict(rows)
    for i, t in odd.items():
        assert not got[i]["pii_base"] and [text[i][s["start"] : s["end"]] for s in got[i]["pii_spans"]] == [t], i
    assert not [text[i][s["start"] - 5 : s["end"]] for i in (*range(1200), 6000) for s in got[i]["pii_spans"] if s not in got[i]["pii_base"]]


def test_competing_runs_are_not_personal_data(spark):
    """As many card-long runs fail the check digit as pass it, in the same places: they are other numbers. A new form of an address is found in a text like no other."""
    cards = ["4207051279108084", "4058826588634783"]
    rows = [(i, f"{prose(6)} and {cards[i % 2] if i % 2 else str(10**15 + 977 * i)} {prose(6)}") for i in range(400)]
    rows += [(1000 + i, f"{prose(5)} to u{i}.w@host{i % 7}.example.net {prose(5)} at noon. Then {prose(2)}") for i in range(600)] + [(5000, "Schreiben Sie bitte: jörg u7.w (at) host9.example (dot) net heute")]
    got = personal_data.find(frame(spark, rows), "text", personal_data.fit(frame(spark, rows), "doc_id", "text"))
    more = {r["doc_id"]: r["more"] for r in got.select("doc_id", F.array_except("pii_spans", "pii_base").alias("more")).where("size(more) > 0").collect()}
    failing = {i for i, t in rows[:400] if i % 2 == 0 and not brute_spans(t)}
    assert len(failing) > 150 and not failing & set(more) and [s["kind"] for s in more.pop(5000)] == [0] and not more


def test_rewritten_spans_are_where_they_are_said_to_be(spark):
    text = "é a.b@c.de x +1 (956) 555-0122, 4207051279108084 y 1.2.3.4"
    df = spark.range(4).select(personal_data.rewritten(F.lit(text), personal_data.base_spans(F.lit(text)), F.col("id").cast("int")).alias("r"))
    want = [["a.b (at) c (dot) de", "1 (956) 555-0122"], ["a.b at c dot de", "1 (956) 555-0122"], ["a.b[at]c.de", "1 (956) 555-0122"], ["a.b @ c.de", "1 (956) 555-0122"]]
    for r, w in zip(df.collect(), want, strict=True):
        shown = [r["r"]["text"][s["start"] : s["end"]] for s in r["r"]["spans"]]
        assert shown[:2] == w and shown[2][:-1] == "420705127910808" and shown[3] == "1.2.3.4"


def test_redaction(spark):
    df = spark.createDataFrame([("x a@b.c y 1.2.3.4 z",), ("é",)], "text string")
    none = personal_data.Model((boosting.Model(0.0, ()),) * 4, (None,) * 4)
    out = personal_data.find(df, "text", none)
    assert [r[0] for r in out.select(personal_data.redacted(F.col("text"), F.col("pii_spans"))).collect()] == ["x [EMAIL] y [IP] z", "é"]


def test_boosting_learns_an_interaction(spark):
    cells = [((a, b), 100, 90 if a and b else 10) for a in (0, 1) for b in (0, 1)] + [((2, 0), 50, 0)]
    m = boosting.fit(cells)
    assert m.probability((1, 1)) > 0.8 > 0.3 > m.probability((0, 1))
    row = spark.range(1).select(m.log_odds([F.lit(1), F.lit(1)]).alias("x")).first()
    assert abs(1 / (1 + np.exp(-row["x"])) - m.probability((1, 1))) < 1e-9


# 8


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    parts = ["▁", " ", "  ", "the", " a", "\n", "e", "é", "x", "日", "\u0000", "<s>", "in", "er", " " * 7, "ing", "1", "\t", "😀", "ñ", "tion", "http", "://"]
    rows = [(i, "".join(R.choice(parts) for _ in range(R.randrange(25)))) for i in range(1500)] + [(9001, None), (9002, ""), (9003, " " * 500 + "a"), (9004, "a" * 3000), (9005, prose(20_000))]
    got = sentencepiece_codec.encode_decode(frame(spark, rows), "text", tokenizer_path(), keep=("doc_id", "h")).collect()
    for r in got:
        t = dict(rows)[r["doc_id"]] or ""
        assert r["piece_ids"] == model.encode(t) and r["piece_text"] == model.decode(model.encode(t))
    ids = [[R.randrange(3, 32000) if R.random() < 0.6 else R.randrange(3, 259) for _ in range(R.randrange(12))] for _ in range(500)]
    out = sentencepiece_codec.decode(spark.createDataFrame([(x,) for x in ids], "ids array<int>"), "ids", tokenizer_path()).collect()
    assert [r["piece_text"] for r in out] == [model.decode(x) for x in ids]


# 9


def test_language_id(spark):
    own = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàùç"}
    rows = [(i, " ".join("".join(R.choice(own[lang]) for _ in range(5)) for _ in range(12)), lang) for i, lang in enumerate(R.choice(list(own)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 ...", "bb"), (1003, "日本" * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.predict(df, "text", language_id.fit(df.where(language_id.learnt(F.col("doc_id"))), "text", "lang", "doc_id"), ("doc_id",)).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1 for i, _, lang in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in own
    assert {r["lang_pred"] for r in language_id.predict(df, "text", language_id.fit(df.limit(0), "text", "lang", "doc_id"), ("doc_id",)).collect()} == {"und"}


# 10


def test_decontamination(spark):
    question = "A train leaves London at 3 pm and travels 240 km to Paris in 3 hours. How fast does it go on its way?"
    items = spark.createDataFrame([(1, question), (2, "What is two plus two?"), (3, None), (4, "short one"), (5, "one two three"), (6, "")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = [
        (1, "Well now. A train leaves Berlin at 5 pm and travels 400 miles to Rome in 5 hours. How fast does it go on its way? ok"), (2, question), (3, question.replace("Paris", "London").replace("in 3", "in 7")), (4, None), (5, ""),
        (6, "one two three"), (7, "what is two plus two"), (8, prose(9000) + " " + question + " " + prose(50)), (9, "1.1" * 3000), (10, prose(300)), (None, question),
    ]
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (8, 1): False, (7, 2): False, (6, 5): False}
    wide = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, rows), items, most_broadcast=0).collect()}
    assert wide == set(got)
    assert decontamination.contaminated(frame(spark, rows), items.limit(0)).count() == 0


def test_decontamination_in_any_case_and_with_any_names(spark):
    train = "A train leaves London at 3 pm and travels 240 km to Paris in 3 hours. How fast does it go on its way?"
    apples = "Alice has 3 apples. Bob gives Alice 5 apples. How many apples does Alice have in total?"
    titled = "Why Do Alice and Bob Love Carol More than Dan Eve Frank Grace"
    items = spark.createDataFrame([(1, train), (2, apples), (3, titled)], "item_id long, text string")
    other = apples.replace("Alice", "Carol").replace("Bob", "Dan")
    rows = [
        (1, train.lower()), (2, train.upper()), (3, apples.lower()), (4, apples.upper()), (5, other), (6, other.lower()), (7, other.upper()), (8, "So. " + other + " ok"), (9, prose(40) + " " + other.lower()),
        (10, titled.lower()), (11, titled.replace("Alice", "Zoe")), (12, prose(60)), (13, apples.replace("Bob", "Alice")), (14, apples.replace("Alice", "Bob", 1)),
        (15, "apples are cheap and how many apples does a shop have in total nobody knows"), (16, " ".join(w.title() for w in WORDS[:40])), (17, "Max has 3 pears. Eve takes Max 5 plums. How many pears can Max keep in stock?"),
    ]
    want = {(1, 1): False, (2, 1): False, (3, 2): False, (4, 2): False, (5, 2): True, (6, 2): True, (7, 2): True, (8, 2): True, (9, 2): True, (10, 3): False, (11, 3): True, (14, 2): False}
    for most in (2_000_000, 0):
        got = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontamination.contaminated(frame(spark, rows), items, most_broadcast=most).collect()}
        assert got == want


def test_text_buffer_of_a_slice():
    from tideline.llm.common import text_buffer

    data, offsets = text_buffer(pa.array(["ab", None, "é", "x"]).slice(1, 3))
    assert data.tobytes() == "éx".encode() and offsets.tolist() == [0, 0, 2, 3]


# Tables without a row


def test_tables_without_a_row(spark):
    labelled = frame(spark, [(n, prose(20)) for n in range(60)])
    nothing = labelled.limit(0)
    model = language_id.fit(labelled, "text", "lang", "doc_id")
    assert language_id.predict(nothing, "text", model, keep=("doc_id",)).count() == 0
    assert sentencepiece_codec.encode_decode(nothing, "text", tokenizer_path(), keep=("doc_id",)).count() == 0
    items = spark.createDataFrame([(1, "how many apples does ann have left after giving seven of them away")], "item_id long, text string")
    assert decontamination.contaminated(nothing, items).count() == 0 and decontamination.contaminated(labelled, items.limit(0)).count() == 0


def test_language_of_a_very_long_text(spark):
    rows = [(n, "der die das und nicht ein haus", "de") if n % 2 else (n, "the and of not one house", "en") for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, "text", "lang", "doc_id")
    asked = spark.createDataFrame([(1, "the house and not one of " * 100_000), (2, "das haus und nicht ein " * 100_000), (3, "12 " * 100_000), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(asked, "text", model, keep=("doc_id",)).collect()}
    assert got == {1: "en", 2: "de", 3: "und", None: "und"}


def test_a_null_id_is_no_neighbour(spark):
    rows = [(n if n else None, [R.gauss(0, 1) for _ in range(8)]) for n in range(120)]
    got = cross_polytope.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    rows = got.collect()
    assert {r["query_id"] for r in rows} == {100} and len(rows) == 10 and all(r["vec_id"] is not None for r in rows)
