"""Phrases, packing and the prefix trie against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import collocations, packing, prefix_trie, sketches
from tideline.llm.common import text_buffer

CLASHING = ("lang", "phrase", "n", "part", "word", "words", "k", "first", "rest", "salt", "place")


# Phrases


def brute_collocations(rows, least=30, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", (text or "").translate({i: i + 32 for i in range(65, 91)})
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if 2 <= len(p) <= 4 and a >= least}
        kept = []
        for p, a in found.items():
            cuts = [(2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def drawn_texts(n=120):
    r = random.Random(3)
    words = [f"w{i}" for i in range(25)] + ["Été", "ÉTÉ", "\x1cz", "ß"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(r.randrange(0, 60))), r.choice(["en", "en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("fixed phrase here " * 40, "en"), ("fixed phrase here " * 40, "en"), ("ab " * 30000, "de"), ("x" * 3000, "fr")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    rows = drawn_texts()
    if small:  # containers burst, subtrees leave, texts are cut
        monkeypatch.setattr(collocations, "STEP", 200)
        monkeypatch.setattr(collocations, "SHARE", 500)
        monkeypatch.setattr(collocations, "RANKED", 5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    for c in CLASHING[1:]:
        docs = docs.withColumn(c, F.lit("x"))
    got = collocations.collocations(docs, least=5, top=40)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 5, 40)
    assert collocations.collocations(docs.where("lang = 'none'"), least=5).count() == 0


def test_trie_bursts_and_spills_without_loss():
    r = np.random.default_rng(5)
    trie, want, runs = collocations.HatTrie(burst=50), Counter(), Counter()
    for _ in range(30):
        keys = (r.integers(1, 9, 400).astype(np.uint64) << np.uint64(32)) | r.integers(1, 60, 400).astype(np.uint64)
        want.update(keys.tolist())
        trie.add(keys)
        if len(trie) > 300:
            for k, n in trie.spilled(100):
                assert (np.diff(k.astype(object)) > 0).all()
                runs.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
            assert len(trie) <= 100
    assert len(trie.parts) > 8
    for k, n in trie.spilled(0):
        runs.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert runs == want and len(trie) == 0


def test_a_task_that_spills_counts_alike():
    text = " ".join(random.Random(1).choices([f"w{i}" for i in range(40)], k=4000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, text[:900]]), pa.array(["en", "en"])], ["text", "lang"])
    full = np.full((sketches.ROWS, 1 << 16), 1, np.uint8)
    sieve = type("S", (), {"value": full})()

    def phrases(held):
        out = Counter()
        for run in collocations.counts(3, [sieve, sieve], 4, iter([batch]), held):
            for x, c in zip(run["phrases"], run["counts"], strict=True):
                x = x.as_py()
                n, size = (int.from_bytes(x[a : a + 8], "little") for a in (0, 8))
                names = pa.decompress(x[16:], size, "zstd", asbytes=True).split(b"\n")[:-1]
                out.update(dict(zip(names, np.frombuffer(pa.decompress(c.as_py(), 8 * n, "zstd"), np.int64).tolist(), strict=True)))
        return out

    assert phrases(10) == phrases(10**9)


def test_slices_lose_nothing():
    for text in (b"", b"a" * 50, b"ab cd.ef " * 20, b"a b" + b"c" * 40 + b" d"):
        parts = list(collocations.slices(text, 7))
        assert b"".join(parts) == text and all(p == text or p[-1:] in (b" ", b".") for p in parts[:-1])


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


def test_ids_are_the_librarys(tokenizer):
    r = random.Random(8)
    units = [" ", "\n", "a", "é", " b", "9", ".", "'s", "\t", "ß", "ж", "漢", "\xa0", " ", "x ", "  ", "’", "\0", "🎉"]
    texts = ["".join(r.choice(units) for _ in range(r.randrange(14))) for _ in range(4000)]
    texts += ["", None, "x<|endoftext|>y", "\n" * 5, "ab " * 4000, "é" * 60 + " " + "x" * 99, " " * 40]
    own, library = packing.Encoder(tokenizer), Tokenizer.from_str(tokenizer)
    assert own.byte_level
    for _ in range(2):  # anew, and from what is remembered
        ids, at = own.encode(*text_buffer(pa.array(texts, pa.string())), 1)
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        assert got == [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_packing_is_whole_and_unpadded(spark, tokenizer, monkeypatch, size):
    monkeypatch.setattr(packing, "SHARD", size)
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", f"word{i % 7}"]) for _ in range(r.randrange(0, 90))) for i in range(150)] + ["copy of one text"] * 40 + [None, "", "", "long " * 3000]
    docs = spark.createDataFrame([(None if i % 50 == 9 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for c in ("row", "ids", "place", "shard", "cost", "first", "split", "n_tokens"):
        docs = docs.withColumn(c, F.lit("x"))
    rows = [x.asDict() for x in packing.packed(docs, tokenizer, window=256).collect()]
    library = Tokenizer.from_str(tokenizer)
    want = Counter((None if i % 50 == 9 else i // 2, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in enumerate(texts) for ids in [library.encode(t or "", add_special_tokens=False).ids + [1]])
    by = defaultdict(list)
    for x in rows:
        assert len(x["ids"]) == 4 * x["length"] > 0
        by[x["sequence_id"]].append(x)
    for own in by.values():
        own.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in own] == [sum(y["length"] for y in own[:i]) for i in range(len(own))]
        n = sum(x["length"] for x in own)
        assert n <= 256 and n & (n - 1) == 0
    # Pieces join to whole documents again: a document goes on where the sequence before ended
    got, open_ = Counter(), {}
    for s in sorted(by):
        for x in by[s]:
            shard = s >> 32
            so_far = open_.pop(shard, b"") if x["start"] else b""
            assert len(so_far) == 4 * x["start"]
            so_far += x["ids"]
            if len(so_far) == 4 * x["doc_tokens"]:
                got[(x["doc_id"], x["doc_tokens"], zlib.crc32(so_far))] += 1
            else:
                open_[shard] = so_far
    assert got == want and not open_
    assert packing.packed(docs.where("text = 'none'"), tokenizer).count() == 0


def test_seeds_get_their_nearest_documents():
    index_words = [["a", "b", "c"], ["x", "y"], ["a", "b", "d"], ["x", "z"], ["q"]]
    code = {w: i + 1 for i, w in enumerate("abcdxyzq")}
    of = np.array([i for i, ws in enumerate(index_words) for _ in ws])
    index = packing.Index(np.array([code[w] for ws in index_words for w in ws], np.uint64), of, 5)
    used = np.zeros(5, bool)
    used[0] = True
    assert index.nearest(0, used).tolist() == [2] and index.nearest(3, used).tolist()[0] in (1, 3) and index.nearest(4, used).tolist() == []
    order, _ = packing.filled(np.array([4, 4, 4, 4, 4]), index, 8)
    assert order.tolist() == [0, 2, 1, 3, 4]


# The prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    )


@pytest.mark.parametrize("small", [False, True])
def test_prefix_trie(spark, monkeypatch, small):
    if small:  # segments of few turns, a full sketch, ids in many lists
        monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
        monkeypatch.setattr(prefix_trie, "LISTED", 1)
        monkeypatch.setattr(sketches, "cells_for", lambda n: 64)
        monkeypatch.setattr(sketches, "BLOCK", 64)
    r = random.Random(6)
    rows = []
    for c in range(90):
        base = [("user", "hi"), ("bot", "hello"), (None, "ü" * 5), ("user", None)]
        own = base[: r.randrange(5)] + [(r.choice(["user", "bot"]), r.choice("ab")) for _ in range(r.randrange(12))]
        rows += [(c, r.choice([None, i]) if r.random() < 0.1 else i, *t) for i, t in enumerate(own)]
    rows += [(200, i, "user", "same") for i in range(40)] + [(201, i, "user", "same") for i in range(40)] + [(None, 1, "user", "lost")] + rows[:7]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("part", "place", "base", "depth", "digest", "kind", "n", "rep"):
        conversations = conversations.withColumn(c, F.lit("x"))
    got = prefix_trie.trie(prefix_trie.forked(prefix_trie.ordered(conversations)))
    assert sorted(tuple(-1 if v is None else v for v in x) for x in got.collect()) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.forked(prefix_trie.ordered(none))).count() == 0


def test_sketch_never_counts_too_few(spark):
    values = np.random.default_rng(1).integers(0, 1 << 62, 3000)
    df = spark.createDataFrame([(int(v),) for v in np.concatenate([values, values[:700]])], "h long")
    sketch = sketches.gathered(df, lambda b: np.asarray(b.column(0)).astype(np.uint64), 1 << 16, 2)
    est = sketches.estimate(sketch, values.astype(np.uint64))
    assert (est[:700] == 2).all() and (est >= 1).all() and (est[700:] == 1).mean() > 0.99
