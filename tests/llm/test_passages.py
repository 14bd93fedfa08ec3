"""Passages of over 50 words that another document has too are found whatever their bytes."""

from __future__ import annotations

import collections
import random

import pytest

from tideline.llm import bwt_repeats


def brute(rows, words=51):
    texts = [(i, (t or "").split()) for i, t in rows]
    owners = collections.defaultdict(set)
    for i, w in texts:
        for k in range(len(w) - words + 1):
            owners[tuple(w[k : k + words])].add(i)
    out = []
    for i, w in texts:
        hit = [False] * len(w)
        for k in range(len(w) - words + 1):
            if len(owners[tuple(w[k : k + words])]) > 1:
                hit[k : k + words] = [True] * words
        out.append((i, sum(hit), sum(b and not a for a, b in zip([False, *hit], hit, strict=False))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [bwt_repeats.HOT_BYTES, 3000, 0])
def test_passages_of_words(spark, hot):
    r = random.Random(7)
    prose = lambda n: [r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrst") for _ in range(n)]
    short, exact, under, own = prose(60), prose(51), prose(50), prose(80)
    rows = [(k, " ".join(prose(r.randrange(90)) + short[: 52 + k % 9] + prose(r.randrange(90)))) for k in range(12)]
    rows += [(20 + k, " ".join(prose(40) + p + prose(9) + exact)) for k, p in enumerate([under, under, own + own, prose(70)])]
    rows += [(30, "\n\t".join(short)), (31, None), (32, ""), (33, "of " * 70), (34, "of " * 60), (35, "of " * 50), (36, " ".join(own * 3)), (None, " ".join(prose(60) + under)), (40, rows[0][1] + "é"), (41, "x" * 500 + " ")]
    both = prose(300)
    rows += [(50, " ".join(both + prose(20) + both[30:95] + prose(20) + both[200:290])), (51, " ".join(both))]  # copies of one document's own part, which another has too
    got = bwt_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot_bytes=hot).collect()
    found = {x["doc_id"]: (x["n_removed"], x["n_shared_words"]) for x in got}
    assert found[1][0] == 0 and found[1][1] >= 52  # under 400 bytes, so that nothing is removed
    assert sorted(((x["doc_id"], x["n_shared_words"], x["n_shared_passages"]) for x in got), key=str) == brute(rows)
