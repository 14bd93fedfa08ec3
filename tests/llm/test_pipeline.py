"""The pipeline's rows against the same decisions made by hand on a small corpus."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline

from tideline.llm.queries import tokenizer_path

R = random.Random(11)
LETTERS = {"aa": "abcdefgh", "bb": "rstuvwxy"}


def text(lang: str, n: int) -> list[str]:
    return ["".join(R.choice(LETTERS[lang]) for _ in range(R.randrange(2, 8))) for _ in range(n)]


def test_run(spark, tmp_path):
    import sentencepiece

    item = text("aa", 30)
    docs = {i: " ".join(text(R.choice(list(LETTERS)), 60)) for i in range(60)}
    near = text("aa", 200)
    docs[70], docs[71], docs[72] = " ".join(near), " ".join(near[:100] + ["other"] + near[101:]), " ".join(near)
    docs[73] = " ".join(text("aa", 20) + item + text("aa", 20))
    docs[74] = " ".join(text("bb", 20)) + " write to ab.c@mail.example.com or 10.1.2.3 now"
    docs[75], docs[76], docs[77] = None, "123 456", ""
    rows = [(i, t, next((k for k, v in LETTERS.items() if t and t[0] in v), None), "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = {}
    for i, t in docs.items():
        if i in (71, 72, 73, 75, 76, 77):
            continue
        t = re.sub(r"10\.1\.2\.3", "[IP]", re.sub(r"[a-z.]+@[a-z.]+", "[EMAIL]", t))
        ids = model.encode(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]
