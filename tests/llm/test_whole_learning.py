"""Models are learnt from every text, not from a sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import language_id, personal_data
from tideline.llm.common import codepoints, text_buffer


def test_every_labelled_text_counts(spark):
    """Counts of 9,000 texts of a language are those of all, not of a sample."""
    rows = [(i, "ab", "x") for i in range(9000)] + [(9000 + i, "cd", "y") for i in range(9000)]
    base = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    share = np.exp(base.log_probability)
    points, at = language_id.letters(*codepoints(*text_buffer(pa.array(["ab"]))))
    counts = np.full(language_id.BUCKETS, 0.5)
    for _, bucket, times in language_id._counted(points, at):
        counts[bucket] += 9000 * times
    assert np.allclose(share[0], counts / counts.sum(), rtol=1e-5)


def test_personal_data_learns_from_every_text(spark, monkeypatch):
    seen = []
    fitted = personal_data.boosting.fit
    monkeypatch.setattr(personal_data.boosting, "fit", lambda cells: seen.append(cells) or fitted(cells))
    rows = spark.range(30_000).selectExpr("id AS doc_id", "'call +44 20 7946 0018 now' AS text")
    personal_data.fit(rows, "doc_id", "text")
    half = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(41)), F.lit(1_000_000)) % 2 == 0).count()
    assert sum(hits for cells in seen for f, n, hits in cells) == half  # each text's one number, in its copy
