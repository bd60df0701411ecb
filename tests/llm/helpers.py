"""Small tables with every awkward row."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang, source]). With `extra`, columns whose names the operators use inside."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "_tie", "_part", "score", "label", "fp", "shard", "word", "piece", "block", "_text", "held_out"):
            df = df.withColumn(name, F.lit("clash"))
    return df


LONG = " ".join(f"w{i % 977}" for i in range(30000))
AWKWARD = [
    (None, "a row without an id", None, None),
    (1, None, "en", None),
    (2, "", None, "s"),
    (3, "   \n\t ", "en", "s"),
    (4, "same words in the same order here", "en", "s"),
    (4, "same words in the same order here", "en", "s"),
    (5, "same words in the same order here", "en", "t"),
    (6, "1234 5678 !!! ???", "en", "t"),
    (7, LONG, "en", "t"),
    (8, "Ünïcode wörds 漢字 \U0001f600 ñ", "de", "é"),
    (9, "one", "en", "s"),
]
