"""Small tables for the corpus tests."""

#: Columns whose names clash with those of results and of steps in between.
EXTRA = "kept string, keep_id string, copy string, shard string, component_id string, score string, key string, ids string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def frame(spark, rows, partitions=3):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    data = [(*r[:4], len(r[1] or ""), *["x"] * 8) for r in full]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
EDGES = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, LONG),
    (6, LONG),
    (7, "Same text here, word for word, in two rows."),
    (7, "Same text here, word for word, in two rows."),
    (8, "Same text here, word for word, in two rows."),
    (None, "no id"),
    (None, None),
    (9, "Ärger ÖL straße x y ﬁ é Σας 中文 😀", None, None),
    (10, "a\nb\n\nc\n", "de", None),
]
