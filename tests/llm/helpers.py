"""A small table of documents with every awkward case, and the test tables' place."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep_id long, a int, key string, n int, x int"

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))


def docs(spark, rows):
    """(doc_id, text, lang) rows with further columns whose names the operators use themselves."""
    full = [(i, t, lang, "s", None if t is None else len(t), "extra", -1, 5, "k", 6, 7) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


BASE = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(60))
AWKWARD = [
    (1, BASE, "en"),
    (2, BASE, "en"),
    (3, BASE.replace("alpha30", "changed"), "en"),
    (4, None, "en"),
    (5, "", None),
    (6, "", "de"),
    (7, "one two three", "en"),
    (8, "ONE, two three!", "en"),
    (9, "  \n\t ", "en"),
    (10, LONG, "en"),
    (11, LONG + " tail", "en"),
    (12, "naïve ½ ⅷ 漢字 😀 ſ İ ² mixed'S it's 'll", None),
    (13, "…!? 12345", "fr"),
    (1, BASE, "en"),
    (None, "row without id", "en"),
]
