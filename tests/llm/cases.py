"""Documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, spans string, component long, n int, row string, at int"


def odd_documents(spark):
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, long, "en", "b"), (5, "one two three four", None, "b"), (6, "one two three four", "en", None),
        (6, "one two three four", "en", None), (7, "ONE two\x0bthree  four", "xx", "a"), (None, "no id at all", "en", "c"), (8, "é" * 50 + " ß 漢字 \U0001f600 \x00 end", "de", "c"), (9, "12345 67890 !!!", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, 0, "x", "y", -1, 3, "r", 2) for i, t, la, s in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
