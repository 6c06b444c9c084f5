"""Small tables with nulls, empty and long texts, repeated rows and clashing names."""

LONG = "word " * 30000 + "end"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, component string, keys string, `row` string, `a.b` string, k string"
ROWS = [(1, "one two three four five six seven."), (1, "one two three four five six seven."), (2, None), (3, ""), (4, " \n\t "), (None, "no id here at all, none."), (None, None), (5, "ONE two\tthree four  five six seven."), (6, LONG), (7, LONG + " x"), (8, "x"), (9, "é中😀 ▁   z")]


def docs(spark, rows=None):
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", None, "c", "c", "c", "r", "ab", "k") for i, t in (ROWS if rows is None else rows)], SCHEMA)
