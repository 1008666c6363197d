"""Fixtures for the training-data operators: documents with every awkward case."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, __doc string"

LONG = " ".join(f"word{i % 977} Café{i % 31}" for i in range(30000))


def documents(spark, rows):
    """Rows (doc_id, text) as documents with further columns, among them names that the operators use themselves."""
    full = [(d, t, "en", "s", len(t) if t else None, "x", "y") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, "One shared line of text\nown line number one here\n\n  Trailing spaces \t"),
    (2, "one SHARED line of TEXT  \nanother line, only in two"),
    (3, None),
    (4, ""),
    (5, "   \n\t\r\n"),
    (6, "shört\nÉtude sur les lignes répétées\nétude sur les lignes répétées"),
    (7, "Étude sur les lignes répétées"),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "one shared line of text\none shared line of text\nx"),
    (10, "one shared line of text\none shared line of text\nx"),
    (None, "one shared line of text\nnull id line that is long enough"),
    (-5, "null id line that is long enough\nnull id line that is long enough"),
    (11, "Grüße 你好 <|endoftext|> don't 's 123 ½ é   nb em"),
]
