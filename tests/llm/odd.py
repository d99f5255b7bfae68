"""Small tables with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

from plumbline.sources.state import small_table

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, own bigint, mark string, "
    "key int, size int, `a.b` string, component_id bigint")
LONG = " ".join(f"word{i % 977} and line{i % 31}" + ("\n" if i % 40 == 0 else "") for i in range(30_000))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, None, 7, "m", 1, 2, "x", 9)


ROWS = [
    row(1, "The same text stands here twice, and that is what the test is about."),
    row(2, "The same text stands here twice, and that is what the test is about."),
    row(2, "The same text stands here twice, and that is what the test is about."),
    row(3, None), row(4, ""), row(5, "   \n\t "), row(6, "one"), row(7, "two words"),
    row(None, "A text without an id.\nIt has two lines."), row(None, None, None, None), row(8, "Source is null.", "de", None),
    row(9, LONG), row(10, LONG.upper(), None, "t"), row(11, "x" * 5000, "en", "t"), row(12, "émile €uro 😀 – ünï", "fr", "t"),
    row(13, "A text without an id.\nIt has two lines."), row(13, "Another text with the same id.", "en", "t"),
]


def odd_docs(spark, rows=ROWS):
    return small_table(spark, rows, SCHEMA).repartition(3)


def documents(spark, texts, **columns):
    """Documents with ids from 0 and the given texts."""
    lang = columns.get("lang", ["en"] * len(texts))
    source = columns.get("source", ["s"] * len(texts))
    return small_table(spark, [(i, t, lang[i], source[i], len(t or "")) for i, t in enumerate(texts)],
                       "doc_id bigint, text string, lang string, source string, n_chars bigint")
