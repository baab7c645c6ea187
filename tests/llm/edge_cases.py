"""Rows that operators must survive, shared by the tests."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(seed: int, n: int) -> str:
    """n words of a small, skewed vocabulary."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % 97 * ((x >> 20) % 5)}")
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, copies, near copies,
    repeated rows, null and repeated ids, many sources."""
    base = words(1, 200)
    near = base.replace("w8 ", "x8 ", 1)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base.replace(" ", "\n"), "en", "b", None),
        (4, near, None, "b", 1), (5, near + " tail", "en", None, 1), (6, "", "en", "a", 0), (7, None, "en", "a", None),
        (8, " \t\x0b\x0c\r\n", "en", "c", 6), (None, base, "en", "c", 1), (None, None, None, None, None),
        (9, words(2, 30_000), "de", "a", 1), (10, "one", "en", "c", 3), (11, "One", "en", "c", 3), (12, "one two", "en", "b", 1),
        (13, "Ünïcode ÄÖ ß <|endoftext|> 中文 \U0001f600\u00a0x", "de", "b", 1), (13, "other text of the same id", "en", "b", 1),
    ]
    rows += [(20, words(3, 60), "en", "a", 1)] * 3
    rows += [(100 + i, words(50 + i, 5 + 3 * (i % 17)), "en", "abc"[i % 3] if i % 7 else "a", i) for i in range(60)]
    return rows
