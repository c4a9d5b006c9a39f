"""Small tables with the cases that every operator must handle, and brute-force helpers."""

import re

from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
        # names that the operators use inside
        T.StructField("_same", T.StringType()),
        T.StructField("_key", T.StringType()),
        T.StructField("tokens", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("_row", T.StringType()),
    ]
)


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed, with a line break now and then."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join(chr(97 + (x >> s) % 26) for s in (3, 8, 13, 18)[: 2 + x % 3]) + ("\n" if k % 17 == 16 else " "))
    return "".join(out).strip()


def rows() -> list[tuple]:
    a, b = prose(1, 150), prose(2, 200)
    near = b.replace(b.split()[60], "changedword", 1)
    found = [
        (1, a, "en", "src1"),
        (2, a, "en", "src1"),  # a copy
        (3, b, "en", "src2"),
        (4, near, "en", "src2"),  # a near copy
        (5, None, "en", "src1"),
        (6, "", "de", None),
        (7, " \t\n ", None, "src3"),
        (8, "word", "en", "src1"),
        (9, "12 34 %% !!", "en", "src1"),
        (10, prose(3, 4000), "de", "src1"),  # long
        (10, prose(3, 4000), "de", "src1"),  # the row again
        (11, "same words here " * 60, "en", "src9"),
        (12, "Der Hund läuft über die große Straße.\n" * 3, "de", "src4"),
        (None, b, "en", "src2"),
        (13, prose(4, 60) + "\n" + a[:500] + "\n" + prose(5, 60), "en", "src1"),  # a passage of another
    ]
    return [(i, t, lang, s, len(t or ""), "x", "y", "z", "w", "v") for i, t, lang, s in found]


def docs(spark, chosen=None):
    return spark.createDataFrame(rows() if chosen is None else chosen, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
