"""Awkward documents shared by the tests of this folder."""

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, fp string, kept string"
WORDS = "the quick brown fox jumps over a lazy dog while many other animals of that wood watch it run far away today".split()


def prose(n: int, shift: int = 0) -> str:
    return " ".join(f"{WORDS[(i + shift) % len(WORDS)]}{(i * 7 + shift) % 13 or ''}" for i in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, and column names that clash."""
    texts = [
        (1, prose(60), "en", "a", 10),
        (2, prose(60), "en", "a", 10),
        (2, prose(60), "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "xx", "b", 4),
        (None, prose(40, 5), "de", "b", 7),
        (None, None, None, None, None),
        (6, prose(30000, 3), "en", "c", 9),
        (7, "word", "en", "c", 4),
        (8, "Ünïcödé 日本語 \U0001f600 a@b.co " + prose(30, 9), "fr", "a", 9),
        (9, "x" * 50000, "en", "a", 9),
        (10, "same line\nsame line\n\nsame line\n" + prose(25, 2), "es", None, 9),
    ]
    return [(*t, "s", "t", "f", "k") for t in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


def from_folder(spark, name: str, folder: str = "/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/{name}.parquet")
