"""Documents with everything that a corpus may hold, and brute-force helpers."""

import random
import re

#: Columns whose names operators use inside; they must come through untouched or be ignored.
CLASHING = ["a", "b", "th", "key", "cls", "start", "n", "block", "bucket", "row_id", "good", "w", "order", "shard", "n_tokens", "at", "id", "component", "_cuts", "tokens", "weight", "q", "host", "v"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(rng, n, words=400):
    return " ".join(f"word{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    shared, long = prose(rng, 80), prose(rng, 60_000, 5000)
    texts = {
        0: prose(rng, 120), 1: prose(rng, 120), 2: None, 3: "", 4: "   \n\t ", 5: "§ — …", 6: "one", 7: "two words", 8: long, 9: long + " tail",
        10: prose(rng, 30) + " " + shared + " " + prose(rng, 30), 11: shared, 12: prose(rng, 70) + " " + shared, 13: "é日本 ünï \U0001f600 " * 40, 14: "A" * 50_000, 15: "same same " * 500,
    }
    rows = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in texts.items()]
    rows += [rows[0], rows[0], rows[8]]  # repeated rows
    rows += [(0, texts[1], "de", "src1", 3), (None, texts[10], "en", "src0", 1), (None, None, None, None, None), (20, texts[1].upper() + "!", None, None, None)]
    return [r + ("x",) * len(CLASHING) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())


def word_sets(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def labels(spark, rows=None):
    rows = [(0, 1, 0), (1, 1, 0), (1, 1, 0), (10, 1, 0), (11, 0, 0), (12, 0, 1), (15, 0, None), (None, 1, 0), (8, None, 0), (999, 1, 0), (13, 1, 1)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
