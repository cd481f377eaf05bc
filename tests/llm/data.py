"""Small tables for the operators, and the awkward rows that all must bear."""

import random
import re

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, row string, doc long, fp long, n_words long, kept boolean, dropped int, score double, key string"


def awkward(spark):
    """Null and repeated ids, null, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 997} the" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "The quick the quick\nbrown fox", "The quick the quick\nbrown fox", long, "line\n" * 2000, "é ß 漢字 🙂́ +1 (988) 555-2485 a@b.c"]
    rows = [(i, t, "en", None, None, 9, "t", "r", 1, 2, 3, True, 4, 0.5, "k") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "null id", *rows[0][2:]), (None, None, *rows[0][2:]), (3, "other text of a repeated id", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def invented(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
