"""Documents with what texts can hold: nulls, blanks, long texts, copies, repeated rows."""

import random
import re
from itertools import count

WORDS = "the of to and river stone light house green walk über café naïve 日本 tree water cloud".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows (doc_id, text, lang, source, n_chars) with odd texts among ordinary ones."""
    rng = random.Random(seed)
    ids, rows = count(0, 3), []
    texts = [None, "", " \t\n ", "one", "two words", "a\x0bb\x0cc", "é" * 30, "x" * 5000, text_of(rng, 4000), "\n\n", "tail \n"]
    base = [text_of(rng, rng.randrange(20, 200)) for _ in range(n // 3)]
    texts += base + [base[0]] * 5 + base[:4]
    texts += [t + " end" for t in base[4:9]]
    texts += ["\n".join([base[9], base[10], text_of(rng, 12)]), "\n".join([text_of(rng, 12), "  " + base[10].upper().lower() + " "])]
    texts += [text_of(rng, rng.randrange(1, 60)) for _ in range(n // 3)]
    for i, t in enumerate(texts):
        rows.append((next(ids), t, "en", ["a", "b", None, "Z", "c"][min(i % 9, 4)], None if t is None else len(t)))
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
