"""Small corpora for the tests: hard cases first, then prose with planted copies."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor. "


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=0, n=60):
    """Documents with exact copies, near copies, shared passages, nulls, empty and long texts, repeated
    rows, null and repeated identifiers."""
    rng = random.Random(seed)
    passage = words(rng, 90)
    out = []
    for i in range(n):
        text = words(rng, rng.choice([3, 20, 80, 200]))
        if i % 7 == 3 and out and out[-1][1]:
            text = out[-1][1]
        elif i % 7 == 5 and out and out[-1][1]:
            parts = out[-1][1].split()
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        elif i % 5 == 2:
            text = words(rng, 30) + "\n" + passage + " é\n" + words(rng, 40)
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, LONG * 40), (n + 4, "é" * 1500), (0, out[0][1]), (5, "another text"),
            (None, words(rng, 60)), (None, None), (n + 5, passage.upper())]
    return [(i, t, rng.choice(["en", "fr", None]), f"src{rng.randrange(3)}", len(t or "")) for i, t in out]


def clashing(df):
    """The same table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("rid", "row", "id", "key", "set", "block", "kept", "size", "shard", "component", "spans", "number", "g"):
        df = df.withColumn(name, F.lit("x"))
    return df
