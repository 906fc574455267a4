"""Small document tables and plain versions of what the operators compute."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """A documents table from (id, text[, source]); with `extra`, columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"s{i % 3}", len(r[1] or "")) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("slot", "kept", "component_id", "batch", "part", "k1", "tie", "bucket", "n_tokens", "label", "evidence", "shard", "h"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Texts with exact copies, near copies at several distances, chains, nulls, blanks and a very long one."""
    rows, k = [], 0

    def add(text, source=None):
        nonlocal k
        rows.append((k, text, *([source] if source else [])))
        k += 1

    for s in range(12):
        add(prose(s, 60 + 7 * s))
    for s in range(4):
        base = prose(100 + s, 150)
        add(base)
        add(base)
        for c in range(12):
            add(edited(base, 1000 * s + c, c % 7))
    step = prose(7, 120)
    for c in range(8):
        step = edited(step, c, 2)
        add(step)
    for text in (None, "", "   \t\n", "one", "one", "ONE", "two words", "a b c d", "A B  C\nD", "é ü ß 漢字 🙂 words here", prose(55, 30_000), "x" * 50_000):
        add(text)
    return rows
