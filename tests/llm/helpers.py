import random

SCHEMA = "doc_id long, text string, source string, n_words string, key string, kept string, shard int"


def rows(n=60, seed=3):
    """Documents with copies, near copies, shared passages, nulls, empty and odd texts; clashing extra columns."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "ro", "éa", "ß", "日本"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([1, 2, 5, 40, 120, 300]))]
        if i % 7 == 3:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        text = " ".join(words)
        if i % 9 == 4 and out:
            text = rng.choice(out)[1]
        if i % 9 == 5 and out:
            text = (out[-2][1] or "") + " tail"
        out.append((i, text, rng.choice(["a", "b", "c", None]), "x", "y", "z", 5))
    out += [(n, None, "a", None, None, None, None), (n + 1, "", None, None, None, None, None), (n + 2, " \n\t ", "b", None, None, None, None), (n + 3, "a" * 3000, "c", None, None, None, None), (n + 4, "one", "c", None, None, None, None)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)
