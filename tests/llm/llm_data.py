"""Small corpora with copies, shared passages and odd rows."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
VOCABULARY = [
    a + b for a in ("ta", "lo", "mi", "ne", "été", "su", "ka", "Ro") for b in ("r", "n", "la", "so", "bi", "do")
]


def prose(rng, n):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "".join(w + (".\n" if rng.random() < 0.1 else " ") for w in words).strip()


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + "x"
    return " ".join(words)


def corpus(seed=1, n=60):
    """Texts of all lengths with exact and near copies, shared passages and odd cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 30, 80, 150])) for _ in range(n)]
    passage = prose(rng, 30)
    for i in range(0, n, 5):
        texts.append(edited(rng, texts[i], 1 + i % 3))
        texts.append(texts[i])
    base = prose(rng, 100)
    texts += [edited(rng, base, k % 5) for k in range(20)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 10)}" for _ in range(6)]
    texts += [None, "", " \t\n", "x", "a" * 5000, "tar " * 3000, "\x0b\x0c", "é b", "TAR tar Tar lon nen"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[i], t, "en" if i % 3 else "fr", f"s{i % 2}", None) for i, t in enumerate(texts)]
