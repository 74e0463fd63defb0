"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, copies, shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    s = "an ber co da el fi go ha in ju ka lo me no or pa qui re so ta".split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n))


def documents(seed=1, n=60):
    r = random.Random(seed)
    passage = prose(r, 60)
    texts = [None, "", " \n\t ", "one", "four words are here", "ÀÉ été ñ 世界 \U0001f600 ok", "a" * 400, "same same " * 80, "Über ÄÖ ABC abc"]
    base = [prose(r, r.randint(20, 160)) for _ in range(n)]
    texts += base
    texts += base[:6] + [base[0]] * 5
    for b in base[6:16]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    for b in base[16:30]:
        texts.append(b[: len(b) // 2] + " " + passage + " " + b[len(b) // 2 :])
    texts.append(prose(r, 6000))
    texts.append("x\n" * 30 + base[30])
    sources = ["s1", "s2", None, "é", "S0"]
    return [(i, t, "en", sources[i % 5] if i % 3 else "s1", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """``df`` with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for c in ("row", "size", "h", "key", "ord", "n_words", "kept", "block", "made", "plan", "repeats", "token", "words", "copy"):
        df = df.withColumn(c, F.lit("other"))
    return df
