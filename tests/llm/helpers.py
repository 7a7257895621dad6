"""Small inputs for the training-data operators."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# extra columns whose names clash with the operators' own
CLASH = ["k", "h", "kept", "size", "row", "text_sha256", "node", "label", "n_words", "target", "id",
         "copies", "spans", "t", "w", "n", "bucket", "band", "source_size", "start", "end"]


def prose(rnd: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join("w%d" % int(rnd.paretovariate(0.8) * 3 % vocab) for _ in range(n))


def hard_texts(seed: int = 7) -> list:
    """Nulls, empties, white space only, very short and long texts, copies, near copies, shared
    passages, repeats inside a text, non-ASCII and odd white space."""
    rnd = random.Random(seed)
    base = prose(rnd, 300, 5000)
    passage = prose(rnd, 60, 9000)
    out = [None, "", " \t\n", "one", "two words", "a b c d", "a b c d", "a  b\tc\nd", base, base,
           base.replace(" ", "\n"), "x " * 400, "x " * 400 + "y", "  nbsp stays\x0b\x0cword\x1cword",
           "Été ß ΣΣ \U0001F600 字" * 5, base + " tail", passage + " " + prose(rnd, 50),
           prose(rnd, 40) + " " + passage, passage + " " + passage, prose(rnd, 20000, 3000)]
    words = base.split()
    for cut in (3, 150, 290):
        out.append(" ".join(words[:cut] + ["edit%d" % cut] + words[cut + 1:]))
    out.append(" ".join(words[:200] + prose(rnd, 100, 5000).split()))
    out += ["line one here\nline one here\n\nline two\n", "# $ % & | < > *", "<|endoftext|> it's They'LL <|startoftext|>"]
    out += [prose(rnd, rnd.randint(1, 120)) for _ in range(20)]
    return out


def documents(spark, texts=None, clash: bool = False):
    """Rows with ids in mixed order, a null id, a null source, one row twice."""
    texts = hard_texts() if texts is None else texts
    rows = [(i * 7 % 101 + 100 * (i // 101), t, None if i % 9 == 0 else "en",
             None if i % 11 == 0 else "s%d" % (i % 3), None) for i, t in enumerate(texts)]
    if len(rows) > 12:
        rows.append(rows[9])
        rows.append((None, "null id text " * 20, None, "s1", None))
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        for c in CLASH:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df, cols) -> list:
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=key)
