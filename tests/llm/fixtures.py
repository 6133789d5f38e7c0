"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, bucket string"
LONG = ("The quick brown fox, number 42, jumps. " * 2500).strip()


def odd_texts() -> list:
    return [
        None, "", " ", "\n\n", "one", "one", "One two three", "a b c d e f g", "A b C d e f G", "\x0b\x0cword\x1cword\x85x",
        "Ünïcode ßtraße 東京 😀 mail me: jo.e+x@mail7.example.com or a@b.c_d@e.f now", "x@y", "a@b.c.d.e-f.g", "..@..", "%@x.y@z.w",
        "ip 97.51.17.173 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.004 and 1.2.3", "1.1.1.1.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 9815432812120 12 34", "+1 (017) 555-7713 rest", "+1 (017) 555 and ++49 30 1234567 x", "0" * 400, "1 " * 500, "a" * 3000,
        'token = "908038b7daaf91e730d2f64001c52934d43d9336" rest', "Lyon, 43.21.141.162 from. Dr. Alice",
        LONG, LONG, LONG + " tail", "line of text number one, long enough\nline of text number two, long enough\n\nshort",
        "line of text number one, long enough\nline of text numbr two, long enough\nshort", "line of text number onne, long enough\nother line that is alone here",
    ]


def documents(spark, texts=None, repeat=True):
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en", ["s1", "s2", None, "s3"][i % 4] if i % 5 else "s1", None if t is None else len(t), 7, "k", -1, "b") for i, t in enumerate(texts)]
    if repeat and rows:
        rows.append(rows[-1])
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pandas(df) -> pd.DataFrame:
    return df.toPandas()
