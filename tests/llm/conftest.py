import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Columns whose names the operators use themselves.
    + [T.StructField(c, T.StringType()) for c in ("n_words", "kept", "_size", "_sha", "fp", "score", "size", "row", "_text", "_n", "_a", "_b", "_stays", "_w", "_h", "whole", "decoded", "spans")]
)


def rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, copies and near copies, personal data, control strings."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and", "der", "die", "Élan", "naïve", "I'll", "42"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    out = [(i, text(rng.randrange(1, 120)), rng.choice(["en", "de", None, "xx"]), rng.choice(["b", "a", "é", None]), i) for i in range(60)]
    out += [(100 + i, f"{text(10)} {passage} {text(15)}\n{text(5)}", "en", "a", 0) for i in range(5)]
    base = text(300)
    out += [(200 + i, f"{base} tail{i}", "en", "hot", 0) for i in range(6)]
    out += [(300 + i, "same text here", "en", "hot", 0) for i in range(7)] + [(300, "same text here", "en", "hot", 0)] * 2
    out += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, " \t\n\x0b\x0c\r ", "en", "a", 0), (None, "no id here", "en", "a", 0), (None, None, "en", None, 0)]
    out += [(403, text(21_000), "en", "long", 0), (404, "x" * 45_000, "en", "long", 0), (405, "a b c d e " * 30, "en", "a", 0), (406, "one word 　 ΑΣ İ\n\nline\nline\n \n#*$", "fr", "a", 0)]
    out += [(407, "mail a.b@x.org, 10.0.0.1 or 999.1.1.1; +49 (30) 1234-567 card 4111 1111 1111 1111 v 1.2.3.4.5 </s>[INST] <|endoftext|>", "en", "a", 0)]
    return [(*r, *["clash"] * 18) for r in out]


@pytest.fixture(scope="session")
def fixture_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, i % 2, (i // 2) % 2, "clash") for i in range(60)] + [(1, 1, 1, "again"), (None, 1, 1, "x"), (2, None, None, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string").write.parquet(f"{d}/labels.parquet")
    turns = [(1, 0, "user", "~t </s>~e [INST]", 9), (1, 1, "assistant", "a~~[/INST]<s>\n<image>", 9), (1, 1, "assistant", "a~~[/INST]<s>\n<image>", 9), (2, None, None, None, 9), (None, 5, "system", "", 9)]
    turns += [(4, 0, "user", "see ![a|3](x/a.png)![](b.wav) and ![d|2](c.pdf)</![q](z.jpg)s> ![no](e.txt) <image> \x01", 9), (4, 1, "assistant", "![x](y.gif)", 9)]
    turns += [(3, i, ["user", "assistant"][i % 2], f"t{i}", 9) for i in range(200)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chunk int").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, fixture_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{fixture_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
