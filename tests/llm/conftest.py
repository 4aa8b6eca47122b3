from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators' plans use themselves.
EXTRA = """kept _row band k a b key version left_text k1 k2 place anchor range more n lo hi runs salt first_id root
    set_key text_key sig least component_id n_shingles hub member group_size text_sha256 keep_id _chars _maybe slot
    copy fingerprint fold feature class grade p_toxic score x length start offset ids sequence_id doc_tokens""".split()
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in EXTRA),
    ]
)
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(9000))
PASSAGE = " ".join(f"shared passage number {i}" for i in range(30))
TEXTS = [
    (3, None), (4, ""), (5, "  \n "), (6, "one two"), (7, "one\ttwo"), (8, "One TWO"), (9, LONG), (10, LONG),
    (11, LONG + " tail"), (12, PASSAGE), (13, "before " + PASSAGE + " after"), (14, "Éé ß 日本 😀 ́ ▁x"),
    (15, "a" * 900), (16, "ab" * 500), (17, "b" + "ab" * 500), (21, "same same same same same same"), (21, "same same same same same same"),
    (22, "x  y   z\n\n\nend  "), (23, " lead\r\n\ttab\x0b\x0c end\n\n"),
]


def rows(texts):
    return [(i, t, None, "src0", None, *EXTRA) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, repeated and unusual texts, with extra columns."""
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
