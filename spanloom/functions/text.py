"""Text and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import saved
from .sequences import common_subsequence, edit_distance, edit_similarity  # noqa: F401


def normal(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+|_", " "))


def natural_key(path: Column) -> Column:
    """A key in which numbers inside names sort by value, however long: their length in six digits, then
    their digits without leading zeros."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda p: F.regexp_replace(p, r"^0+(?=.)", "")
    number = lambda p: F.concat(F.lpad(F.length(plain(p)).cast("string"), 6, "0"), plain(p))
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def anchored(left: Column, right: Column, score: Column) -> Column:
    """1 for equal texts, else the score within 0 and 1."""
    return F.when(left == right, 1.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def redacted(text: Column, secret: Column) -> Column:
    return F.replace(text, secret, F.lit("[redacted]"))


def token_f1(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Multiset F1 of the words of two text columns, by counting words, not by loops; null where neither has words."""
    each = F.explode_outer(
        F.concat(
            F.transform(words(F.col(left)), lambda w: F.struct(w.alias("w"), F.lit(1).alias("l"), F.lit(0).alias("r"))),
            F.transform(words(F.col(right)), lambda w: F.struct(w.alias("w"), F.lit(0).alias("l"), F.lit(1).alias("r"))),
        )
    )
    counts = rows.select(*keys, each.alias("e")).groupBy(*keys, "e.w").agg(F.sum("e.l").alias("l"), F.sum("e.r").alias("r"))
    return counts.groupBy(*keys).agg(F.try_divide(2.0 * F.sum(F.least("l", "r")), F.sum(F.col("l") + F.col("r")).cast("double")).alias("f1"))


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, weight): unit-length TF-IDF vectors with smoothed idf ln((1 + N) / (1 + df)) + 1."""
    counts = docs.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    return _weights(counts, docs, key)


def _weights(counts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Unit-length TF-IDF weights of counted terms (key, word, tf)."""
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(df, "word").crossJoin(F.broadcast(n))  # n is one row
    weighed = weighed.withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighed.join(length, key).select(key, "word", (F.col("w") / F.col("length")).alias("weight"))


def char_grams(text: Column, size: int = 4) -> Column:
    """All runs of ``size`` characters of the normal text; a shorter one is one run, an empty one none."""
    plain = normal(text)
    starts = F.sequence(F.lit(1), F.length(plain) - size + 1)
    runs = F.transform(starts, lambda i: F.substring(plain, i, F.lit(size)))
    return F.when(F.length(plain) >= size, runs).when(F.length(plain) > 0, F.array(plain)).otherwise(F.array().cast("array<string>"))


def similar_texts(docs: DataFrame, key: str, text: str, least: float, grams=words) -> DataFrame:
    """(left, right, cosine) with left < right: pairs of keys whose texts' TF-IDF vectors have a cosine of
    ``least`` or more (above 0).  ``grams`` gives a text's terms: ``words`` or ``char_grams``.

    An inverted index over the rarest terms only: in one order of all terms, a vector's terms are listed
    until what remains is shorter than ``least``.  Vectors that first meet in a term beyond either list
    have too little left to reach it (Cauchy-Schwarz), so pairs are formed only in listed terms,
    and each is then scored on its whole vectors.  Texts with equal terms and counts are copies: the one
    with the least key stands for them in all pairs, and each other is paired with it alone, at 1.
    Null and empty texts have no vector and are in no pair; keys are distinct.
    """
    counts = docs.select(key, F.explode(grams(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    weighed = saved(_weights(counts, docs, key), "weights")
    df = weighed.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    vector = F.array_sort(F.collect_list(F.struct("df", "word", "weight")))
    vectors = weighed.join(df, "word").groupBy(key).agg(vector.alias("v"))
    content = F.sha2(F.to_json(F.transform("v", lambda x: F.struct(x["word"], F.round(x["weight"], 12)))), 256)
    vectors = saved(vectors.withColumn("_content", content), "vectors")
    members = vectors.select(key, "_content")
    texts = vectors.groupBy("_content").agg(F.min_by("v", key).alias("v"), F.min(key).alias("_first"))
    # what remains of the squared length before each term; a little slack for rounding
    parts = F.aggregate(
        "v", F.struct(F.lit(1.0).alias("rest"), F.array().cast("array<string>").alias("listed")),
        lambda acc, x: F.struct(
            (acc["rest"] - x["weight"] * x["weight"]).alias("rest"),
            F.when(acc["rest"] >= least * least - 1e-9, F.concat(acc["listed"], F.array(x["word"]))).otherwise(acc["listed"]).alias("listed"),
        ),
    )
    listed = texts.select("_content", F.explode(parts["listed"]).alias("word"))
    left, right = listed.withColumnRenamed("_content", "_l"), listed.withColumnRenamed("_content", "_r")
    pairs = left.join(right, "word").where("_l < _r").select("_l", "_r").distinct()
    entries = lambda side: texts.select(F.col("_content").alias(side), F.map_from_entries(
        F.transform("v", lambda x: F.struct(x["word"], x["weight"]))).alias(f"{side}v"))
    both = pairs.join(entries("_l"), "_l").join(entries("_r"), "_r")
    shared = F.array_intersect(F.map_keys("_lv"), F.map_keys("_rv"))
    cosine = F.aggregate(shared, F.lit(0.0), lambda s, w: s + F.element_at("_lv", w) * F.element_at("_rv", w))
    found = both.select("_l", "_r", cosine.alias("cosine")).where(F.col("cosine") >= least - 1e-12)
    ends = lambda side: texts.select(F.col("_content").alias(side), F.col("_first").alias(f"{side}k"))
    first = found.join(ends("_l"), "_l").join(ends("_r"), "_r")
    first = first.select(F.least("_lk", "_rk").alias("left"), F.greatest("_lk", "_rk").alias("right"), "cosine")
    copies = members.join(texts.select("_content", "_first"), "_content").where(F.col(key) > F.col("_first"))
    return first.unionByName(copies.select(F.col("_first").alias("left"), F.col(key).alias("right"), F.lit(1.0).alias("cosine")))


def citations(text: Column) -> Column:
    """Frame numbers and ranges that a text cites, as [first, last] pairs."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:\s*[-–]\s*\d+)?)"), F.lit(1))
    ends = lambda c: F.split(c, r"\s*[-–]\s*")
    first = lambda c: F.element_at(ends(c), 1).cast("int")
    last = lambda c: F.element_at(ends(c), -1).cast("int")
    return F.transform(found, lambda c: F.struct(first(c).alias("first"), last(c).alias("last")))


INTERVAL = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def complement(spans: Column, length: Column) -> Column:
    """The parts of [0, length) outside sorted disjoint spans (struct start, end)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"].cast("int")))
    ends = F.concat(F.transform(spans, lambda s: s["start"].cast("int")), F.array(length.cast("int")))
    gaps = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return F.filter(gaps, lambda g: g["end"] > g["start"])
