"""Language-model scores by prediction by partial matching over byte contexts.

A text is its words, A-Z in lower case, each with a space behind it but the last, and an end byte (a
line feed, which no word holds), so that words and bytes say the same.  The model is a trie of byte contexts of
up to ``order`` bytes, with counts of the bytes that follow, over all training texts.  A byte's
probability starts at its longest known context.  With T events of D kinds there, a byte that
was seen c times has c / (T + D); any other costs an escape, D / (T + D), and goes on one byte
shorter, with the bytes that the longer context knows excluded from T and D; what no context
knows is uniform over the bytes left.  As a longer context's bytes are among those of the
shorter one, what is excluded is one sum for each context.

So a byte's probability depends only on itself and the ``order`` bytes before it, and is
settled once for each such string of the whole corpus: counts, the trie's nodes and the chains
of escapes are joins and sums over strings, not over texts.  Tasks hand in the distinct strings
and words of a block of 24 to 40 MB of texts; the settled ones come back to the block, where the
texts are scored by array look-ups.  Nothing is broadcast, and nothing of the corpus meets in
one task; a common string has at most one row a block.

Cases: null counts as empty; an empty text is one end; a very long text is a block of its own and
is worked through in pieces; repeated rows are counted and scored each; rows without a doc_id
are scored and count as held out; without training texts every byte is uniform; ties don't
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, shuffle_partitions, text_of, tuples

#: Bytes of context, and of texts in a block and in a piece that is worked on at once.
ORDER, BLOCK, PIECE = 5, 3 << 23, 1 << 20
#: A string of ORDER + 1 bytes and the number of one of so many texts of a piece fit a 64-bit number.
TEXT_BITS = 15
END = b"\n"
#: Bytes that can follow: all but white space, and the space and the end.
SYMBOLS = 256 - 6 + 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of a batch, and texts whose words are looked up at once.
ROWS, TEXTS = 1 << 16, 2048

DIGEST = "block long, gram long, word binary, n long, doc_id long, held_out boolean, body binary"
_DIGEST = pa.schema([
    ("block", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("body", pa.binary()),
])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def normalised(text: str) -> bytes:
    """Words in lower case with a space between them, and the end."""
    return b" ".join(text.encode().translate(_LOWER).split()) + END


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as one number; from the byte at ``order`` on."""
    code, width = data, 1
    while width <= order:
        more = min(width, order + 1 - width)
        kind = np.uint16 if width + more <= 2 else np.uint32 if width + more <= 4 else np.int64
        wide = code.astype(kind)
        tail = wide[more:] if more == width else wide[more:] & kind((1 << 8 * more) - 1)
        code = (wide[:-more] << kind(8 * more)) | tail
        width += more
    return code.astype(np.int64, copy=False)


def coded(bodies: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, place, codes): codes of the bytes of some texts, and of each code the place of its text.

    Between texts stand ``order`` ends as the context of the first bytes; as bytes to predict they
    are coded as 0.  An empty text has the one code of an end after ends.
    """
    pad, blank = END * order, int.from_bytes(END * (order + 1))
    held, size = [], 0

    def together():
        data = np.frombuffer(pad + pad.join(bodies[i] for i in held), np.uint8)
        code = codes(data, order)
        code[(code & 0xFFFF) == 0x0A0A] = 0
        lengths = np.array([len(bodies[i]) for i in held])
        starts = np.cumsum(lengths + order) - lengths - order
        code[starts[lengths == 1]] = blank
        parts = lengths + order
        parts[-1] -= order
        return np.array(held), np.repeat(np.arange(len(held)), parts), code

    for i, body in enumerate(bodies):
        if len(body) > PIECE:
            for at in range(0, len(body), PIECE):
                before = body[at - order : at] if at else pad
                code = codes(np.frombuffer(before + body[at : at + PIECE], np.uint8), order)
                yield np.array([i]), np.zeros(len(code), np.int64), code
            continue
        held.append(i)
        size += len(body) + order
        if size >= PIECE or len(held) >> TEXT_BITS:
            yield together()
            held, size = [], 0
    if held:
        yield together()


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, np.int64), *(k for k, _ in parts)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)])[order]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their counts; those of some 2 MB of texts are sorted at a time."""
    all_, held, size = [], [], 0
    parts = coded(bodies, order)
    while True:
        _, _, code = next(parts, (None, None, None))
        if code is not None:
            held.append(code)
            size += len(code)
        if held and (code is None or size >= 2 * PIECE):
            code_ = np.concatenate(held)
            held.clear()
            code_.sort()
            first = np.flatnonzero(np.r_[True, code_[1:] != code_[:-1]])
            n = np.diff(np.r_[first, len(code_)])
            skip = int(code_[0] == 0)
            all_.append((code_[first[skip:]], n[skip:]))
            if len(all_) > 4:
                all_ = [_added(all_)]
            size = 0
        if code is None:
            return _added(all_)


def words_of(bodies: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The numbers of words of the texts, and all words."""
    lists = pc.split_pattern(pa.array([b[:-1] for b in bodies], pa.binary()), pattern=b" ")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    empty = np.array([len(b) == 1 for b in bodies], bool)
    if empty.any():  # split into one empty word
        words = words.filter(pa.array(np.repeat(~empty, lengths)))
        lengths[empty] = 0
    return lengths, words


def counted_words(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and their counts, some texts at a time."""
    each = [words_of(bodies[at : at + TEXTS])[1].value_counts() for at in range(0, len(bodies), TEXTS)]
    if not each:
        return pa.array([], pa.binary()), np.empty(0, np.int64)
    words = pa.concat_arrays([c.field("values") for c in each]).dictionary_encode()
    counts = np.concatenate([c.field("counts").to_numpy(zero_copy_only=False) for c in each])
    places = words.indices.to_numpy(zero_copy_only=False)
    return words.dictionary, np.bincount(places, counts, len(words.dictionary)).astype(np.int64)


def _digest(docs: DataFrame, order: int, folds: int) -> DataFrame:
    """For each block of texts: its distinct strings and words with their counts in training texts (0: none), and the texts."""

    def rows(size: int, **columns) -> pa.RecordBatch:
        given = {name: c if isinstance(c, pa.Array) else pa.array(c, _DIGEST.field(name).type) for name, c in columns.items()}
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(size, f.type) for f in _DIGEST], schema=_DIGEST)

    def block(number: int, texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        train, rest = ([t[2] for t in texts if t[1] == held] for held in (False, True))
        grams, n = counted(train, order)
        new = np.setdiff1d(counted(rest, order)[0], grams, assume_unique=True)
        grams, n = np.concatenate([grams, new]), np.concatenate([n, np.zeros(len(new), np.int64)])
        for at in range(0, len(grams), ROWS):
            part = slice(at, at + ROWS)
            yield rows(len(grams[part]), block=[number] * len(grams[part]), gram=grams[part], n=n[part])
        seen, n = counted_words(train)
        new = counted_words(rest)[0]
        new = new.filter(pc.invert(pc.is_in(new, seen)))
        words = pa.concat_arrays([seen, new, pa.array([END], pa.binary())])
        n = np.concatenate([n, np.zeros(len(new), np.int64), [len(train)]])
        for at in range(0, len(words), ROWS):
            part = words.slice(at, ROWS)
            yield rows(len(part), block=[number] * len(part), word=part, n=n[at : at + ROWS])
        for at in range(0, len(texts), 1024):
            ids, held, bodies = zip(*texts[at : at + 1024], strict=True)
            yield rows(len(ids), block=[number] * len(ids), doc_id=ids, held_out=held, body=bodies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, number = [], 0, None
        for part, doc_id, text in tuples(batches):
            number = part << 24 if number is None else number
            body = normalised(text)
            texts.append((doc_id, doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0, body))
            size += len(body)
            if size >= BLOCK * 5 // 3:  # a partition of about one block stays whole
                yield from block(number, texts)
                texts, size, number = [], 0, number + 1
        if texts:
            yield from block(number, texts)

    part = F.spark_partition_id().cast("long").alias("part")
    return docs.select(part, F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(work, DIGEST)


def _settled(grams: DataFrame, order: int) -> DataFrame:
    """(gram, value): the log10 probability of the last byte of each string (gram, c) after the others."""
    masks = F.array(*(F.lit((1 << 8 * n) - 1).cast("long") for n in range(order + 2)))
    low = lambda n: masks[n]  # noqa: E731  mask of so many bytes
    level = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("j")
    seen = grams.where("c > 0").select("gram", "c", level).select("j", F.col("gram").bitwiseAND(low(F.col("j") + 1)).alias("code"), "c")
    events = saved(seen.groupBy("j", "code").agg(F.sum("c").alias("c")), "events")
    context = F.shiftright("code", 8).alias("context")
    shorter = events.select((F.col("j") + 1).alias("j"), F.col("code").alias("tail"), F.col("c").alias("below"))
    nodes = events.withColumn("tail", F.col("code").bitwiseAND(low(F.col("j")))).join(shorter, ["j", "tail"], "left")
    nodes = nodes.groupBy("j", context).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("below").alias("x"))
    nodes = saved(nodes, "nodes")

    top = nodes.where(F.col("j") == order).select("context", "t", "d")
    known = grams.where("c > 0").withColumn("context", F.shiftright("gram", 8)).join(top, "context")
    known = known.select("gram", (F.log10("c") - F.log10(F.col("t") + F.col("d"))).alias("value"))

    new = grams.where("c = 0").select("gram", level).withColumn("code", F.col("gram").bitwiseAND(low(F.col("j") + 1))).withColumn("context", F.shiftright("code", 8))
    new = new.join(events, ["j", "code"], "left").join(nodes, ["j", "context"], "left")
    at = lambda name, j: F.max(F.when(F.col("j") == j, F.col(name))).alias(f"{name}{j}")
    steps = new.groupBy("gram").agg(*(at(name, j) for j in range(order + 1) for name in "ctdx"))
    steps = steps.withColumns({"spent": F.lit(0.0), "value": F.lit(None).cast("double")})
    nothing = F.lit(0).cast("long")
    for j in range(order, -1, -1):
        above = j < order  # a context of j + 1 bytes that is known excludes its bytes here
        t, d = (F.col(a) - (F.coalesce(F.col(f"{b}{j + 1}"), nothing) if above else nothing) for a, b in ((f"t{j}", "x"), (f"d{j}", "d")))
        steps = steps.withColumns({"t": t, "d": d})
        usable, whole = F.coalesce(F.col("d") > 0, F.lit(False)), F.log10(F.col("t") + F.col("d"))
        steps = steps.withColumns({
            "value": F.coalesce("value", F.when(usable & F.col(f"c{j}").isNotNull(), F.col("spent") + F.log10(f"c{j}") - whole)),
            "spent": F.when(usable, F.col("spent") + F.log10("d") - whole).otherwise(F.col("spent")),
        })
    uniform = F.log10(F.greatest(F.lit(SYMBOLS) - F.coalesce("d0", nothing), F.lit(1)))
    return known.unionByName(steps.select("gram", F.coalesce("value", F.col("spent") - uniform).alias("value")))


class _Scores:
    """Scores of a block's texts from the values of its strings and the counts of its words."""

    def __init__(self, order: int, total: int, kinds: int):
        self.order, self.total, self.kinds = order, total, kinds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams, words, ready = None, [], [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "tag")]
            cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if block != (block := keys[0][lo]):
                    grams, words, ready = [], [], None
                part, tag = batch.slice(lo, hi - lo), keys[1][lo]
                if tag == 0:
                    grams.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("number", "value")])
                elif tag == 1:
                    words.append((part.column("bytes"), part.column("value").to_numpy(zero_copy_only=False)))
                else:
                    if ready is None:
                        ready = self.tables(grams, words)
                        grams, words = [], []
                    for at in range(0, part.num_rows, TEXTS):
                        yield self.scored(part.slice(at, TEXTS), *ready)

    def tables(self, grams: list, words: list) -> tuple:
        gram, value = (np.concatenate(x) for x in zip(*grams, strict=True))
        order = np.argsort(gram)
        count = np.concatenate([c for _, c in words])
        base = np.log10((count + 0.1) / (self.total + 0.1 * (self.kinds + 1)))
        return gram[order], value[order], pa.concat_arrays([w for w, _ in words]), count > 0, base

    def scored(self, part: pa.RecordBatch, gram: np.ndarray, value: np.ndarray, words: pa.Array, known: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
        bodies = part.column("bytes").to_pylist()
        score = np.zeros(len(bodies))
        for texts, place, code in coded(bodies, self.order):
            # sorted with the places of their texts in the low bits, equal codes stand together
            packed = np.sort(code << TEXT_BITS | place)
            code = packed >> TEXT_BITS
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            found = code[first]
            each = np.where(found == 0, 0.0, value[np.searchsorted(gram, found)])
            place = packed & ((1 << TEXT_BITS) - 1)
            score[texts] += np.bincount(place, np.repeat(each, np.diff(np.r_[first, len(code)])), len(texts))
        lengths, own = words_of(bodies)
        kinds = own.dictionary_encode()
        ids = pc.index_in(kinds.dictionary, words).to_numpy(zero_copy_only=False)[kinds.indices.to_numpy(zero_copy_only=False)]
        end = pc.index_in(pa.array([END], pa.binary()), words)[0].as_py()
        text = np.repeat(np.arange(len(bodies)), lengths)
        n_known = np.bincount(text[known[ids]], minlength=len(bodies)) + int(known[end])
        base_score = np.bincount(text, base[ids], len(bodies)) + base[end]
        held = pc.equal(part.column("value"), 1.0)
        columns = [part.column("number"), held, *map(pa.array, (lengths + 1, n_known, base_score, score))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def scores(docs: DataFrame, order: int = ORDER, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text).

    The model learns from the texts whose crc32(doc_id as text) mod ``folds`` isn't 0.  ``order``
    is at most 5.
    """
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    blocks = int(size // BLOCK) + 1
    digest = saved(_digest(docs.coalesce(max(blocks, shuffle_partitions(docs.sparkSession) // 4)), order, folds), "digest", compression="zstd")
    strings = digest.where("gram is not null").select("block", "gram", "n")
    grams = saved(strings.groupBy("gram").agg(F.sum("n").alias("c")), "strings")
    alike = Window.partitionBy("word")  # at most one row a block
    counted_ = F.sum("n").over(alike).alias("c"), (F.row_number().over(alike.orderBy("block")) == 1).alias("first")
    words = saved(digest.where("word is not null").select("block", "word", *counted_), "words", compression="zstd")
    total, kinds = words.where("first").agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    # one shape for strings, words and texts: number, value, bytes
    none = F.lit(None)
    back = [
        strings.join(_settled(grams, order), "gram").select("block", F.lit(0).alias("tag"), F.col("gram").alias("number"), "value", none.cast("binary").alias("bytes")),
        words.select("block", F.lit(1), none.cast("long"), F.col("c").cast("double"), "word"),
        digest.where("body is not null").select("block", F.lit(2), "doc_id", F.col("held_out").cast("double"), "body"),
    ]
    parts = max(shuffle_partitions(docs.sparkSession), 4 * blocks)  # few tasks get two blocks
    dealt = back[0].union(back[1]).union(back[2]).repartition(parts, "block").sortWithinPartitions("block", "tag")
    scored = dealt.mapInArrow(_Scores(order, total or 0, kinds or 0), SCORED)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.withColumn("train_tokens", F.lit(total or 0).cast("long")).select(*names)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, by words alone and by byte contexts."""
    return scores(documents(spark, sf_dir))
