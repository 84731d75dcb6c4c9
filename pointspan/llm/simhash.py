"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits agree wholly in one segment
(pigeonhole) and by all but two bits in the segment after it.  That one is
decoded with the perfect binary Golay code of length 23: its keys are the
indices of all codewords at distance 4 or less, that is one, or six if the
nearest is at distance 3.  Words of 23 bits that differ in two bits or less
always share such a codeword.  So fingerprints are joined by the key
(segment, its bits, codeword index of the next segment), sixteen or fewer keys
each, and checked by their Hamming distance.

Only distinct fingerprints are joined.  A bucket of a key with up to
``BUCKET`` of them is checked in one numpy block, which gives the edges of a
spanning forest of its links.  Larger ones are handled without pairs: two
fingerprints differ in at most two bits if and only if some word is within one
bit of both, so each gives its 65 such words, and all that share a word (65 at
most) are linked to the smallest.  Both ways lose no link.

Defined results: a null or blank text has the fingerprint zero, which links
like any other; a text of one or two words has one shingle; repeated rows and
ids share a component; a null id is in its text's component and is never its
id, unless the component has no other; an empty table gives an empty result;
other columns are not looked at, and :func:`keep_one` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.llm.components import components
from pointspan.shared import materialize

SEED, WIDTH, NEAR = 42, 3, 2
BUCKET = 512
SALTS, HOT = 64, 4096
CHUNK = 1 << 16
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fixed value: the generator polynomial of the Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white spaces, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(tokens: list[bytes], width: int = WIDTH) -> int:
    """Bit i is set if it is set in over half the shingles' hashes."""
    if not tokens:
        return 0
    n = max(1, len(tokens) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        if n == 1:
            hashes = [digest(b" ".join(tokens), SEED)]
        else:
            runs = zip(*(tokens[at + i : end + i] for i in range(width)), strict=True)
            hashes = [digest(b" ".join(run), SEED) for run in runs]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int((2 * ones > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` and the columns in ``keep``: the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(words(t.as_py())) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keep])

    rest = docs.select(*keep).schema.fields
    schema = "doc_id long, fp long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(k).alias(f"_{k}") for k in keep]).mapInArrow(each, schema)


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the nearest codeword's error, and the indices to add for the other codewords within 4, and how many keys."""

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    spots = [rest(1 << i) for i in range(23)]
    error = np.zeros(2048, dtype=np.int64)
    for a in range(23):
        error[spots[a]] = 1 << a
        for b in range(a):
            error[spots[a] ^ spots[b]] = 1 << a | 1 << b
            for c in range(b):
                error[spots[a] ^ spots[b] ^ spots[c]] = 1 << a | 1 << b | 1 << c
    code = np.array([(d << 11) | rest(d << 11) for d in range(4096)])
    heavy = code[np.bitwise_count(code) == 7]
    others, n = np.zeros((2048, 6), dtype=np.int64), np.ones(2048, dtype=np.int64)
    for s in np.flatnonzero(np.bitwise_count(error) == 3):
        over = heavy[(heavy & error[s]) == error[s]]  # those at distance 4 from a word with this error
        others[s, 1 : 1 + len(over)], n[s] = over >> 11, 1 + len(over)
    return error, others, n


def syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= np.where(v >> i & 1, GENERATOR << (i - 11), 0)
    return v


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For signed fingerprints, the keys and the position of each key's fingerprint."""
    error, others, n = golay_tables()
    p = prints.view(np.uint64)
    parts = [((p >> np.uint64(at)) & np.uint64((1 << wide) - 1)).astype(np.int64) for at, wide in SEGMENTS]
    keys, rows = [], []
    for i, exact in enumerate(parts):
        word = parts[(i + 1) % 3]
        s = syndrome(word)
        index = ((word ^ error[s]) >> 11)[:, None] ^ others[s]
        full = (np.int64(i) << 34) | (exact << 12)[:, None] | index
        real = np.arange(6) < n[s][:, None]
        keys.append(full[real])
        rows.append(np.nonzero(real)[0])
    return np.concatenate(keys), np.concatenate(rows)


def keyed(prints: DataFrame) -> DataFrame:
    """``key, fp`` for every key of every fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys, rows = golay_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], ["key", "fp"])

    return prints.select("fp").mapInArrow(each, "key long, fp long")


def forest(prints: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """The edges of a spanning forest of the links among a bucket's fingerprints."""
    p = prints.view(np.uint64)
    close = np.bitwise_count(p[:, None] ^ p[None, :]) <= near
    left = np.ones(len(p), dtype=bool)
    out = []
    for root in range(len(p)):
        if not left[root]:
            continue
        left[root], edge = False, [root]
        while edge:
            at = edge.pop()
            for to in np.flatnonzero(close[at] & left):
                left[to] = False
                edge.append(to)
                out.append((int(prints[at]), int(prints[to])))
    return out


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all of the distinct fingerprints ``fp`` that are linked."""
    keys = keyed(prints)
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "keys")
    two = shared.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR).select("a", "b")
    more = materialize(keys.join(shared.filter("n > 2").select("key", "n"), "key"), "buckets")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {e for x in batch.column(0) for e in forest(np.sort(x.values.to_numpy(zero_copy_only=False)))}
            a, b = (list(x) for x in zip(*found, strict=True)) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    buckets = more.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    some = buckets.mapInArrow(each, "a long, b long")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    middle = more.filter(F.col("n") > BUCKET).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("word"))
    stars = middle.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return two.unionAll(some).unionAll(stars).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """``fp, root`` for every fingerprint of ``prints``: the smallest one of its component."""
    classes = materialize(prints.select("fp").distinct(), "classes")
    roots = components(links(classes))
    return materialize(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "named")


def simhash(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``fingerprint`` in hex and ``component_id``."""
    prints = materialize(fingerprints(docs), "prints")
    named = grouped(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp")
    best = least.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = salted(named.join(best, "root").select("fp", "component_id"), prints)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return whole.select("doc_id", shown.alias("fingerprint"), "component_id")


def salted(by_print: DataFrame, prints: DataFrame) -> DataFrame:
    """``prints`` with the columns of ``by_print`` (a row per fingerprint).

    The fingerprints that many rows have are copied to ``SALTS`` salts, and
    their rows are dealt to these, so no task gets all rows of one.
    """
    hot = prints.groupBy("fp").agg((F.count("*") > HOT).alias("_hot"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sided = by_print.join(hot, "fp").select(*by_print.columns, "_hot", F.explode(salts).alias("_salt"))
    dealt = F.pmod(F.xxhash64(*[c for c in prints.columns if c != "fp"]), F.lit(SALTS)).cast("int")
    # A row meets the copy of its own salt if its fingerprint is hot, and the only one (of salt 0) if it isn't.
    both = prints.withColumn("_own", dealt).withColumn("_salt", F.explode(F.when(F.col("_own") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.col("_own")))))
    return both.join(sided, ["fp", "_salt"]).filter((~F.col("_hot")) | (F.col("_salt") == F.col("_own"))).drop("_hot", "_salt", "_own")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest id (null last), then of the smallest hash of its columns.

    Every row is told apart by a number of its own, whatever its id, so rows
    without an id and rows that share one are judged like any other; of rows
    that are equal throughout one stays.  Column names of ``docs`` are free.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    numbered = docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row"), F.xxhash64(*plain).alias("rank"))
    stored = materialize(numbered, "rows")
    # Python gets the text and numbers of a row, and gives back numbers only.
    prints = materialize(fingerprints(stored.select("whole.doc_id", "whole.text", "row", "rank"), ("row", "rank")), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rank", "row")
    least = prints.groupBy("fp").agg(F.min(first).alias("first")).join(grouped(prints), "fp")
    kept = least.groupBy("root").agg(F.min("first")["row"].alias("row")).select("row")
    # Whole rows stream past the numbers of those that stay, and aren't sorted.
    return stored.join(kept.hint("shuffle_hash"), "row", "left_semi").select("whole.*")
