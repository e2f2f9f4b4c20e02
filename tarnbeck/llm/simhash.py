"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at
most two bits have a segment that differs in at most one, so each segment is indexed 32 times,
each time with one bit replaced by a wildcard; fingerprints that meet under an equal key are
verified. All distinct fingerprints are indexed; equal ones are one node from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .tables import join_hot, stash

HALF = 32
#: Buckets with more fingerprints than this go to the path for hot buckets, which is as exact.
HOT_BUCKET = 1024
#: Bytes of a text that are cut into words at a time.
PIECE_BYTES = 1 << 20


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42, most: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined word shingles, repeats included; the whole sequence if it has
    fewer words; none for a text without words. A long text is hashed in pieces of about `most` bytes
    that share size - 1 words, so memory doesn't grow with its words."""
    raw = (text or "").encode()
    digest, carry, whole, at = xxhash.xxh64_intdigest, [], True, 0
    while at < len(raw):
        end = _BLANK.search(raw, at + most) if at + most < len(raw) else None
        to = end.start() if end else len(raw)
        words = carry + raw[at:to].lower().split()  # bytes: A-Z and \x20\x09-\x0D only
        at = to
        if len(words) >= size:
            whole = False
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
            yield np.fromiter((digest(line[s:e], seed) for s, e in spans), np.uint64)
        carry = words[-(size - 1) :] if size > 1 else []
    if whole and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set. Eight counters of a byte each are added in one
    word, in runs too short to overflow."""
    ones = np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    edges = np.arange(0, len(hashes), 255)
    for bit in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, edges)
        ones[bit::8] = packed.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: str | None) -> int:
    """Each bit is 1 if it is set in over half of the hashes of the text's shingles."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        ones += bit_counts(hashes)
        n += len(hashes)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, and what is to be carried): fp is the unsigned fingerprint kept in a signed long.
    Null and empty texts have no words and the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    also = {"doc_id": F.col(id_col).cast("long")} | (carry or {})
    rows = docs.select(F.col(text_col).alias("text"), *(c.alias(n) for n, c in also.items()))
    return rows.mapInArrow(run, StructType([StructField("fp", LongType()), *rows.schema.fields[1:]]))


class _Forest:
    """Union-find over the fingerprints of one task; emits a spanning forest of the links."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root and p != x:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links_in_buckets(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints of rows sorted by key that share a key and differ in at most two bits.
    Rows are compared at growing shifts; a bucket of n rows takes part in n - 1 of them."""
    left, right = [], []
    live = np.arange(len(key))
    shift = 1
    while len(live):
        live = live[live + shift < len(key)]
        live = live[key[live] == key[live + shift]]
        close = live[np.bitwise_count((fp[live] ^ fp[live + shift]).view(np.uint64)) <= 2]
        left.append(fp[close])
        right.append(fp[close + shift])
        shift += 1
    return np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard signatures of each fingerprint. A key holds a hash of
    the segment's number, the wildcard's place and the segment without that bit."""
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", HALF))
    keys = f"transform(sequence(0, {HALF - 1}), i -> xxhash64(seg, i, bits & ~shiftleft(1L, i)))"
    return fps.select("fp", F.posexplode(halves).alias("seg", "bits")).select(F.explode(F.expr(keys)).alias("key"), "fp")


def _bucket_links(variants: DataFrame, hot: int) -> DataFrame:
    """(a, b): links of verified fingerprints, and the rows of hot buckets (b null), which a later
    step takes. Rows arrive sorted by key, so a task holds one batch and the bucket at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        kept: tuple[np.ndarray, np.ndarray] | None = None
        spilling = None  # the hot bucket that is passing by

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["a", "b"])

        def flush(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, where, size = np.unique(key, return_inverse=True, return_counts=True)
            many = size[where] > hot
            if many.any():
                yield out(fp[many], None)
            few = (size[where] > 1) & ~many
            a, b = _links_in_buckets(key[few], fp[few])
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                new = [(x, y) for x, y in zip(*pairs.tolist(), strict=True) if forest.join(x, y)]
                if new:
                    yield out(np.array([x for x, _ in new]), np.array([y for _, y in new]))

        for batch in batches:
            key, fp = (batch.column(i).to_numpy() for i in range(2))
            if kept is not None:
                key, fp = (np.concatenate(x) for x in zip(kept, (key, fp), strict=True))
                kept = None
            if spilling is not None:
                n = int(np.searchsorted(key != spilling, True))
                if n:
                    yield out(fp[:n], None)
                if n == len(key):
                    continue
                key, fp, spilling = key[n:], fp[n:], None
            if not len(key):
                continue
            last = int(np.searchsorted(key == key[-1], True))
            tail = key[last:], fp[last:]
            if len(tail[0]) > hot:
                spilling = tail[0][0]
                yield out(tail[1], None)
            else:
                kept = tail
            yield from flush(key[:last], fp[:last])
        if kept is not None:
            yield from flush(*kept)

    return variants.mapInArrow(run, "a long, b long")


def _hot_links(rows: DataFrame) -> DataFrame:
    """Links among the fingerprints of hot buckets, without pairs: each fingerprint is keyed by
    all its variants with two wildcards (2016). Those that share such a key differ in at most two
    bits, so a star to the smallest of the key joins just what belongs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(64, 1)
        mask = (np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64))
        salt = np.random.default_rng(7).integers(0, 2**63, len(mask), dtype=np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 64):
                key = ((fp[at : at + 64].view(np.uint64)[:, None] & ~mask) * np.uint64(0x9E3779B97F4A7C15)) ^ salt
                key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(fp[at : at + 64], len(mask))),
                        pa.array(np.tile(np.arange(len(mask), dtype=np.int32), len(key))),
                        pa.array(key.reshape(-1).view(np.int64)),
                    ],
                    names=["fp", "pair", "key"],
                )

    keyed = rows.select(F.col("a").alias("fp")).distinct().mapInArrow(run, "fp long, pair int, key long")
    least = keyed.groupBy("pair", "key").agg(F.min("fp").alias("m"), F.max("fp").alias("most")).filter("most > m")
    return (
        keyed.join(least, ["pair", "key"])
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= 2)
        .select(F.col("m").alias("a"), F.col("fp").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def simhash_links(fps: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """fps (fp long), one row per distinct fingerprint, to links (a, b) of fingerprints whose
    components are those of all pairs within two bits."""
    found = stash(_bucket_links(_variants(fps).repartition("key").sortWithinPartitions("key"), hot), "links")
    links = found.filter("b is not null")
    spilt = found.filter("b is null").select("a")
    if spilt.isEmpty():
        return links
    return links.unionByName(_hot_links(spilt))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long) for every row of docs.

    Null and empty texts, and texts of blanks, have fingerprint zero and are one component with
    whatever lies within two bits of zero. Repeated rows each keep their row. A null id keeps its
    row; as it names no document, it links like the others but never is a component_id unless
    all of its component are null, which gives null. An empty table gives no rows. Columns other than
    the two named are not read.
    """
    prints = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _leasts(prints, F.col("doc_id"), hot).select("fp", F.col("least").alias("component_id"), "n")
    return join_hot(prints, named, "fp", "n", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _leasts(prints: DataFrame, rank: Column, hot: int) -> DataFrame:
    """(fp, least, n): for each fingerprint the smallest rank in its component, nulls aside, and the number of its rows."""
    nodes = stash(prints.groupBy("fp").agg(F.min(rank).alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(simhash_links(nodes.select("fp"), hot)).withColumnRenamed("node", "fp")
    rooted = stash(nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("size"))
    return stash(join_hot(rooted.select("fp", "n", "root"), smallest, "root", "size", rooted.count()).select("fp", "least", "n"), "leasts")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_BUCKET) -> DataFrame:
    """docs with one row of each component of near duplicates, all columns kept (none may be a map).

    The row of the smallest id stays; rows without an id come after all ids, and of rows with one id
    the one with the smallest hash of the whole row. Rows that repeat as a whole are one row. Null
    and empty texts are near duplicates of each other. An empty table gives no rows.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*every).alias("whole")
    nulls = F.array(*(c.isNull() for c in every))  # a hash passes over nulls
    keys = {f"k{i}": F.xxhash64(F.lit(i), nulls, *every) for i in range(2)}
    prints = stash(fingerprints(docs, id_col, text_col, keys), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k0", "k1")
    least = _leasts(prints, rank, hot).select("least.k0", "least.k1")
    single = docs.select(*(c.alias(n) for n, c in keys.items()), whole).groupBy("k0", "k1").agg(F.first("whole").alias("whole"))  # 128 bits: equal keys are equal rows
    return single.join(least, ["k0", "k1"], "left_semi").select("whole.*")
