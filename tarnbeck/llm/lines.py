"""Substring dedup by line hashing.

A text is cut into lines, and a line further after words whose hash is the smallest of its
neighbourhood, so that a passage copied into the middle of a line falls into the same units
wherever it stands. Units are normalised (lower case, words only) and hashed. What is compared are pieces:
the shortest runs of units that have min_words words, from each unit on and up to each unit, and whole
lines that are shorter. Of equal pieces the one that comes first, by document id and place, is kept, and
the others are removed; the spans keep their offsets in the original text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .tables import join_hot, stash
from .textbits import Texts, Words, find_words, fold_case, mix, pair, text_runs

#: A cut's hash is compared with so many words on either side; a unit has 2 * REACH + 1 words on
#: average, and MAX_UNIT at most.
REACH = 2
#: Texts that are cut together.
ROWS_AT_ONCE = 256
MAX_UNIT = 24


def _unit_starts(texts: Texts, words: Words) -> np.ndarray:
    """Numbers of the words that begin a unit: first of a text, of a line, or after a cut."""
    n = len(words.hash)
    begin = np.zeros(n, bool)
    if not n:
        return np.empty(0, np.int64)
    newline = np.cumsum(texts.data == 10)[words.start]
    begin[0] = True
    begin[1:] = (newline[1:] != newline[:-1]) | (words.row[1:] != words.row[:-1])
    value = mix(words.hash + np.uint64(99))
    low, line = np.ones(n, bool), np.cumsum(begin)
    low[: min(REACH, n)] = low[max(0, n - REACH) :] = False
    for k in range(1, min(REACH, n - 1) + 1):  # a cut has all its neighbours in the line
        same = line[k:] == line[:-k]
        low[k:] &= same & (value[k:] < value[:-k])
        low[:-k] &= same & (value[:-k] <= value[k:])
    closes = np.flatnonzero(low[:-1])
    begin[closes + 1] = True
    starts = np.flatnonzero(begin)
    size = np.diff(np.append(starts, n))
    more = (size - 1) // MAX_UNIT
    if more.any():  # repeated words have no cut of their own
        extra = np.repeat(starts, more) + MAX_UNIT * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        starts = np.union1d(starts, extra)
    return starts


def _unit_hashes(words: Words, starts: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of the words of each unit."""
    n = len(words.hash)
    size = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, size)
    mixed = pair(words.hash, mix(place.astype(np.uint64) + np.uint64(1)))
    return pair(np.add.reduceat(mixed, starts) if len(starts) else mixed, size.astype(np.uint64))


def units(texts: pa.Array) -> Iterator[tuple[int, Texts, Words, np.ndarray, np.ndarray]]:
    """(first row, texts, words, unit starts, unit hashes) for runs of texts; offsets are bytes."""
    for lo, hi, raw in text_runs(texts, lower=False):
        lower = fold_case(raw)
        words = find_words(lower)
        starts = _unit_starts(lower, words)
        yield lo, lower, words, starts, _unit_hashes(words, starts)


def _pieces(
    texts: Texts, words: Words, starts: np.ndarray, digest: np.ndarray, min_words: int, min_line: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first unit, last unit, hash) of the pieces in order of place: runs of units of a text with
    min_words words that are as short as can be from their first unit on or up to their last, so that
    any longer run is covered by those within it; and lines of min_line to min_words - 1 words."""
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    ends, place, row = np.append(starts[1:], len(words.hash)), np.arange(n), words.row[starts]
    to = np.searchsorted(ends, starts + min_words)
    since = np.searchsorted(starts, ends - min_words, side="right") - 1
    a, b = np.concatenate([place, since]), np.concatenate([to, place])
    within = (a >= 0) & (b < n)
    a, b = a[within], b[within]
    same = row[a] == row[b]
    key = np.unique(a[same] * (min_words + 1) + b[same] - a[same])
    a, b = key // (min_words + 1), key // (min_words + 1) + key % (min_words + 1)
    newline = np.cumsum(texts.data == 10)[words.start]
    head = np.flatnonzero(np.concatenate(([True], newline[1:] != newline[:-1])))
    tail = np.append(head[1:], len(words.hash))
    short = (tail - head >= min_line) & (tail - head < min_words)
    a = np.concatenate([a, np.searchsorted(starts, head[short])])
    b = np.concatenate([b, np.searchsorted(starts, tail[short]) - 1])
    hashed = digest[a]
    for k in range(1, int((b - a).max(initial=0)) + 1):
        on = np.flatnonzero(a + k <= b)
        hashed[on] = pair(hashed[on], digest[a[on] + k])
    hashed[len(key) :] = mix(hashed[len(key) :] + np.uint64(7))  # a line isn't a part of one
    order = np.argsort(a, kind="stable")
    return a[order], b[order], hashed[order]


def piece_table(docs: DataFrame, min_words: int, min_line: int) -> DataFrame:
    """docs (doc_id, text) to (digest, doc_id): each distinct digest of a text's pieces once;
    repeats within a text are found again when it is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, texts, words, starts, unit in units(batch.column(1)):
                first, _, digest = _pieces(texts, words, starts, unit, min_words, min_line)
                row = words.row[starts[first]]
                order = np.lexsort((digest, row))
                new = np.ones(len(order), bool)
                new[1:] = (digest[order][1:] != digest[order][:-1]) | (row[order][1:] != row[order][:-1])
                keep = order[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[keep].view(np.int64)), pa.array(ids[lo + row[keep]])], names=["digest", "doc_id"]
                )

    return docs.mapInArrow(run, "digest long, doc_id long")


def _spans(texts: pa.Array, seen: pa.ListArray, min_words: int, min_line: int) -> Iterator[list[tuple[int, int]]]:
    """For each text, the byte spans to remove: pieces whose digest is in its list `seen` or came
    before in the text, joined where they meet, from first word to last."""
    for lo, lower, words, starts, unit in units(texts):
        first, last, digest = _pieces(lower, words, starts, unit, min_words, min_line)
        row = words.row[starts]
        part = seen.slice(lo, len(lower))
        owner = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
        listed = np.sort(pair(owner.astype(np.uint64), part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
        own = pair(row[first].astype(np.uint64), digest)
        again = np.ones(len(own), bool)
        again[np.unique(own, return_index=True)[1]] = False
        if len(listed):
            again |= listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own
        cover = np.bincount(first[again], minlength=len(starts) + 1) - np.bincount(last[again] + 1, minlength=len(starts) + 1)
        gone = np.cumsum(cover)[:-1] > 0
        turn = np.ones(len(starts), bool)
        turn[1:] = (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(turn)
        tail = np.append(head[1:], len(starts))
        begin = starts[head]
        end = np.append(starts, len(words.hash))[tail] - 1
        take = gone[head]
        base = lower.starts[row[head[take]]]
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(lower))]
        spans = zip(row[head[take]], words.start[begin[take]] - base, words.end[end[take]] - base, strict=True)
        for r, s, e in spans:
            out[r].append((int(s), int(e)))
        yield from out


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[int], list[int]]:
    """Text without byte spans, each taken to the next word or the end of its line; and the spans
    as character offsets in the original text."""
    raw = text.encode()
    kept, at, starts, ends, chars, seen = [], 0, [], [], 0, 0
    for s, e in spans:
        while e < len(raw) and raw[e] < 128 and not raw[e : e + 1].isalnum() and raw[e] != 10:
            e += 1
        if e < len(raw) and raw[e] == 10 and (s == 0 or raw[s - 1] == 10):
            e += 1
        chars += len(raw[seen:s].decode())
        starts.append(chars)
        chars += len(raw[s:e].decode())
        ends.append(chars)
        seen = e
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return b"".join(kept).decode(), starts, ends


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, min_line: int = 4) -> DataFrame:
    """docs with text_col cut, and two columns: removed_starts and removed_ends, character offsets
    of what was removed, in the original text (empty if nothing was).

    Removed are parts of lines whose min_words words or more stood together before, and whole lines of
    min_line words or more that did; shorter lines stay. Every piece of every text is compared, in whole
    texts; the earliest is the one of the smallest id, and in a text the first. Rows with one id are one
    document: a piece of one isn't removed from another. Null texts stay null, empty ones empty. Rows without an id come after all ids, in
    the order of a hash of their text; those of one text are one document.
    Copies of a whole text keep their row, with what is left of it. An empty table gives no rows.
    Other columns stay as they are; columns with the names of the two added ones are replaced.
    """
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 62))
    rank = F.coalesce(F.col(id_col).cast("long"), nameless)
    plain = docs.select(rank.alias("doc_id"), F.col(text_col).alias("text"))
    table = stash(piece_table(plain.filter("text is not null and text <> ''"), min_words, min_line), "pieces")
    met = table.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = met.filter("first <> last").select("digest", "first", "n")
    later = join_hot(table, first, "digest", "n", table.count()).filter("doc_id <> first")
    seen = later.groupBy("doc_id").agg(F.collect_set("digest").alias("seen"))
    whole = docs.select(rank.alias("doc_id"), F.struct("*").alias("whole")).join(seen, "doc_id", "left")
    rows = whole.select("whole", F.col("whole").getField(text_col).alias("text"), F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(1)
                spans = list(_spans(texts, part.column(2), min_words, min_line))
                done = [_cut(texts[i].as_py(), s) if s else None for i, s in enumerate(spans)]
                columns = (
                    pa.array([t.as_py() if d is None else d[0] for t, d in zip(texts, done, strict=True)], pa.string()),
                    *(pa.array([[] if d is None else d[k] for d in done], pa.list_(pa.int32())) for k in (1, 2)),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["whole", "text", "starts", "ends"])

    starts, ends = (StructField(n, ArrayType(IntegerType())) for n in ("starts", "ends"))
    done = rows.mapInArrow(cut, StructType([rows.schema["whole"], StructField("text", StringType()), starts, ends]))
    added = {"removed_starts": F.col("starts"), "removed_ends": F.col("ends")}
    kept = [F.col("whole").getField(c).alias(c) if c != text_col else F.col("text").alias(c) for c in docs.columns if c not in added]
    return done.select(*kept, *(c.alias(name) for name, c in added.items()))
