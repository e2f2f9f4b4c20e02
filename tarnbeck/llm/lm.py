"""Language-model scoring: stupid backoff, computed as joins of hash-partitioned blocks.

Each token is scored by S(w2 | w1) = c(w1 w2) / c(w1) if the bigram table has it, and by
alpha * c(w2) / N if not; a text's first token by c(w) / N. Counts are taken over all texts; the
bigram table keeps what occurs at least min_count times.

Rows of the relations are blocks: a run of texts sends one row to each partition, which holds the
keys of all its tokens that belong there. Bigrams go to the partition of their first word,
where they are counted, joined to the counts and summed per text; what isn't in the table
goes on to the partition of its second word. Words and bigrams with over 1/HEAVY of all tokens
(so at most HEAVY of each) are counted first and are known everywhere: a heavy bigram isn't sent
at all, and the other bigrams of a heavy word are dealt by the whole bigram, so no partition
grows with a common word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash
from .textbits import find_words, pair, text_runs

HEAVY = 65536
#: Bytes of text for each partition of the counts, and tokens in a run of texts.
PARTITION_BYTES = 8 << 20
RUN_TOKENS = 1 << 19

ROW = "part long, kind int, run long, a binary, b binary, c binary"
COUNTED, TEXTS, VOCABULARY, MISSED, SUMS = range(5)


@dataclass(frozen=True)
class Keys:
    """How words become numbers: ids of so many bits, dealt over parts by their remainder."""

    parts: int

    @property
    def bits(self) -> int:
        """As many as let a bigram fit 63 bits, the part of its first word being known."""
        return int((63 + math.log2(self.parts)) // 2)

    def ids(self, words: np.ndarray) -> np.ndarray:
        return words >> np.uint64(64 - self.bits)


@dataclass(frozen=True)
class Heavy:
    """Sorted ids of heavy words and keys of heavy bigrams, with their counts over all texts."""

    words: np.ndarray
    word_counts: np.ndarray
    bigrams: np.ndarray
    bigram_counts: np.ndarray


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _tokens(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, word ids, number of words of each text) for runs of about RUN_TOKENS tokens."""
    docs, words, sizes, held = [], [], [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, texts in text_runs(batch.column(1)):
            found = find_words(texts)
            docs.append(ids[lo:hi])
            words.append(keys.ids(found.hash))
            sizes.append(np.diff(found.first))
            held += len(found.hash)
            if held >= RUN_TOKENS:
                yield np.concatenate(docs), np.concatenate(words), np.concatenate(sizes)
                docs, words, sizes, held = [], [], [], 0
    if docs:
        yield np.concatenate(docs), np.concatenate(words), np.concatenate(sizes)


def _first_and_last(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of tokens that begin and that end a text."""
    ends = np.cumsum(sizes)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[(ends - sizes)[sizes > 0]] = True
    last[ends[sizes > 0] - 1] = True
    return first, last


def _bigrams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the bigram that ends in the token, token) for all tokens with a token before."""
    at = np.flatnonzero(~first)
    return pair(words[at - 1], words[at]), at


def _heavy_counts(docs: DataFrame, keys: Keys, only: Heavy | None) -> DataFrame:
    """(kind, key, n): counts of words (0) and bigrams (1); of all that are frequent in a run, or
    of those in `only`; and under kind 2 the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, sizes in _tokens(batches, keys):
            first, _ = _first_and_last(sizes, len(words))
            out = [(2, np.zeros(1, np.uint64), np.array([len(words)]))]
            for kind, found in ((0, words), (1, _bigrams(words, first)[0])):
                if only is None:
                    key, n = np.unique(found, return_counts=True)
                    often = n >= max(2, len(words) // (4 * HEAVY))
                    key, n = key[often], n[often]
                else:
                    key = only.bigrams if kind else only.words
                    at = _place(key, found)
                    n = np.bincount(at[at >= 0], minlength=len(key))
                    key, n = key[n > 0], n[n > 0]
                out.append((kind, key, n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _ in out])),
                    pa.array(np.concatenate([k for _, k, _ in out]).view(np.int64)),
                    pa.array(np.concatenate([n for _, _, n in out]).astype(np.int64)),
                ],
                names=["kind", "key", "n"],
            )

    counts = docs.mapInArrow(run, "kind int, key long, n long")
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def find_heavy(docs: DataFrame, keys: Keys) -> tuple[Heavy, int]:
    """Heavy words and bigrams with their exact counts, and the number of tokens. Candidates come
    from all texts, at every size; counts cover all texts, too."""
    seen = stash(_heavy_counts(docs, keys, None), "heavy")
    total = seen.filter("kind = 2").agg(F.sum("n")).head()[0] or 0
    often = seen.filter((F.col("kind") < 2) & (F.col("n") >= max(64, total // HEAVY))).toArrow()
    kind, key = often["kind"].to_numpy(), often["key"].to_numpy().view(np.uint64)
    words, bigrams = np.sort(key[kind == 0]), np.sort(key[kind == 1])
    none = np.empty(0, np.int64)
    table = _heavy_counts(docs, keys, Heavy(words, none, bigrams, none)).toArrow()
    kind, key, n = table["kind"].to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    counts = [np.zeros(len(words), np.int64), np.zeros(len(bigrams), np.int64)]
    for k, sorted_keys in enumerate((words, bigrams)):
        counts[k][_place(sorted_keys, key[kind == k])] = n[kind == k]
    return Heavy(words, counts[0], bigrams, counts[1]), int(n[kind == 2].sum())


def _row(part: int, kind: int, run: int, *fields: np.ndarray | bytes) -> tuple:
    return (part, kind, run, *(x if isinstance(x, bytes) else x.tobytes() for x in fields), *([None] * (3 - len(fields))))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, the width first."""
    width = 1 if (most := int(x.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.uint32)


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _narrow(np.diff(x, prepend=np.uint32(0)))


def _from_steps(packed: bytes) -> np.ndarray:
    return np.cumsum(_wide(packed), dtype=np.uint32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["part", "kind", "run", "a", "b", "c"]
    )


def _in_parts(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows of it in their order)."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    for p, lo, hi in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        yield int(p), order[lo:hi]


def _send(docs: DataFrame, keys: Keys, heavy: Heavy, tokens: int, min_count: int, alpha: float) -> DataFrame:
    """Blocks of tokens for the partition of their context: (text, context and word). The last
    token of a text is sent as a context without a word, so contexts are all tokens. First tokens
    go straight to the partition of the word. Rows of kind TEXTS list a run's texts, with the
    number of their tokens and the part of their sums that is settled here."""
    bits, parts = np.uint64(keys.bits), np.uint64(keys.parts)
    top = np.uint64(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, (ids, words, sizes) in enumerate(_tokens(batches, keys)):
            n = base + number
            text = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            first, last = _first_and_last(sizes, len(words))
            key, at = _bigrams(words, first)
            out = []

            # heavy bigrams, and first tokens and missing bigrams whose word is heavy, are scored here
            known = _place(heavy.bigrams, key)
            context = _place(heavy.words, words)
            local = np.zeros(len(words))
            sure = (known >= 0) & (context[at - 1] >= 0)
            count = heavy.bigram_counts[known[sure]]
            hit = np.log(np.maximum(count, 1) / np.maximum(heavy.word_counts[context[at[sure] - 1]], 1))
            word_count = heavy.word_counts[context[at[sure]]] if len(heavy.words) else count
            seen_word = context[at[sure]] >= 0
            # a heavy bigram's second word occurs as often as the bigram at least, so it is heavy too
            local[at[sure]] = np.where(count >= min_count, hit, math.log(alpha) + np.log(np.maximum(word_count, 1) / tokens))
            sure[np.flatnonzero(sure)[~seen_word]] = False
            local[at[~sure]] = 0
            begin = np.flatnonzero(first)
            easy = begin[context[begin] >= 0]
            local[easy] = np.log(heavy.word_counts[context[easy]] / tokens)
            hard = begin[context[begin] < 0]
            for p, rows in _in_parts(words[hard] % parts):
                w = (words[hard[rows]] // parts).astype(np.uint32)
                out.append(_row(p, MISSED, n, _narrow(text[hard[rows]]), w))

            # the other bigrams, and the last tokens as contexts
            rest = at[~sure]
            rare = context[rest - 1] < 0
            entry = np.where(
                rare,
                ((words[rest - 1] // parts) << bits) | words[rest],
                top | (np.maximum(context[rest - 1], 0).astype(np.uint64) << bits) | words[rest],
            )
            part = np.where(rare, words[rest - 1] % parts, key[~sure] % parts)
            for p, rows in _in_parts(part):
                out.append(_row(p, COUNTED, n, _steps(text[rest[rows]]), entry[rows]))
            # contexts that no bigram shows
            final = np.flatnonzero(last & (context < 0))
            for p, rows in _in_parts(words[final] % parts):
                out.append(_row(p, VOCABULARY, n, words[final[rows]] // parts))
            sums = np.bincount(text, local, minlength=len(sizes))
            out.append(_row(n % keys.parts, TEXTS, n, ids.astype(np.int64), sizes.astype(np.int64), sums))
            yield _rows(out)

    return docs.mapInArrow(run, ROW)


def _sorted_parts(rows: DataFrame, parts: int, key: str = "part") -> DataFrame:
    return rows.repartition(parts, key).sortWithinPartitions(key)


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that arrive sorted by a column, one group of its values at a time."""
    at, held = None, []
    for batch in batches:
        value = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if value[lo] != at:
                if held:
                    yield at, held
                at, held = value[lo], []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held


def _pieces(group: list[pa.RecordBatch], kind: int) -> Iterator[tuple[int, list[bytes]]]:
    for batch in group:
        kinds = batch.column(1).to_numpy()
        for i in np.flatnonzero(kinds == kind).tolist():
            yield batch.column(2)[i].as_py(), [batch.column(c)[i].as_py() for c in (3, 4, 5)]


def _sums_by_text(owner: np.ndarray, runs: np.ndarray, text: np.ndarray, value: np.ndarray) -> Iterator[tuple]:
    """SUMS rows of a part: for each run, the texts that have a value here, and their sums."""
    both = (owner.astype(np.int64) << 32) | text
    key, at = np.unique(both, return_inverse=True)
    total = np.bincount(at, value, minlength=len(key))
    for k, rows in _in_parts(key >> 32):
        yield _row(0, SUMS, int(runs[k]), _steps((key[rows] & 0xFFFFFFFF).astype(np.uint32)), total[rows])


def _count(sent: DataFrame, keys: Keys, heavy: Heavy, tokens: int, min_count: int, alpha: float) -> DataFrame:
    """Count the bigrams and contexts of each partition, score what its tables have, and send on
    what they haven't. One partition's blocks are in memory at a time."""
    bits, parts = np.uint64(keys.bits), np.uint64(keys.parts)
    mask, top = np.uint64((1 << keys.bits) - 1), np.uint64(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _grouped(batches, 0):
            out = [(part, kind, r, *c) for kind in (TEXTS, MISSED) for r, c in _pieces(group, kind)]
            pieces = list(_pieces(group, COUNTED))
            extra = [np.frombuffer(c[0], np.uint64) for _, c in _pieces(group, VOCABULARY)]
            del group
            runs = np.array([r for r, _ in pieces], np.int64)
            text = np.concatenate([np.empty(0, np.uint32), *(_from_steps(c[0]) for _, c in pieces)])
            entry = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(c[1], np.uint64) for _, c in pieces)])
            owner = np.repeat(np.arange(len(pieces)), [len(c[1]) // 8 for _, c in pieces])
            del pieces
            order = np.argsort(entry, kind="stable")
            entry = entry[order]
            start = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else np.empty(0, np.int64)
            size = np.diff(np.append(start, len(entry)))
            distinct = entry[start]
            context = distinct >> bits  # heavy contexts have the top bit set
            light = distinct < top
            vocabulary, of = np.unique(np.concatenate([context[light], *extra]), return_inverse=True)
            weight = np.concatenate([size[light], np.ones(sum(map(len, extra)))])
            counts = np.bincount(of, weight, minlength=len(vocabulary)).astype(np.int64)
            out.append(_row(part, VOCABULARY, 0, vocabulary, counts))

            below = np.empty(len(distinct))
            below[light] = counts[np.searchsorted(vocabulary, context[light])]
            below[~light] = heavy.word_counts[(context[~light] ^ (top >> bits)).astype(np.int64)] if (~light).any() else 0
            hit = size >= min_count
            value = np.where(hit, np.log(size / np.maximum(below, 1)), 0.0)
            # missing bigrams whose word is heavy are settled here
            word = distinct & mask
            easy = _place(heavy.words, word)
            settled = ~hit & (easy >= 0)
            if settled.any():
                value[settled] = math.log(alpha) + np.log(heavy.word_counts[easy[settled]] / tokens)
            value = np.repeat(value, size)
            text, owner = text[order], owner[order]
            done = np.repeat(hit | settled, size)
            out += _sums_by_text(owner[done], runs, text[done], value[done])
            missed = np.flatnonzero(~done)
            missed = missed[np.argsort(owner[missed], kind="stable")]
            word = np.repeat(word, size)[missed]
            for q, rows in _in_parts(word % parts):
                own = owner[missed[rows]]
                cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                head = np.stack([runs[own[cut]], np.diff(np.append(cut, len(own)))])
                out.append(_row(q, MISSED, -1, _narrow(text[missed[rows]]), (word[rows] // parts).astype(np.uint32), head))
            yield _rows(out)

    return sent.mapInArrow(run, ROW)


def _settle(counted: DataFrame, tokens: int, alpha: float) -> DataFrame:
    """Score the tokens that were sent on by the counts of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 0):
            tables = [c for _, c in _pieces(group, VOCABULARY)]
            words = np.concatenate([np.frombuffer(c[0], np.uint64) for c in tables]) if tables else np.empty(0, np.uint64)
            logs = np.log(np.concatenate([np.frombuffer(c[1], np.int64) for c in tables]) / tokens) if tables else np.empty(0)
            runs, sizes, text, value = [], [], [], []
            for r, (t, w, head) in _pieces(group, MISSED):
                text.append(_wide(t))
                found = logs[np.searchsorted(words, np.frombuffer(w, np.uint32).astype(np.uint64))]
                if r >= 0:  # first tokens of texts
                    runs.append(np.array([r], np.int64))
                    sizes.append(np.array([len(found)]))
                else:
                    both = np.frombuffer(head, np.int64).reshape(2, -1)
                    runs.append(both[0])
                    sizes.append(both[1])
                    found = found + math.log(alpha)
                value.append(found)
            if text:
                all_runs, at = np.unique(np.concatenate(runs), return_inverse=True)
                owner = np.repeat(at, np.concatenate(sizes))
                yield _rows(list(_sums_by_text(owner, all_runs, np.concatenate(text), np.concatenate(value))))

    return counted.mapInArrow(run, ROW)


def _gather(rows: DataFrame) -> DataFrame:
    """Sums of a run's texts, put beside their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 2):
            ((_, (ids, sizes, local)),) = _pieces(group, TEXTS)
            total = np.frombuffer(local, np.float64).copy()
            for _, (text, value, _) in _pieces(group, SUMS):
                total[_from_steps(text)] += np.frombuffer(value, np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(sizes, np.int64)), pa.array(total)],
                names=["doc_id", "tokens", "log_score"],
            )

    return rows.mapInArrow(run, "doc_id long, tokens long, log_score double")


def backoff_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = 2, alpha: float = 0.4,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """(doc_id, tokens, log_score, score) for every row of docs: the sum of natural logarithms of
    stupid-backoff scores, and its mean over the tokens.

    Tokens are lower-cased runs of letters, digits and characters beyond ASCII, of whole texts.
    Null and empty texts have 0 tokens, a sum of 0 and no mean. Repeated rows count and keep
    their row. Null ids keep their row. An empty table gives no rows. Words are known by hashes of
    34 bits and more, growing with the input. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).head()[0] or 0
    keys = Keys(max(8, math.ceil(size / partition_bytes)))
    heavy, tokens = find_heavy(rows, keys)
    tokens = max(tokens, 1)
    noted = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    sent = _send(noted, keys, heavy, tokens, min_count, alpha)
    counted = stash(_count(_sorted_parts(sent, keys.parts), keys, heavy, tokens, min_count, alpha), "counted")
    settled = _settle(_sorted_parts(counted.filter(F.col("kind").isin(VOCABULARY, MISSED)), keys.parts), tokens, alpha)
    sums = counted.filter(F.col("kind").isin(TEXTS, SUMS)).unionByName(settled)
    done = _gather(_sorted_parts(sums, keys.parts, "run"))
    return done.select(
        F.expr(f"nullif(doc_id, {-(1 << 63) + 1} - 1)").alias("doc_id"), "tokens", "log_score",
        F.when(F.col("tokens") > 0, F.col("log_score") / F.col("tokens")).alias("score"),
    )
