"""Benchmark decontamination by CGK embedding and bit sampling.

Texts and items are sequences of word hashes. A CGK random walk (Chakraborty, Goldenberg and
Koucky, 2016) maps a sequence to a longer one so that a small edit distance becomes a small Hamming
distance; sampled coordinates of the walk are hashed into keys, and a window of a text that shares
a key with an item is a candidate. Walks are repeated until the wanted recall is reached for the
largest edit distance allowed. Candidates are verified by exact word edit distance.

Windows are as long as the items they are compared with. Walks are spent only on windows that could
hold an item: k edits leave at least L - (q - 1) - qk of an item's L - (q - 1) word q-grams intact, so a
window that shows fewer q-grams of the items of its size than that holds no item within k edits; q is
the largest up to 3 that leaves one. Items so short that no edit is allowed are looked up as they are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbits import HashSet, Words, find_words, fold_case, mix, pair, text_runs

#: Items are compared at window sizes that grow by this factor; longer ones by their beginning.
SIZE_STEP = 1.15
#: Coordinates that a key joins, and keys drawn from one walk.
SAMPLED = 2
KEYS_PER_WALK = 4
#: Share of coordinates that still agree at the largest edit rate allowed (a fifth), measured.
LEAST_AGREEMENT = 0.45
WINDOWS_AT_ONCE = 4096
#: Bytes of text searched together: the more, the fewer rounds of small steps over few windows.
RUN_BYTES = 2 << 20


def allowed_edits(words: int, rate: float) -> int:
    """Word edits allowed in an item; never all of its words."""
    return min(int(rate * words + 1e-9), words - 1)


def walks_for(recall: float) -> int:
    """Walks after which a pair at the largest distance has met with this probability; halved
    once more, as keys of one walk are not independent."""
    miss = 1.0 - LEAST_AGREEMENT**SAMPLED
    return 2 * math.ceil(math.log(1.0 - recall) / math.log(miss) / KEYS_PER_WALK)


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words."""
    out = words[: max(0, len(words) - q + 1)]
    for k in range(1, q):
        out = pair(out, words[k : k + len(out)])
    return out


def intact(words: int, edits: int, q: int) -> int:
    """How many of so many words' q-grams that many edits leave at least."""
    return words - (q - 1) - q * edits


def walk_keys(symbols: np.ndarray, starts: np.ndarray, size: int, limit: np.ndarray, walks: int, seed: int) -> np.ndarray:
    """(windows, walks * KEYS_PER_WALK) keys of the windows symbols[start : start + size], cut at
    limit. At each step the walk shows the symbol where it stands, then moves on or stays by a
    random bit of the step and the symbol; beyond the end it shows 0."""
    rng = np.random.default_rng(seed + 1000 * size)
    steps = 3 * size // 2
    out = np.empty((len(starts), walks * KEYS_PER_WALK), np.uint64)
    end = np.minimum(starts + size, limit)
    for w in range(walks):
        salt = rng.integers(0, 1 << 62, steps, dtype=np.uint64)
        sampled = np.stack([rng.choice(steps, SAMPLED, replace=False) for _ in range(KEYS_PER_WALK)])
        shown = {int(j): None for j in sampled.ravel()}
        at = starts.copy()
        for j in range(max(shown) + 1):
            symbol = np.where(at < end, symbols[np.minimum(at, len(symbols) - 1)], np.uint64(0))
            if j in shown:
                shown[j] = symbol
            at += (mix(symbol + salt[j]) >> np.uint64(63)).astype(np.int64)
        for t, places in enumerate(sampled):
            key = np.full(len(starts), (w * KEYS_PER_WALK + t) * 65537 + size, np.uint64)
            for j in sorted(places.tolist()):
                key = pair(key, shown[j])
            out[:, w * KEYS_PER_WALK + t] = key
    return out


def edit_distance_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(distance, from, to) of the stretch of text nearest to the item by word edits; distance is
    most + 1 if none is within most. Ends of the text are free; of equally near stretches the one
    that ends first, and then the longest, counts."""
    n = len(text)
    best = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    for i, symbol in enumerate(item.tolist(), 1):
        change = best[:-1] + (text != symbol)
        drop = best + 1
        row = drop.copy()
        source = origin.copy()
        better = (change < row[1:]) | ((change == row[1:]) & (origin[:-1] < source[1:]))
        row[1:][better] = change[better]
        source[1:][better] = origin[:-1][better]
        # words of the text that the item lacks: a running minimum along the row
        slope = row - np.arange(n + 1)
        least = np.minimum.accumulate(slope)
        fresh = np.concatenate(([True], slope[1:] < least[:-1]))
        lead = np.maximum.accumulate(np.where(fresh, np.arange(n + 1), 0))
        best = least + np.arange(n + 1)
        origin = source[lead]
        if i and best.min() > most:
            return most + 1, 0, 0
    end = int(best.argmin())
    return int(best[end]), int(origin[end]), end


@dataclass
class Index:
    """Benchmark items of one shard: words, trigrams and keys of their walks."""

    ids: list[int]
    words: list[np.ndarray]
    rate: float
    walks: int
    seed: int = 5
    #: Items without an edit: by their length, sorted hashes of all their words, and the items.
    whole: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)
    #: By window size: q, the least number of q-grams, the q-grams of the items, and the keys of their walks.
    sizes: dict[int, tuple[int, int, HashSet]] = field(init=False)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self) -> None:
        self.whole, self.sizes, self.keys = {}, {}, {}
        short: dict[int, list[int]] = {}
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if not allowed_edits(len(w), self.rate):
                short.setdefault(len(w), []).append(i)
                continue
            step = int(math.log(len(w)) / math.log(SIZE_STEP) + 1e-9)
            classes.setdefault(min(len(w), math.ceil(SIZE_STEP**step)), []).append(i)
        for n, items in short.items():
            flat = np.array([grams(self.words[i], n)[0] for i in items], np.uint64)
            order = np.argsort(flat, kind="stable")
            self.whole[n] = flat[order], np.array(items)[order]
        for size, items in classes.items():
            edits = max(allowed_edits(len(self.words[i]), self.rate) for i in items)
            q = next((q for q in (3, 2) if intact(size, edits, q) > 0), 1)
            found = np.unique(np.concatenate([grams(self.words[i], q) for i in items]))
            self.sizes[size] = q, max(1, intact(size, edits, q)), HashSet(found)
            symbols = np.concatenate([self.words[i] for i in items])
            ends = np.cumsum([len(self.words[i]) for i in items])
            starts = ends - [len(self.words[i]) for i in items]
            key = walk_keys(symbols, starts, size, ends, self.walks, self.seed)
            flat = key.ravel()
            order = np.argsort(flat, kind="stable")
            self.keys[size] = flat[order], np.repeat(items, key.shape[1])[order]


def _met(keys: np.ndarray, owner: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in mine, owner) of all equal keys; keys are sorted."""
    left = np.searchsorted(keys, mine, side="left")
    count = np.searchsorted(keys, mine, side="right") - left
    at = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.repeat(np.arange(len(mine)), count), owner[at]


def _candidate_windows(shown: np.ndarray, doc_end: np.ndarray, size: int, q: int, least: int) -> np.ndarray:
    """Starts of all windows of so many words that show at least `least` q-grams of the items
    of their size; shown counts them cumulatively."""
    start = np.arange(len(doc_end))
    stop = np.minimum(start + size, doc_end)
    return np.flatnonzero(shown[np.maximum(stop - (q - 1), start)] - shown[start] >= least)


def _matches(words: Words, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item, first word, word after the last, distance) of verified copies in a run."""
    symbols = words.hash
    if not len(symbols) or not index.ids:
        return
    doc_end = words.first[words.row + 1]
    runs: dict[int, np.ndarray] = {}

    def hashed(q: int) -> np.ndarray:
        if q not in runs:
            runs[q] = grams(symbols, q)
        return runs[q]

    hits: set[tuple[int, int, int, int, int]] = set()
    for n, (keys, owner) in index.whole.items():
        at, item = _met(keys, owner, hashed(n))
        for a, i in zip(at.tolist(), item.tolist(), strict=True):
            if a + n <= doc_end[a] and (symbols[a : a + n] == index.words[i]).all():
                hits.add((int(words.row[a]), i, a, a + n, 0))
    found: set[tuple[int, int, int]] = set()
    for size, (keys, owner) in index.keys.items():
        q, least, own = index.sizes[size]
        if len(symbols) < q:
            continue
        place = own.find(hashed(q))
        at = np.flatnonzero((place >= 0) & (words.row[q - 1 :] == words.row[: len(symbols) - q + 1]))
        if not len(at):
            continue
        inside = np.zeros(len(symbols) + 1, np.int64)
        inside[at + 1] = 1
        windows = _candidate_windows(np.cumsum(inside), doc_end, size, q, least)
        for lo in range(0, len(windows), WINDOWS_AT_ONCE):
            start = windows[lo : lo + WINDOWS_AT_ONCE]
            mine = walk_keys(symbols, start, size, doc_end[start], index.walks, index.seed)
            at, item = _met(keys, owner, mine.ravel())
            pairs = np.unique(np.stack([start[at // mine.shape[1]], item]), axis=1)
            found.update((i, s, size) for s, i in pairs.T.tolist())
    done: dict[tuple[int, int], int] = {}
    for item, start, _ in sorted(found):
        row = int(words.row[start])
        if done.get((row, item), -1) > start:
            continue  # this window lies in a copy that is already known
        own = index.words[item]
        most = allowed_edits(len(own), index.rate)
        lo = max(int(words.first[row]), start - most - 4)
        hi = min(int(words.first[row + 1]), start + len(own) + most + 4)
        shown, wanted = np.sort(grams(symbols[lo:hi], 3)), grams(own, 3)
        if intact(len(own), most, 3) > 0:
            there = shown[np.minimum(np.searchsorted(shown, wanted), len(shown) - 1)] == wanted if len(shown) else np.zeros(1)
            if there.sum() < intact(len(own), most, 3):
                continue  # more of the item's trigrams are gone than so many edits can break
        distance, a, b = edit_distance_within(own, symbols[lo:hi], most)
        while 0 < distance <= most:  # a window before or after the copy may show only part of it
            low = max(int(words.first[row]), lo + a - most - 4)
            high = min(int(words.first[row + 1]), lo + a + len(own) + most + 4)
            nearer, c, d = edit_distance_within(own, symbols[low:high], most)
            if nearer >= distance:
                break
            lo, distance, a, b = low, nearer, c, d
        if distance <= most:
            hits.add((row, item, lo + a, lo + b, distance))
            done[row, item] = lo + b
    yield from sorted(hits)


def load_items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[list[int], list[np.ndarray]]:
    table = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).dropna().distinct().toArrow()
    ids, words = [], []
    texts = table["t"].combine_chunks()
    for lo, _, run in text_runs(texts, lower=False):
        found = find_words(fold_case(run))
        for k in range(len(run)):
            own = found.hash[found.first[k] : found.first[k + 1]]
            if len(own):
                ids.append(table["i"][lo + k].as_py())
                words.append(own)
    return ids, words


def find_copies(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.2, recall: float = 0.99,
    shard_bytes: int = 4 << 20,
) -> DataFrame:
    """(doc_id, item_id, start, end, distance, item_words): passages of docs within rate * words word
    edits of a benchmark item; start and end are character offsets in the text, and a text has a row
    for each passage and item.

    Words are runs of letters, digits and characters beyond ASCII, case aside. An item of few words, for
    which rate * words is below 1, counts where it stands as it is. Items without a word, null items
    and null ids of items take no part; null and empty texts have no copies;
    a null doc_id keeps its rows. Repeated rows are searched each. Items are shipped to the executors
    in shards of about shard_bytes of text, dealt by a hash of their ids, and docs
    are searched once for each. An empty table on either side gives no rows. Other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                out = [(ids[row].as_py(), *hit) for row, *hit in _passages(batch.column(1), index)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                columns = zip(*out, strict=True) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "item_id", "start", "end", "distance", "item_words"],
                )

        return rows.mapInArrow(run, "doc_id long, item_id long, start int, end int, distance int, item_words int")

    parts = [search(index) for index in _shards(benchmark, item_col, item_text_col, rate, recall, shard_bytes)]
    return reduce(DataFrame.unionByName, parts)


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = 0.2, recall: float = 0.99, shard_bytes: int = 4 << 20,
) -> DataFrame:
    """docs without the rows whose text holds a passage that find_copies would report; all columns
    stay, nothing is shuffled, and rows that only share an id with such a row stay."""
    place = docs.columns.index(text_col)
    for index in _shards(benchmark, item_col, item_text_col, rate, recall, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _passages(batch.column(place), index)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _shards(benchmark: DataFrame, id_col: str, text_col: str, rate: float, recall: float, most: int) -> Iterator[Index]:
    """Indexes over the items, so many bytes of their text at a time; one at least."""
    size = benchmark.agg(F.sum(F.octet_length(text_col)).alias("n")).head()[0] or 0
    shards = max(1, math.ceil(size / most))
    for shard in range(shards):
        mine = benchmark.filter(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(shards)) == shard) if shards > 1 else benchmark
        yield Index(*load_items(mine, id_col, text_col), rate, walks_for(recall))


def _passages(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item id, start, end, distance, words of the item); offsets count characters."""
    for lo, _, run in text_runs(texts, lower=False, most=RUN_BYTES):
        words = find_words(fold_case(run))
        for row, item, a, b, distance in _matches(words, index):
            s, e = int(words.start[a]), int(words.end[b - 1])
            first = len(run.data[int(run.starts[row]) : s].tobytes().decode())
            yield lo + row, index.ids[item], first, first + len(run.data[s:e].tobytes().decode()), distance, len(index.words[item])
