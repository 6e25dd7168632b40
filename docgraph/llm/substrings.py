"""Substring deduplication with Rabin-Karp hashes of every window of consecutive words.

1. Each batch of documents hashes all its windows and keeps, of each hash, those of the least document (pre-aggregation:
   a window that thousands of documents share leaves a batch once). The others are hits at once.
2. The hashes are dealt out by their high bits, packed as sorted arrays with document and place; for each hash the least
   document of the corpus is found, and windows of batches whose least document is a later one are hits.
3. Hits travel as runs of window starts, are gathered per document and merge into maximal intervals of words.

Windows are compared by 64-bit hashes of 64-bit word hashes: among n distinct windows of a corpus a window is taken for
another with a probability of about n / 2^64 (below one in a million up to 10^13 windows).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

WINDOW = 13
#: An odd multiplier of the rolling hash, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Windows that a task gathers before it deals them out.
GATHERED = 1 << 20
#: Windows that one bucket aims at: 24 bytes each in the task that counts it.
BUCKET_WINDOWS = 5 << 19
#: Characters of text behind a window, for the number of buckets: a window starts at each word.
CHARS_PER_WINDOW = 5
REMEMBERED = 200_000


class WordHashes:
    """Hashes of the words of a text, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 1)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The Rabin-Karp hash of each window: a polynomial of its words' hashes, mixed so that its high bits are even."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + hashes[k : k + len(total)]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of runs, first, last + 1): runs of consecutive places in each document; input in any order."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    starts = np.flatnonzero(begins)
    whose, count = np.unique(doc[starts], return_counts=True)
    return whose, count, place[starts], place[np.append(starts[1:], len(doc)) - 1] + 1


_HITS = ("ids", "ties", "counts", "firsts", "lasts")
_KINDS = ("<i8", "<i8", "<u4", "<u4", "<u4")


def _hit_rows(ids: np.ndarray, ties: np.ndarray, doc: np.ndarray, place: np.ndarray, groups: int, extra: tuple[str, ...] = ()) -> pa.RecordBatch:
    """Packed hits, one row for each group of documents."""
    whose, count, first, last = _runs(doc, place)
    mixed = (ids[whose].view(np.uint64) ^ ties[whose].view(np.uint64)) * np.uint64(BASE)
    group = ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    each = np.repeat(np.arange(len(whose)), count)
    turn = np.argsort(group[each], kind="stable")
    numbers, at = np.unique(group[order], return_index=True)
    cuts = at[1:]
    run_cuts = np.cumsum(np.bincount(np.searchsorted(numbers, group), weights=count, minlength=len(numbers)).astype(np.int64))[:-1]
    columns = (ids[whose[order]], ties[whose[order]], count[order], first[turn], last[turn])
    packed = [[part.astype(kind).tobytes() for part in np.split(c, cuts if k < 3 else run_cuts)] for k, (c, kind) in enumerate(zip(columns, _KINDS, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *[pa.array(c, pa.binary()) for c in packed], *[pa.nulls(len(numbers), pa.binary()) for _ in extra]], ["bucket", *_HITS, *extra])


def _gather(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, held, count = WordHashes(), [], 0
        for batch in batches:
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if doc is not None:
                    found = windows(hashed(words_of(text.as_py())), size)
                    if len(found):
                        held.append((doc, tie, found))
                        count += len(found)
                if count >= GATHERED:
                    yield from _deal(held, buckets)
                    held, count = [], 0
        yield from _deal(held, buckets)

    return run


_DEALT = ("hashes", "spots", "own")


def _deal(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Hits within a batch, and its other windows by bucket."""
    if not held:
        return
    held = list({(doc, tie): (doc, tie, found) for doc, tie, found in sorted(held, key=lambda x: x[:2])}.values())
    ids, ties = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
    hashes = np.concatenate([f for _, _, f in held])
    doc = np.repeat(np.arange(len(held)), [len(f) for _, _, f in held])
    place = np.concatenate([np.arange(len(f)) for _, _, f in held])
    # Stable: equal hashes stay in the order of documents and places.
    order = np.argsort(hashes, kind="stable")
    h, d, p = hashes[order], doc[order], place[order]
    least = ids[d][_first_of(h)]
    again = ids[d] > least
    if again.any():
        yield _hit_rows(ids, ties, d[again], p[again], buckets, _DEALT)
    h, d, p = h[~again], d[~again], p[~again]
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    counts, rows = np.array([len(f) for _, _, f in held]), []
    for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
        # A window's place among all windows of the row's documents tells its document and its place there.
        own, rank = np.unique(d[a:b], return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(counts[own])])
        rows.append((int(bucket[a]), _pack_sorted(h[a:b]), _pack_spots(begins[rank] + p[a:b]), _pack_documents(ids[own], ties[own], counts[own])))
    for at in range(0, len(rows), 256):
        part = list(zip(*rows[at : at + 256], strict=True))
        none = pa.nulls(len(part[0]), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *[none] * len(_HITS), *[pa.array(c, pa.binary()) for c in part[1:]]], ["bucket", *_HITS, *_DEALT])


def _first_of(sorted_values: np.ndarray) -> np.ndarray:
    """For each place in a sorted array the place of its first equal value."""
    first = np.ones(len(sorted_values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _pack_small(values: np.ndarray) -> bytes:
    """16 bits a value where that is enough, else 32; the first byte tells."""
    wide = len(values) and int(values.max()) >= 1 << 16
    return (b"\4" if wide else b"\2") + values.astype("<u4" if wide else "<u2").tobytes()


def _pack_spots(values: np.ndarray) -> bytes:
    """24 bits a value where that is enough, else 32; the first byte tells."""
    wide = 4 if len(values) and int(values.max()) >= 1 << 24 else 3
    return bytes([wide]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def _unpack_spots(packed: bytes) -> np.ndarray:
    wide = packed[0]
    out = np.zeros(((len(packed) - 1) // wide, 4), np.uint8)
    out[:, :wide] = np.frombuffer(packed, np.uint8, -1, 1).reshape(-1, wide)
    return out.view("<u4").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: the first, then the steps of the high halves (16 bits where that is enough), then the low halves."""
    high, low = values >> np.uint64(32), (values & np.uint64(0xFFFFFFFF)).astype("<u4")
    return values[:1].astype("<u8").tobytes() + _pack_small(np.diff(high, prepend=high[:1])) + low.tobytes()


def _unpack_sorted(packed: bytes) -> np.ndarray:
    wide = 4 if packed[8] == 4 else 2
    n = (len(packed) - 9) // (wide + 4)
    steps = np.frombuffer(packed, "<u4" if wide == 4 else "<u2", n, 9)
    high = np.cumsum(steps, dtype=np.uint64) + (np.frombuffer(packed, "<u8", 1)[0] >> np.uint64(32))
    return high << np.uint64(32) | np.frombuffer(packed, "<u4", n, 9 + wide * n)


def _pack_documents(ids: np.ndarray, ties: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids as the first and the steps, their windows' numbers, and ties only if there are any."""
    steps = np.diff(ids, prepend=ids[:1])
    tied = bool(ties.any())
    wide = 8 if int(steps.max()) >= 1 << 32 else 4 if int(steps.max()) >= 1 << 16 else 2
    many = 4 if int(counts.max()) >= 1 << 16 else 2
    head = bytes([wide, many, tied]) + np.array([len(ids), ids[0]], "<i8").tobytes()
    return head + steps.astype(f"<u{wide}").tobytes() + counts.astype(f"<u{many}").tobytes() + (ties.astype("<i8").tobytes() if tied else b"")


def _unpack_documents(packed: bytes) -> np.ndarray:
    """Three rows: ids, ties and numbers of windows."""
    wide, many, tied = packed[:3]
    n, first = np.frombuffer(packed, "<i8", 2, 3).tolist()
    ids = np.cumsum(np.frombuffer(packed, f"<u{wide}", n, 19).astype(np.int64)) + first
    counts = np.frombuffer(packed, f"<u{many}", n, 19 + wide * n).astype(np.int64)
    return np.stack([ids, np.frombuffer(packed, "<i8", n, 19 + (wide + many) * n) if tied else np.zeros(n, np.int64), counts])


def _count(groups: int):
    def run(table: pa.Table) -> pa.Table:
        """Hits of one bucket: windows whose hash has a document with a smaller id; a batch's own hits pass."""
        passed = table.filter(pa.compute.is_valid(table.column("ids"))).select(["bucket", *_HITS])
        blobs = table.filter(pa.compute.is_valid(table.column("own"))).select(list(_DEALT)).to_pylist()
        if not blobs:
            return passed
        hashes = np.concatenate([_unpack_sorted(b["hashes"]) for b in blobs])
        # Batches one after the other: documents, and windows, are numbered through.
        spots, docs, windows_before = [], [], 0
        for b in blobs:
            documents = _unpack_documents(b["own"])
            spots.append(_unpack_spots(b["spots"]).astype(np.int64) + windows_before)
            docs.append(documents)
            windows_before += int(documents[2].sum())
        ids, ties, counts = np.concatenate(docs, axis=1)
        begins = np.concatenate([[0], np.cumsum(counts)])
        spots = np.concatenate(spots)
        doc = (np.searchsorted(begins, spots, "right") - 1).astype(np.uint32)
        place = (spots - begins[doc]).astype(np.uint32)
        order = np.argsort(hashes, kind="stable")
        h, d, p = hashes[order], doc[order], place[order]
        # The unsorted arrays are as large as the sorted ones.
        del blobs, hashes, docs, spots, doc, place, order
        first = _first_of(h)
        least = np.minimum.reduceat(ids[d], np.unique(first)) if len(h) else ids[:0]
        again = ids[d] > np.repeat(least, np.diff(np.append(np.unique(first), len(h))))
        if not again.any():
            return passed
        return pa.concat_tables([pa.Table.from_batches([_hit_rows(ids, ties, d[again].astype(np.int64), p[again].astype(np.int64), groups)]), passed])

    return run


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        """One row for each document of a group: its maximal intervals of words under hit windows."""
        ids, ties, counts, firsts, lasts = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(c)]) for c, kind in zip(_HITS, _KINDS, strict=True))
        whose = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((firsts, ties[whose], ids[whose]))
        i, t = ids[whose][order], ties[whose][order]
        start, end = firsts[order].astype(np.int64), lasts[order].astype(np.int64) + size - 1
        fresh = np.ones(len(i), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
        # The furthest end so far within a document: shift each document beyond all ends before it.
        shift = np.cumsum(fresh) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + shift) - shift
        opens = fresh.copy()
        opens[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(opens)
        close = reach[np.append(at[1:], len(i)) - 1]
        docs = np.flatnonzero(fresh[at])
        offsets = pa.array(np.append(docs, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (start[at], close)]
        return pa.table([pa.array(i[at][docs]), pa.array(t[at][docs]), *lists], ["id", "tie", "starts", "ends"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts words and joins those outside the intervals."""
    for batch in batches:
        ids, texts, starts, ends = (batch.column(k) for k in range(4))
        for at in range(0, len(ids), 500):
            numbers, removed, spans, kept = [], [], [], []
            for text, a, b in zip(texts[at : at + 500], starts[at : at + 500], ends[at : at + 500], strict=True):
                words, cuts = words_of(text.as_py()), list(zip(a.as_py() or (), b.as_py() or (), strict=True))
                rest, here = [], 0
                for start, end in cuts:
                    rest += words[here:start]
                    here = end
                rest += words[here:]
                numbers.append(len(words))
                removed.append(len(words) - len(rest))
                spans.append([{"start": x, "end": y} for x, y in cuts])
                kept.append(b" ".join(rest))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids[at : at + 500], pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])


def intervals(docs: DataFrame, size: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(id, tie, starts, ends) for rows (id, tie, text): maximal intervals of words under windows that also start in a document with a smaller id.

    tie tells texts of equal id apart. Documents without such windows have no row.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(16, -(-chars // (CHARS_PER_WINDOW * bucket_windows))))
    names = [*_HITS, *_DEALT]
    dealt = docs.select("id", "tie", "text").mapInArrow(_gather(size, buckets), "bucket long, " + ", ".join(f"{n} binary" for n in names))
    found = dealt.groupBy("bucket").applyInArrow(_count(buckets), "bucket long, " + ", ".join(f"{n} binary" for n in _HITS))
    return found.groupBy("bucket").applyInArrow(_merge(size), "id long, tie long, starts array<long>, ends array<long>")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for each row of ``docs``; other columns are not read.

    Removes each word under a window of ``size`` words whose sequence also starts in a document with a smaller id;
    windows are judged on the input. spans: maximal removed intervals of words [start, end); kept: the other words,
    joined by a space. Words stand between ASCII white space and count unchanged. A null text has no words; rows with
    a null id neither remove nor lose words; rows of equal id do not remove each other's words. Texts shorter than a
    window stay. An empty table gives no rows.
    """
    key = F.col(id_col).cast("long")
    # Texts of equal id are told apart by a hash; only where there are any.
    repeated = bool(docs.groupBy(key.alias("id")).agg(F.count("*").alias("n")).filter("n > 1 and id is not null").take(1))
    rows = docs.select(key.alias("id"), (F.xxhash64(F.col(text_col)) if repeated else F.lit(0).cast("long")).alias("tie"), F.col(text_col).alias("text"))
    found = intervals(rows, size)
    met = rows.join(found, ["id", "tie"], "left").select("id", "text", "starts", "ends")
    return met.mapInArrow(_cut_out, "id long, n_words long, n_removed long, spans array<struct<start long, end long>>, kept string").withColumnRenamed("id", id_col)
