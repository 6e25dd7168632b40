"""Benchmark decontamination by template windows and slot consistency.

A text becomes a sequence of canonical tokens: numbers, units (after a number) and names (runs of capitalised words
inside a sentence) turn into typed placeholders, other words lose their case. A second form keeps names as words, so
that an item is found whose case was changed. Windows of canonical tokens are hash-joined with those of the benchmark.
Windows with too few plain words are joined too, but by their words, numbers and units as they stand.

Where a window of an item meets a text, the item is aligned with the text around it: matching tokens count one, each
token that is left out on either side costs ``GAP``, so words that were put in, dropped or replaced move the rest but do
not hide it. An alignment counts if it covers enough of the item, or a long run of its tokens, and if the slots' values
are consistent: wherever the item repeats a value, so does the document.
"""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from docgraph.llm.substrings import windows

WINDOW = 6
#: Words of a window that must not be placeholders.
LITERAL = 3
#: What an alignment pays for a token without a partner.
GAP = 0.5
#: Characters of texts that are looked at together.
TOGETHER = 1 << 18
#: Share of an item's tokens that an alignment covers at least.
COVERAGE = 0.5
#: Or: tokens in a row that agree, and how many of them must be plain words.
RUN, RUN_LITERAL = 13, 8
#: Share of the aligned slots that keep to one value for one value.
CONSISTENT = 0.8
#: Template windows that are sent to the workers at once (16 bytes each); a larger benchmark goes in blocks.
BLOCK = 1_000_000
REMEMBERED = 200_000

NUMBER, UNIT, NAME = 1, 2, 3
_SLOTS = {NUMBER: b"<number>", UNIT: b"<unit>", NAME: b"<name>"}
#: Stands between texts that are looked at together; in a text it is white space.
BREAK = "\x1e"
_TOKEN = re.compile(r"[^\W_]+(?:[.,'’][^\W_]+)*|[.!?:\n\x1e]")
_NUMERIC = re.compile(r"\d[\d.,]*(?:st|nd|rd|th)?")
_ENDS = frozenset(".!?:\n")
# Units that may follow a number.
UNITS = frozenset("cm mm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ton tons l ml liter liters litre litres s sec min h hr ms second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur kmh mph hz khz mhz ghz kb mb gb tb w kw v".split())


def _hash(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value, 3)


@dataclass
class Form:
    """A sequence of canonical tokens: hash and slot type (0: a plain word) of each, and where in the words it begins."""

    hashes: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    words: list[str]

    def value(self, i: int) -> str:
        """The words behind a token, as they stand but for case."""
        end = int(self.starts[i + 1]) if i + 1 < len(self.starts) else len(self.words)
        return " ".join(self.words[int(self.starts[i]) : end]).lower()


class _Rows(dict):
    """Row of each token, found when it is first met; a bounded memory."""

    def __init__(self, find: Callable[[str], int]):
        self.find = find

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        row = self[token] = self.find(token)
        return row


class Canon:
    """Tokens and canonical hashes of texts, with a bounded memory of words.

    With a ``vocabulary`` (lower-case words) all other words get one hash, which is in no window of the vocabulary's items.
    """

    #: Rows of the table of facts that every canon begins with: an end of a sentence, a number, other words, a break between texts.
    END, NUM, OTHER, CAPITAL, NEXT = range(5)

    def __init__(self, vocabulary: set[str] | None = None):
        self.vocabulary, other, number, between = vocabulary, _hash(b"<other>"), _hash(_SLOTS[NUMBER]), _hash(b"<break>")
        self.known = _Rows(self._row)
        self.rows: dict[tuple[str, bool], int] = {}
        # Of each row: the hash as a word, whether it is a unit, whether it is capitalised, whether it is a number, the hash as it stands.
        self.facts: list[tuple[int, bool, bool, bool, int]] = [(0, False, False, False, 0), (number, False, False, True, other), (other, False, False, False, other), (other, False, True, False, other), (between, False, False, False, between)]
        self.table: list[np.ndarray] = []

    def _row(self, token: str) -> int:
        word = token.lower()
        if self.vocabulary is not None and word not in self.vocabulary and word not in UNITS:
            if token in _ENDS:
                return self.END
            if token == BREAK:
                return self.NEXT
            if token[0].isdigit() and _NUMERIC.fullmatch(token):
                return self.NUM
            return self.CAPITAL if token[0].isupper() else self.OTHER
        if token in _ENDS or token == BREAK:
            return self.END if token in _ENDS else self.NEXT
        if token[0].isdigit() and _NUMERIC.fullmatch(token):
            return self._fact(word, False, (*self.facts[self.NUM][:4], _hash(word.encode())))
        capital = token[0].isupper()
        return self._fact(word, capital, (_hash(word.encode()), word in UNITS, capital, False, _hash(word.encode())))

    def _fact(self, word: str, capital: bool, fact: tuple) -> int:
        if (word, capital) not in self.rows:
            self.rows[word, capital] = len(self.facts)
            self.facts.append(fact)
        return self.rows[word, capital]

    def __call__(self, texts: list[str | None]) -> tuple[Form, Form, np.ndarray | None, np.ndarray]:
        """(form with names as placeholders, form with names as words, hashes of words as they stand, places of breaks).

        Texts stand one after the other, with a break after each. The hashes are None if no number of the vocabulary
        is there; they belong to the second form, which has a token for each word.
        """
        tokens = _TOKEN.findall("".join([(t or "").replace(BREAK, " ") + BREAK for t in texts]))
        rows = np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens))
        if not self.table or len(self.table[0]) < len(self.facts):
            self.table = [np.array([f[k] for f in self.facts], kind) for k, kind in enumerate((np.uint64, bool, bool, bool, np.uint64))]
        ends = rows == self.END
        begins = np.ones(len(rows), bool)
        begins[1:] = ends[:-1] | (rows[:-1] == self.NEXT)
        number = self.table[3][rows]
        after_number = np.zeros(len(rows), bool)
        after_number[1:] = number[:-1]
        keep = np.flatnonzero(~ends)
        words = tokens if len(keep) == len(tokens) else [tokens[i] for i in keep.tolist()]
        rows, begins, after_number, number = rows[keep], begins[keep], after_number[keep], number[keep]
        word, unit, capital = (c[rows] for c in self.table[:3])
        kind = np.where(number, NUMBER, np.where(unit & after_number, UNIT, np.where(capital & ~begins, NAME, 0)))
        word[kind == UNIT] = _hash(_SLOTS[UNIT])
        name = kind == NAME
        first = np.ones(len(rows), bool)
        first[1:] = ~(name[1:] & name[:-1])
        starts = np.flatnonzero(first)
        named = np.where(name, np.uint64(_hash(_SLOTS[NAME])), word)[starts]
        literal = self.table[4][rows] if (number & (rows != self.NUM)).any() else None
        return Form(named, kind[starts], starts, words), Form(word, np.where(name, 0, kind), np.arange(len(rows)), words), literal, np.flatnonzero(rows == self.NEXT)


def _usable(kind: np.ndarray, size: int) -> np.ndarray:
    """Windows with enough plain words: ``LITERAL``, or half of a shorter window."""
    plain = np.concatenate([[0], np.cumsum(kind == 0)])
    return plain[size:] - plain[:-size] >= min(LITERAL, (size + 1) // 2)


@dataclass
class _Side:
    """A form's hashes, values and slot types, ready to be aligned; ``begins``: where each token begins in its text's words."""

    hashes: np.ndarray
    values: list[str]
    valued: np.ndarray
    kinds: np.ndarray
    begins: np.ndarray


def _side(form: Form, low: int, high: int, origin: int = 0) -> _Side:
    values = [form.value(i) for i in range(low, high)]
    return _Side(form.hashes[low:high], values, np.array([_hash(v.encode()) for v in values], np.uint64), form.kinds[low:high], form.starts[low:high] - origin)


def align(item: _Side, text: _Side, exact: bool = False) -> list[tuple[int, int]]:
    """(item's token, text's token) of the best local alignment that match; with ``exact`` only tokens that are the same as they stand do."""
    n, m = len(item.values), len(text.values)
    same = item.valued[:, None] == text.valued[None, :]
    if not exact:
        same |= item.hashes[:, None] == text.hashes[None, :]
    ramp = GAP * np.arange(m + 1)
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        row = best[i]
        row[1:] = np.maximum(best[i - 1, :-1] + np.where(same[i - 1], 1.0, -2 * GAP), best[i - 1, 1:] - GAP)
        np.maximum(row, 0, out=row)
        # A gap in the item: the best so far in the row, less what the way from there costs.
        row[:] = np.maximum.accumulate(row + ramp) - ramp
    i, j = divmod(int(best.argmax()), m + 1)
    pairs = []
    while i and j and best[i, j] > 0:
        if same[i - 1, j - 1] and abs(best[i, j] - best[i - 1, j - 1] - 1) < 1e-6:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(best[i, j] - best[i - 1, j] + GAP) < 1e-6:
            i -= 1
        elif abs(best[i, j] - best[i, j - 1] + GAP) < 1e-6:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return pairs[::-1]


class Templates:
    """The template windows of a block of items: sorted hashes with item and place, one table for each window length and form.

    Exact windows are those with too few plain words; they have a number, so texts without an item's number skip them.
    """

    NAMED, PLAIN, EXACT = range(3)

    def __init__(self, items: list[tuple[int, str | None]]):
        canon, self.items, self.vocabulary, tables = Canon(), {}, set(), {}
        for item, text in items:
            named, plain, literal, _ = canon([text])
            # The last token is the break.
            many = len(plain.words) - 1
            if not many:
                continue
            self.vocabulary.update(w.lower() for w in plain.words[:-1])
            self.items[item] = tuple(_side(Form(f.hashes[:-1], f.kinds[:-1], f.starts[:-1], f.words[:-1]), 0, len(f.hashes) - 1) for f in (named, plain))
            for form, side in ((self.NAMED, self.items[item][0]), (self.PLAIN, self.items[item][1])):
                size = min(WINDOW, len(side.values))
                usable = np.flatnonzero(_usable(side.kinds, size))
                tables.setdefault((size, form), []).append((windows(side.hashes, size)[usable], np.full(len(usable), item), usable))
            size = min(WINDOW, many)
            slotted = np.flatnonzero(~_usable(self.items[item][1].kinds, size))
            if len(slotted):
                tables.setdefault((size, self.EXACT), []).append((windows(literal[:-1], size)[slotted], np.full(len(slotted), item), slotted))
        self.tables = {}
        for key, parts in tables.items():
            keys, owner, place = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            # Which low bits of hashes occur at all: tells most other hashes apart at once.
            some = np.zeros(1 << 22, bool)
            some[(keys & np.uint64(len(some) - 1)).astype(np.int64)] = True
            self.tables[key] = keys[order], owner[order], place[order], some

    def canon(self) -> Canon:
        """For texts that are compared with these items."""
        return Canon(self.vocabulary)

    def search(self, canon: Canon, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, float, float, bool]]:
        """(text's place in the list, item, first and last word, coverage, consistency, verbatim) of each item that a text contains."""
        start = held = 0
        for k, text in enumerate([*texts, None]):
            if k > start and (held > TOGETHER or k == len(texts)):
                yield from ((start + t, *found) for t, *found in self._search(canon, texts[start:k]))
                start, held = k, 0
            held += len(text or "")

    def _search(self, canon: Canon, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, float, float, bool]]:
        named, plain, literal, breaks = canon(texts)
        forms = {self.NAMED: (named, named.hashes), self.PLAIN: (plain, plain.hashes), self.EXACT: (plain, literal)}
        # Of each text, item and form: where in the form's tokens the item would begin.
        met: dict[tuple[int, int, int], list[int]] = {}
        for (size, kind), (keys, owner, place, some) in self.tables.items():
            form, hashes = forms[kind]
            if hashes is None:
                continue
            own = windows(hashes, size)
            spots = np.flatnonzero(some[(own & np.uint64(len(some) - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, own[spots]), np.searchsorted(keys, own[spots], "right")
            spots, low, high = spots[low < high], low[low < high], high[low < high]
            which = np.searchsorted(breaks, form.starts[spots])
            for text, spot, a, b in zip(which.tolist(), spots.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(a, b):
                    met.setdefault((text, int(owner[k]), kind), []).append(spot - int(place[k]))
        best: dict[tuple[int, int], tuple] = {}
        for (text, item, kind), spots in met.items():
            form = forms[kind][0]
            origin = int(breaks[text - 1]) + 1 if text else 0
            bounds = np.searchsorted(form.starts, [origin, int(breaks[text])]).tolist()
            for found in self._found(self.items[item][0 if kind == self.NAMED else 1], form, sorted(set(spots)), *bounds, origin, kind == self.EXACT):
                if (text, item) not in best or found[2:4] > best[text, item][2:4]:
                    best[text, item] = found
        for (text, item), found in sorted(best.items()):
            yield text, item, *found

    @staticmethod
    def _found(item: _Side, form: Form, spots: list[int], low: int, high: int, origin: int, exact: bool) -> Iterator[tuple[int, int, float, float, bool]]:
        """Alignments that count, around each place where the item would begin; a place that lies well inside an earlier one's stretch has been looked at."""
        n, done = len(item.values), None
        for spot in spots:
            if done is not None and spot <= done:
                continue
            done = spot + n
            text = _side(form, max(low, spot - n), min(high, spot + 3 * n), origin)
            if found := _judged(item, text, align(item, text, exact)):
                yield found


def _long_run(item: _Side, pairs: list[tuple[int, int]]) -> bool:
    """Whether some ``RUN`` successive tokens of both match and enough of them are plain words."""
    at = np.array(pairs).reshape(-1, 2)
    if len(at) < RUN:
        return False
    plain = np.concatenate([[0], np.cumsum(item.kinds[at[:, 0]] == 0)])
    straight = (at[RUN - 1 :] - at[: len(at) - RUN + 1] == RUN - 1).all(axis=1)
    return bool((straight & (plain[RUN:] - plain[:-RUN] >= RUN_LITERAL)).any())


def _judged(item: _Side, text: _Side, pairs: list[tuple[int, int]]) -> tuple[int, int, float, float, bool] | None:
    """(first and last word, coverage, consistency, verbatim), or None if the alignment does not count."""
    covered = len(pairs) / len(item.values)
    if not pairs or (covered < COVERAGE and not _long_run(item, pairs)):
        return None
    slots = [(int(item.kinds[i]), item.values[i], text.values[j]) for i, j in pairs if item.kinds[i]]
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    kept = sum(there.setdefault((k, a), b) == b and back.setdefault((k, b), a) == a for k, a, b in slots)
    consistent = kept / len(slots) if slots else 1.0
    if consistent < CONSISTENT:
        return None
    (_, first), (_, last) = pairs[0], pairs[-1]
    verbatim = covered == 1.0 and last - first == len(pairs) - 1 and all(item.values[i] == text.values[j] for i, j in pairs)
    return int(text.begins[first]), int(text.begins[last]) + text.values[last].count(" "), covered, consistent, verbatim


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of at most ``BLOCK`` template windows (an item alone may have more)."""
    block, held = [], 0
    for item, text in benchmark.toLocalIterator():
        size = len(text or "") // 2
        if block and held + size > BLOCK:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += size
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, first_token, last_token, coverage, consistency, verbatim): one row for each document and item that it contains.

    Other documents have no row. Texts that differ from an item in numbers, units or names only, consistently, count;
    ``verbatim`` tells whether all slots have the item's own values. Verbatim copies of items full of
    numbers and units count as well. Items shorter than a window match as a whole; empty
    items and null texts match nothing; null item ids are ignored. Repeated rows give repeated rows. The benchmark is
    joined in blocks of bounded size, each of which a worker holds as a hash table.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item_id long, first_token long, last_token long, coverage double, consistency double, verbatim boolean"
    out = None
    for block in _blocks(benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)).filter(F.col(item_col).isNotNull())):
        part = rows.mapInPandas(_finder(block, kind), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def _finder(block: list, kind: str):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(block)
        canon = templates.canon()
        for batch in batches:
            found = list(templates.search(canon, batch["text"].tolist()))
            if found:
                out = pd.DataFrame(found, columns=["k", "item_id", "first_token", "last_token", "coverage", "consistency", "verbatim"])
                out.insert(0, "id", batch["id"].iloc[out.pop("k")].to_numpy())
                yield out

    return find


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts contain no item; rows are judged one by one, in one pass, without a shuffle."""
    out = docs
    for block in _blocks(benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)).filter(F.col(item_col).isNotNull())):
        out = out.filter(~_contains(block)(F.col(text_col)))
    return out


def _contains(block: list):
    @F.pandas_udf("boolean")
    def contains(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        templates = Templates(block)
        canon = templates.canon()
        for batch in texts:
            out = np.zeros(len(batch), bool)
            out[[k for k, *_ in templates.search(canon, batch.tolist())]] = True
            yield pd.Series(out)

    return contains
