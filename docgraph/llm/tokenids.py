"""Token ids in flat binary files with 64-bit document offsets."""

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docgraph.llm.files import read_array, write_file
from docgraph.plans.durable import cut, shared_path

#: The id that ends each document.
END = 1
#: Bytes of words and their ids that a worker remembers, with what a dictionary needs for each.
REMEMBERED, ENTRY = 128 << 20, 200
#: Unknown words that are encoded in one call.
TOGETHER = 2_000
#: Bytes of text that one part aims at.
PART_BYTES = 32 << 20
#: Successive parts whose bases are summed together.
GROUP = 4096
#: The largest documents are cut here when ids are turned into bytes, never in the files.
PIECE = 1 << 20

#: A full stop or comma at the end of a word: a piece of its own after a letter or digit.
_TAIL = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n]|\Z)")


def id_type(vocabulary: int) -> str:
    """The narrowest little-endian unsigned type for ids below ``vocabulary``."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def vocabulary_type(spark: SparkSession, tokenizer: str, end: int = END) -> str:
    """The type for a tokenizer's ids; the tokenizer is read by a worker, not by the driver."""

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"size": [len(encoder(tokenizer, "<u4").last)] * len(batch)})

    return id_type(max(end + 1, spark.range(1).mapInPandas(size, "size long").first()[0]))


class Encoder:
    """Encodes texts word by word and remembers words' ids as bytes.

    Only for tokenizers that fold case, drop white space and never join across it, so that a text's ids are its words'
    ids in order. The strings of added tokens are cut out of a text first, as the library does, and give their own ids.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that look at the text around them are not supported")
        self.dtype, self.known, self.held = dtype, {}, 0
        self.special = {t.content: np.array([i], dtype).tobytes() for i, t in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        # What is left of a text has no added token; a word that looks like one after folding is an ordinary word.
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        fresh = words.difference(self.known)
        if self.held > REMEMBERED:
            self.known.clear()
            self.held, fresh = 0, words
        texts = {w: w.decode() for w in fresh}
        plain = [w for w, t in texts.items() if t.isalpha()]
        other = [w for w, t in texts.items() if not t.isalpha()]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            found = self.tokenizer.encode_batch_fast([" ".join([texts[w] for w in part])], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            # Words of letters alone are one piece each, and each piece ends with an id of an end.
            if len(ends) == len(part):
                self._keep(part, ids, ends)
            else:
                other += part
        for at in range(0, len(other), TOGETHER):
            part = other[at : at + TOGETHER]
            found = self.tokenizer.encode([texts[w] for w in part], is_pretokenized=True, add_special_tokens=False)
            self._keep(part, np.array(found.ids, self.dtype), np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))))

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self.held += len(raw) + sum(map(len, words)) + ENTRY * len(words)
        self.known.update(zip(words, (raw[a:b] for a, b in pairwise([0, *(ends * ids.itemsize).tolist()])), strict=True))

    def encode(self, text: str | None) -> bytes:
        """The text's ids, one after the other, in the encoder's type."""
        if not text:
            return b""
        if any(t in text for t in self.special):
            return b"".join(self.special.get(p) or self._plain(p) for p in self.cuts.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = _TAIL.sub(rb" \1", text.encode().lower()).split()
        self.learn(set(words))
        return b"".join(map(self.known.__getitem__, words))


@functools.lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> Encoder:
    """This process's encoder: a worker that runs several tasks loads its tokenizer once."""
    return Encoder(path, dtype)


def _writer(path: str, tokenizer: str, end: int, dtype: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer, dtype).encode, np.array([end], dtype).tobytes()
        part, pieces, ids, ends, nulls, at = TaskContext.get().partitionId(), [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                pieces.append(encode(text.as_py()) + last)
                at += len(pieces[-1]) // len(last)
                ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                ends.append(at)
        if ids:
            name = f"{path}/part-{part:06d}"
            write_file(f"{name}.bin", pieces)
            write_file(f"{name}.len", (np.array(ends, "<u8").tobytes(), np.array(ids, "<i8").tobytes(), np.array(nulls, "<u8").tobytes()))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([at], pa.int64())})

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, dtype: str | None = None) -> DataFrame:
    """Encodes each text of ``docs`` and writes its ids, in ascending id order, to files below ``path``.

    ``part-NNNNNN.bin``: ids as flat little-endian unsigned integers, 16 bits wide if the vocabulary allows, else 32.
    ``part-NNNNNN.idx``: per document the 64-bit offset of its first id in the whole corpus, then one that closes the
    part; ``part-NNNNNN.len``: running lengths, document ids and null flags. ``index.json`` names width and number of parts.
    Parts follow each other in id order; a part's base is the sum of all earlier parts, so there are two passes: one
    over texts, one over parts. A document's ids end with ``end``.

    Null ids come first, equal ids in the order of a hash of their texts; a null text is empty and gets ``end`` alone.
    An empty table writes an index without parts. Returns (part, docs, tokens, base) of each part.
    """
    spark = docs.sparkSession
    dtype = dtype or vocabulary_type(spark, tokenizer, end)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES), min(size >> 20, spark.sparkContext.defaultParallelism))
    spread = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(int(parts), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    # One row for each part, not for each document.
    written = cut(spread.mapInArrow(_writer(path, tokenizer, end, dtype), "part long, docs long, tokens long"))
    held = written.count()
    placed = cut(_dealt(_bases(written), held).mapInPandas(_offsets(path), "part long, docs long, tokens long, base long"))
    write_file(f"{path}/index.json", (json.dumps({"dtype": dtype, "end": end, "parts": held}).encode(),))
    return placed


def _dealt(parts: DataFrame, held: int) -> DataFrame:
    """Small rows with much work each, dealt to as many tasks (a number given by hand is not coalesced), ``GROUP`` at most."""
    return parts.repartition(max(1, min(held, GROUP)), "part")


def _bases(written: DataFrame) -> DataFrame:
    """(part, docs, tokens, base): base is the sum of the tokens of all parts before, in two levels of prefix sums.

    Parts are summed within groups of ``GROUP`` successive ones; only the groups' sums meet in one task (at 100 TB
    some 800 rows).
    """
    group = F.floor(F.col("part") / GROUP).alias("group")
    totals = written.groupBy(group).agg(F.sum("tokens").alias("whole"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("group", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    summed = written.withColumn("group", group).withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return summed.join(totals, "group").select("part", "docs", "tokens", (F.col("start") + F.col("inside")).cast("long").alias("base"))


def _offsets(path: str):
    """Writes the offsets of each part's documents."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                name = f"{path}/part-{row.part:06d}"
                ends = read_array(f"{name}.len", "<u8")[: row.docs]
                write_file(f"{name}.idx", (np.concatenate([[row.base], ends + np.uint64(row.base)]).astype("<u8").tobytes(),))
            yield batch

    return write


def read_tokens(placed: DataFrame, path: str, dtype: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: first id's place, number of ids, CRC-32 of the ids as 32-bit little-endian integers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                name = f"{path}/part-{row.part:06d}"
                ids, starts, known = read_array(f"{name}.bin", dtype), read_array(f"{name}.idx", "<u8").astype(np.int64), read_array(f"{name}.len", "<u8")
                near, crcs = (starts - starts[0]).tolist(), []
                for a, b in zip(near[:-1], near[1:], strict=True):
                    crc = 0
                    for at in range(a, b, PIECE):
                        crc = zlib.crc32(ids[at : min(b, at + PIECE)].astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                doc_ids = pd.array(known[row.docs : 2 * row.docs].view("<i8"), "Int64")
                doc_ids[known[2 * row.docs :].astype(bool)] = pd.NA
                for at in range(0, row.docs, 50_000):
                    to = slice(at, min(at + 50_000, row.docs))
                    yield pd.DataFrame({"doc_id": doc_ids[to], "start": starts[:-1][to], "n_tokens": np.diff(starts)[to], "ids_crc32": crcs[to]})

    return _dealt(placed, placed.count()).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(path: str, part: int, dtype: str) -> list[np.ndarray]:
    """The documents of a part as arrays of ids."""
    ids, starts = read_array(f"{path}/part-{part:06d}.bin", dtype), read_array(f"{path}/part-{part:06d}.idx", "<u8").astype(np.int64)
    return [ids[a:b] for a, b in zip((starts - starts[0])[:-1], (starts - starts[0])[1:], strict=True)]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes token files to the shared folder and reads each document's place and checksum back from them."""
    path, dtype = shared_path(docs.sparkSession, "tokens"), vocabulary_type(docs.sparkSession, tokenizer, end)
    return read_tokens(write_tokens(docs, path, tokenizer, id_col, text_col, end, dtype), path, dtype)
