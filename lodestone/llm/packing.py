"""Packing by power-of-two decomposition.

A document's token ids, with the end id, are cut into the pieces that its length's binary
form names: as many pieces of ``max_tokens`` as fit, then one piece for each set bit of
the rest, the largest first. Every piece is a sequence of its own, so no sequence crosses
documents and none has padding; pieces of the same length form a bucket. A sequence's id
tells its bucket: ``sequence_id >> BUCKET_SHIFT`` is the exponent of its length, so each bucket
is one range of ids.

Token ids come from a `tokenizers` file. White space separates that tokenizer's words, so
each task keeps a bounded cache from word to ids; texts are cut into numbered distinct words
in Arrow, where the words' ids are also joined by position.

One pass without a shuffle, so rows come in document order. Sequence ids are the bucket (high
bits), the task's number and a counter: unique, and the same each time for the same input splits.

Edge cases: a null or empty text is the end id alone (one piece of length 1); repeated
rows and null ids get sequences of their own; a text of any length is one row's worth of
memory; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.llm.common import WORKER_CACHES, offsets, steps, table

MAX_TOKENS, END_ID = 4096, 2
ENCODE_BYTES = 6 << 20  # of texts whose distinct words are looked up together
BUCKET_SHIFT, TASK_SHIFT = 57, 33  # of a sequence id: exponent of the length, task's number, counter
#: Letters whose lower case may depend on their neighbours or on the library: left to the tokenizer.
_FOREIGN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Marks that behind a word of letters are, together, a pre-token of their own.
_MARKS = ".,;:!?#$%&()*+-/=@[]^_`{}~\""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """ids of texts through a bounded cache of words; ``path``: a tokenizers file whose words
    white space separates and whose normaliser lowers letters one by one.

    Marks behind a word of letters are a pre-token of their own, so only its letters need
    the tokenizer; many words of letters are encoded in one call. Ids are kept as bytes (unsigned
    32-bit, little-endian), which join fast."""

    def __init__(self, path: str, most: int = 900_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    def _each(self, found: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(found, add_special_tokens=False)]

    def _letters(self, found: list[str]) -> list[bytes]:
        """The ids of words of letters only, from one call where each word is one pre-token."""
        e = self.tokenizer.encode(" ".join(found), add_special_tokens=False)
        of = np.array(e.word_ids, dtype=float)
        if len(of) and not np.isnan(of).any() and of[-1] == len(found) - 1 and (np.diff(of) >= 0).all():
            ids, cuts = np.array(e.ids, dtype="<u4").tobytes(), (np.searchsorted(of, np.arange(len(found) + 1)) * 4).tolist()
            return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self._each(found)

    def _make_room(self) -> None:
        """Words with end marks are cheap to make again, so they go first."""
        if len(self.known) > self.most:
            self.known = {w: ids for w, ids in self.known.items() if w.isalpha()}
            if len(self.known) > self.most * 3 // 4:
                self.known = {}

    def _of_words(self, found: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        self._make_room()
        known, own = self.known, {}
        had = list(map(known.get, found))
        fresh = [w for w, x in zip(found, had, strict=True) if x is None]
        if not fresh:
            return had
        cores = {w: c for w in fresh if len(w) <= self.longest and (c := w.rstrip(_MARKS)).isalpha()}
        letters = list(set(cores.values()).difference(known))
        for at in range(0, len(letters), 4000):
            some = letters[at : at + 4000]
            known.update(zip(some, self._letters(some), strict=True))
        marks = list({w[len(c) :] for w, c in cores.items()}.difference(known))
        known.update(zip(marks, self._each(marks), strict=True))
        known.update((w, known[c] + known[w[len(c) :]]) for w, c in cores.items() if len(c) < len(w))
        rest = [w for w in fresh if w not in cores]
        for at in range(0, len(rest), 4000):
            for w, ids in zip(rest[at : at + 4000], self._each(rest[at : at + 4000]), strict=True):
                (known if len(w) <= self.longest else own)[w] = ids
        return [(own[w] if w in own else known[w]) if x is None else x for w, x in zip(found, had, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = (t if _FOREIGN.search(t) else t.lower() for t in texts)
        cut = pc.split_pattern(pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in plain], pa.large_string()), " ")
        numbered = cut.flatten().dictionary_encode()
        ids = pa.array(self._of_words(numbered.dictionary.to_pylist()), pa.large_binary()).take(numbered.indices)
        data, bounds = ids.buffers()[2], offsets(ids)[cut.offsets.to_numpy()].tolist()
        data = b"" if data is None else memoryview(data)
        return [bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder; its cache serves all tasks that the worker runs."""
    kept = WORKER_CACHES.get("packing")
    if kept is None or kept[0] != path:
        kept = WORKER_CACHES["packing"] = (path, WordEncoder(path))
    return kept[1]


def pieces(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``most`` is a power of two."""
    out = [(at, most) for at in range(0, n - n % most, most)]
    at, rest = n - n % most, n % most
    for bit in range(most.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder, base, count = encoder_of(path), TaskContext.get().partitionId() << TASK_SHIFT, 0
        for batch, texts, _ in steps(batches, limit=ENCODE_BYTES, cache="packing"):
            source, cols, ids = [], [], []
            for row, found in enumerate(encoder.encode(texts.to_pylist())):
                whole = found + end
                total = len(whole) // 4
                for start, length in pieces(total, max_tokens):
                    piece = whole[4 * start : 4 * (start + length)]
                    source.append(row)
                    cols.append((start, length, zlib.crc32(piece), total, (length.bit_length() - 1 << BUCKET_SHIFT) + base + count, 0))
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<i4"))
                    count += 1
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*cols, strict=True))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
