"""BPE encoding and decoding through a table of distinct words.

1. **Split.** Texts are cut into words (a run of white space with the run of other
   characters behind it; no token crosses such a cut). A block (a bounded part of a task's
   texts) numbers its distinct words by first occurrence; they go to buckets by their hash.
2. **Table.** Each bucket sees the words of all blocks once and encodes each distinct
   word exactly once with the tokenizer.
3. **Join back by position.** A second pass sends each document as the packed numbers of
   its words to its block's ids; numbers are replaced by ids in order.
4. **Decode** by a join of the ids of a block's distinct words to the id-to-piece table (one
   row per vocabulary entry, so of a bounded size); decoded words go back by position as ids do.

Words travel once per block, compressed, not once per occurrence; a word that is
everywhere costs one entry per block, spread over the input's blocks. Buckets grow with
the input (from the plan's size), so a task's part of the table stays bounded.

Edge cases: a null or empty text has no tokens; special tokens' strings in a text are
special tokens, as in the library's default; a stretch around white space beyond ASCII, whose
cuts depend on the library, stays one word; long words are cut behind ideographic marks; repeated rows and null ids are kept as they are; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import number_rows, offsets, steps, table

BLOCK_BYTES = 32 << 20
#: White space that is not ASCII, or that libraries see differently: such texts are cut with care.
_OTHER = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_OTHER_SPACE = re.compile(f"[{_OTHER}]")
_BLANKS = " \t\n\r\x0b\x0c"
_WORD = re.compile(f"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+")
#: Blanks behind other white space belong to one run with it, so no cut is made there.
_CAREFUL_WORD = re.compile(f"[{_BLANKS}]*(?:[^{_BLANKS}{_OTHER}]|[{_OTHER}]+[{_BLANKS}]*)+|[{_BLANKS}]+")
#: In scripts without blanks: between one of these marks and a letter or number every token ends.
_MARKS = re.compile("(?<=[\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\u300c\u300d\u2026])(?=[^\\W_])")
LONG = 64  # characters of a word that is cut at marks
_SIMPLE = re.compile(" [^\\s\x1c-\x1f\x85<]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(4)
def id_to_piece(path: str) -> pa.Table:
    """id and piece (bytes) of each vocabulary entry: the byte-level alphabet maps 256 printable characters to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    with open(path, encoding="utf-8") as f:
        added = {t["id"]: t["content"].encode() for t in json.load(f).get("added_tokens", [])}
    pieces = [added[i] if i in added else bytes(chars[c] for c in piece) for piece, i in vocabulary.items()]
    return pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(pieces, pa.binary())})


def decode_ids(ids: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """The bytes of the ids' pieces, one after the other, and where each begins (and the last ends):
    a join with the id-to-piece table, put in order by position."""
    at = pa.table({"id": pa.array(ids.astype(np.int32)), "at": pa.array(np.arange(len(ids)))})
    pieces = at.join(id_to_piece(path), "id", join_type="inner", use_threads=False).sort_by("at").column("piece")
    pieces = pa.concat_arrays([c.cast(pa.large_binary()) for c in pieces.chunks]) if pieces.num_chunks else pa.array([], pa.large_binary())
    if len(pieces) != len(ids):
        raise ValueError("ids that the vocabulary does not have")
    return (pieces.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), offsets(pieces)


def split_words(text: str) -> list[str]:
    """The words of a text; joined they are the text."""
    found = (_CAREFUL_WORD if _OTHER_SPACE.search(text) else _WORD).findall(text)
    if text.isascii() or max(map(len, found)) <= LONG:
        return found
    return [part for w in found for part in ([w] if len(w) <= LONG else _MARKS.split(w))]


def encode_words(path: str, found: list[str]) -> list[bytes]:
    """ids (unsigned 32-bit, little-endian) of each word. Simple ones share a call."""
    t, out = tokenizer(path), {}
    simple = [w for w in found if _SIMPLE.fullmatch(w)]
    for at in range(0, len(simple), 4000):
        some = simple[at : at + 4000]
        e = t.encode("".join(some), add_special_tokens=False)
        ends = np.cumsum([len(w) for w in some])
        starts = np.array([o[0] for o in e.offsets], dtype=np.int64)
        cuts = [0, *(np.searchsorted(starts, ends) * 4).tolist()]
        ids = np.array(e.ids, dtype="<u4").tobytes()
        out.update(zip(some, (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
    rest = [w for w in found if w not in out]
    for at in range(0, len(rest), 4000):
        some = rest[at : at + 4000]
        out.update(zip(some, (np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch(some, add_special_tokens=False)), strict=True))
    return [out[w] for w in found]


def _pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_pieces(codes: list[int], parts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(numbers as differences, lengths, bytes), each compressed."""
    return (_pack_numbers(np.diff(np.array(codes, dtype=np.int64), prepend=0)), _pack_numbers(np.array([len(p) for p in parts], dtype=np.int64)),
            zlib.compress(b"".join(parts), 1))


def _unpack_pieces(lengths: bytes, data: bytes) -> list[bytes]:
    data, ends = zlib.decompress(data), np.cumsum(_unpack_numbers(lengths), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _in_blocks(batches):
    """(block, whether it is new, batch, texts) of the steps of a task, blocks of BLOCK_BYTES.

    The same for every pass over the same splits; a block's number is its first row's."""
    block, size = None, 0
    for batch, texts, offs in steps(batches):
        new = block is None or size + int(offs[-1]) > BLOCK_BYTES
        if new:
            block, size = batch.column(batch.schema.get_field_index("row"))[0].as_py(), 0
        size += int(offs[-1])
        yield block, new, batch, texts.to_pylist()


def _distinct_words(docs: DataFrame, buckets: int) -> DataFrame:
    """block, bucket and the distinct words (number in the block, length, bytes) of each block."""
    names = ["block", "bucket", "codes", "lengths", "data"]

    def rows(block, number):
        by_bucket: dict[int, tuple[list, list]] = {}
        for code, w in enumerate(number):
            raw = w.encode()
            codes, parts = by_bucket.setdefault(zlib.crc32(raw) % buckets, ([], []))
            codes.append(code)
            parts.append(raw)
        packed = [_pack_pieces(*x) for x in by_bucket.values()]
        cols = zip(*packed, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(packed), pa.int64()), pa.array(by_bucket, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names)

    def run(batches):
        number: dict[str, None] = {}
        last = None
        for block, new, _, texts in _in_blocks(batches):
            if new and number:
                yield rows(last, number)
                number = {}
            for text in texts:
                number.update(dict.fromkeys(split_words(text)))
            last = block
        if number:
            yield rows(last, number)

    return docs.mapInArrow(run, "block long, bucket int, codes binary, lengths binary, data binary")


def _numbers(docs: DataFrame, id_type: str) -> DataFrame:
    """block, id and the numbers of a document's words; numbers go by first occurrence in the block."""
    def run(batches):
        number: defaultdict = defaultdict()
        for block, new, batch, texts in _in_blocks(batches):
            if new:
                number = defaultdict()
                number.default_factory = number.__len__
            codes = [_pack_numbers(np.fromiter(map(number.__getitem__, split_words(t)), dtype=np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(codes), pa.int64()), batch.column(0), pa.array(codes, pa.binary())], ["block", "id", "codes"])

    return docs.mapInArrow(run, f"block long, id {id_type}, codes binary")


def _encode(words: DataFrame, path: str) -> DataFrame:
    """The same rows with ids instead of words; a bucket's distinct words are encoded once each."""
    def run(batches):
        bucket, known = None, {}
        for batch in batches:
            rows = batch.to_pydict()
            lengths_out, data_out = [], []
            for b, lengths, data in zip(rows["bucket"], rows["lengths"], rows["data"], strict=True):
                if b != bucket:
                    bucket, known = b, {}
                found = _unpack_pieces(lengths, data)
                fresh = list(set(found).difference(known))
                known.update(zip(fresh, encode_words(path, [w.decode() for w in fresh]), strict=True))
                ids = [known[w] for w in found]
                lengths_out.append(_pack_numbers(np.array([len(x) >> 2 for x in ids], dtype=np.int64)))
                data_out.append(_pack_numbers(np.frombuffer(b"".join(ids), dtype="<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths_out, pa.binary()), pa.array(data_out, pa.binary())],
                                             ["block", "bucket", "codes", "lengths", "data"])

    return words.select("block", "bucket", "codes", "lengths", "data").mapInArrow(run, "block long, bucket int, codes binary, lengths binary, data binary")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and, if wanted, ids and decoded) of each document.

    ``docs``: a stored table, read twice with the same splits. ``path``: the tokenizers file."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = number_rows(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "row")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(16, min(1 << 16, size >> 22))
    words = _distinct_words(docs, buckets).repartition("bucket").sortWithinPartitions("bucket")
    none = F.lit(None)
    ids = _encode(words, path).select("block", F.lit(0).alias("kind"), none.cast(id_type).alias("id"), "codes", "lengths", "data")
    rows = ids.union(_numbers(docs, id_type).select("block", F.lit(1).alias("kind"), "id", "codes", none.cast("binary"), none.cast("binary")))
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        block, packed, numbers, decoded_of = None, [], {}, {}

        def fill() -> None:
            """The block's words by number: their ids, and what a join with the pieces decodes them to."""
            codes, lengths, data = zip(*packed, strict=True)
            all_ids = np.concatenate([_unpack_numbers(d) for d in data])
            code = np.concatenate([np.cumsum(_unpack_numbers(c), dtype=np.int64) for c in codes]).tolist()
            ends = np.cumsum(np.concatenate([_unpack_numbers(n) for n in lengths]), dtype=np.int64)
            raw, (text, at) = all_ids.tobytes(), decode_ids(all_ids, path)
            cut, start = (at[ends] - at[0]).tolist(), 0
            for c, x, y, z in zip(code, [0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist(), cut, strict=True):
                numbers[c], decoded_of[c], start = raw[x:y], text[start:z], z
            packed.clear()

        for batch in batches:
            cols = batch.to_pydict()
            out: list[tuple] = []
            for b, kind, ident, codes, lengths, data in zip(*(cols[c] for c in ("block", "kind", "id", "codes", "lengths", "data")), strict=True):
                if b != block:
                    block, packed, numbers, decoded_of = b, [], {}, {}
                if kind == 0:
                    packed.append((codes, lengths, data))
                    continue
                if packed:
                    fill()
                order = _unpack_numbers(codes).tolist()
                raw = b"".join(map(numbers.__getitem__, order))
                found = np.frombuffer(raw, dtype="<u4")
                decoded = b"".join(map(decoded_of.__getitem__, order)).decode("utf-8", "replace")
                row = (ident, len(found), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*row, found.astype(np.int32), decoded) if with_ids else row)
            if out:
                types[0] = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names)]
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).withColumnRenamed("id", "doc_id")
