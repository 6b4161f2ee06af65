"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of white space markers with the characters up to the next marker.  Where no
piece of the model has a marker behind another character, no merge crosses a chunk's border,
so that a text's ids are its chunks' ids in order of position.

Three steps, each of bounded memory:

1. texts are taken in slabs of about ``slab_bytes``.  A slab's distinct chunks go out in cells by
   bucket of their hash; of a text only the places of its chunks in the slab's list move on.  Either is made in a pass of its
   own over the texts, so that neither has to be written besides the shuffle; a slab is named by its place and
   the digest of its chunks;
2. cells meet by bucket, so that a chunk of the whole table stands in one bucket, where it is segmented
   once (beyond ``held`` chunks of a bucket the bucket's table starts anew), and the cell goes back with ids in its place;
3. cells and texts of a slab meet, the ids of each of its chunks are decoded, and both are joined by position.

The number of buckets rises with the square root of the bytes, as that of distinct words does or less.
Nothing is broadcast.  Every text is encoded whole.  Null text counts as empty.  Rows
are kept as they are, repeated ones too; other columns pass through unless their names clash
with the result's, in which case the result's win.  The texts must be the same when they are read again, as those of
a table are; should a slab differ between the passes, the job fails instead of joining other ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.workers import trimmed


MARK = "▁"
#: In place of a bucket: the row with the buckets of a slab's chunks, and rows of its texts, which come last.
ORDER, TEXT = -1, 2**31 - 1


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def chunkable(path: str) -> bool:
    """Whether texts may be cut before markers: no piece holds one behind another character, the
    library adds a marker in front, and it neither folds white space nor normalises otherwise."""
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = [("a  b ", ["a", MARK * 2 + "b", MARK]), ("Ａ", ["Ａ"])]
    kept = all(model.decode(model.encode(text)) == text for text, _ in plain)
    return kept and model.encode(" ", out_type=str) == [MARK * 2] and not any(MARK in p.lstrip(MARK) for p in pieces)


def chunks(text: str) -> list[str]:
    """The chunks of ``text`` without their first marker; joined by one marker they are the text."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    found, run = [], 0
    for part in parts[:-1]:
        if part:
            found.append(" " * run + part)
            run = 0
        else:
            run += 1
    found.append(" " * run + parts[-1])
    return found


def _segment(model: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[list[int]]:
    """Ids of each chunk.  The library adds the first marker itself, but not to an empty text."""
    marker = model.piece_to_id(MARK)
    return [ids if word else [marker] for word, ids in zip(words, model.encode(words, num_threads=1), strict=True)]


def _decoded(model: sentencepiece.SentencePieceProcessor, ids: list[list[int]]) -> list[str]:
    """The decoded text of each chunk's ids.  Decoding keeps a chunk's first marker as a space when another id stands before it."""
    before = model.piece_to_id(MARK + "a")
    return [text[1:] for text in model.decode([[before, *one] for one in ids], num_threads=1)] if ids else []


def _packed(texts: list[str]) -> bytes:
    """Texts as bytes: how many, their lengths, then all of them."""
    lengths = np.fromiter(map(len, texts), np.uint32, len(texts))
    return zlib.compress(np.uint32(len(texts)).tobytes() + lengths.tobytes() + "".join(texts).encode(), 1)


def _unpacked(data: bytes) -> list[str]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64).tolist()
    whole = raw[4 + 4 * n :].decode()
    return [whole[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**32, mostly small ones: all their first bytes, then all their second ones and so on, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _of_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _id_lists(data: bytes) -> list[list[int]]:
    """What ``_numbers`` made of how many lists there are, their lengths, and all their numbers."""
    values = _of_numbers(data)
    n = int(values[0])
    ends = np.cumsum(values[1 : n + 1], dtype=np.int64).tolist()
    flat = values[n + 1 :].tolist()
    return [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _of_id_lists(lists: list[list[int]]) -> bytes:
    lengths = np.fromiter(map(len, lists), np.uint32, len(lists))
    flat = np.fromiter((i for one in lists for i in one), np.uint32, int(lengths.sum()))
    return _numbers(np.concatenate([np.array([len(lists)], np.uint32), lengths, flat]))


class Slab:
    """The distinct chunks of some texts in order of first occurrence: the bucket of each, the places of each text's
    chunks among them, and by bucket the chunks themselves."""

    def __init__(self, texts: list[str | None], buckets: int):
        known: dict[str, int] = {}
        self.of_texts = [np.fromiter([known.setdefault(c, len(known)) for c in chunks(t or "")], np.uint32) for t in texts]
        self.words = list(known)
        self.bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in self.words), np.uint32, len(self.words))
        self.digest = hashlib.sha256("\n".join(map(repr, self.words)).encode()).hexdigest()[:16]

    def places(self) -> list[bytes]:
        return [_numbers(p) for p in self.of_texts]

    def order(self) -> bytes:
        return _numbers(self.bucket)

    def cells(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, its chunks), by rising bucket."""
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bucket[order].astype(np.int64), prepend=-1)).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
            yield int(self.bucket[order[x]]), _packed([self.words[i] for i in order[x:y]])


def in_order(order: bytes, cells: list[list]) -> list:
    """Entries of a slab's cells, given by rising bucket, in the order of its chunks."""
    bucket = _of_numbers(order)
    out = [None] * len(bucket)
    for at, entry in zip(np.argsort(bucket, kind="stable").tolist(), (e for cell in cells for e in cell), strict=True):
        out[at] = entry
    return out


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``size`` bytes; a longer text is a run."""
    ends = np.cumsum([0 if t is None else t for t in pc.binary_length(texts).to_pylist()])
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, upto - at
        at = upto


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep_ids: bool = False, slab_bytes: int = 16 << 20, held: int = 1_000_000) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256, decoded_sha256 and, on request, ids and decoded.

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256 that of the
    decoded text in UTF-8.  A model whose pieces cross markers is refused, as chunks would give
    other ids than whole texts.
    """
    if not chunkable(model_path):
        raise ValueError("pieces of this model cross white space markers; chunks would change the ids")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, 4 * math.isqrt(total >> 20))
    others = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text and f.name not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded", "__slab", "__bucket", "__data")]
    names = [f.name for f in others]
    keys = [T.StructField("__slab", T.StringType()), T.StructField("__bucket", T.IntegerType()), T.StructField("__data", T.BinaryType())]
    held_names = [*names, *[k.name for k in keys]]

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, str, Slab]]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, length in _slices(batch.column(batch.num_columns - 1), slab_bytes):
                rows = batch.slice(start, length)
                slab = Slab(rows.column(rows.num_columns - 1).to_pylist(), buckets)
                yield rows, f"{part}-{n}-{slab.digest}", slab
                n += 1

    def cut_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name, slab in slabs(batches):
            cells = list(slab.cells())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary())], names=["__slab", "__bucket", "__data"])

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, name, slab in slabs(batches):
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array([name] * n), pa.array([TEXT] * n, pa.int32()), pa.array(slab.places(), pa.binary())], names=held_names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, c.type) for c in rows.columns[: len(names)]], pa.array([name]), pa.array([ORDER], pa.int32()), pa.array([slab.order()], pa.binary())], names=held_names)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        table: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for cell in batch.column(2):
                words = _unpacked(cell.as_py())
                missing = [w for w in words if w not in table]
                if len(table) + len(missing) > held:
                    table, missing = {}, words
                table.update(zip(missing, _segment(model, missing), strict=True))
                out.append(_of_id_lists([table[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["__slab", "__bucket", "__data"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        added += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slab, cells, order = _model(model_path), None, [], b""
        ids: list[str] = []
        decoded: list[str] = []
        counts: list[int] = []
        for batch in batches:
            rows: list[int] = []
            out: dict[str, list] = {f.name: [] for f in added}
            keyed = zip(*(batch.column(len(names) + k).to_pylist() for k in range(3)), strict=True)
            for row, (name, bucket, data) in enumerate(keyed):
                if name != slab:
                    slab, cells = name, []
                if bucket == ORDER:
                    order = data
                    continue
                if bucket != TEXT:  # a slab's cells come before its texts, by bucket
                    cells.append(_id_lists(data))
                    continue
                if cells is not None:
                    lists = in_order(order, cells)
                    ids, decoded, counts, cells = [",".join(map(str, one)) for one in lists], _decoded(model, lists), [len(one) for one in lists], None
                places = _of_numbers(data).tolist()
                own = ",".join([ids[p] for p in places])
                plain = "".join([decoded[p] for p in places])[1:]
                rows.append(row)
                out["n_tokens"].append(sum([counts[p] for p in places]))
                out["ids_sha256"].append(hashlib.sha256(own.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(plain.encode()).hexdigest())
                if keep_ids:
                    out["ids"].append(own)
                    out["decoded"].append(plain)
            kept = batch.take(pa.array(rows, pa.int64()))
            kinds = {"n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(names)], *[pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()]], names=[*names, *out])

    # Both passes read the same columns, or a shuffle above could deal rows differently.
    read = docs.select(*[F.col(f"`{n}`") for n in names], F.col(text))
    cells = read.mapInArrow(trimmed(cut_cells), T.StructType(keys)).repartition(buckets, "__bucket").mapInArrow(trimmed(segment), T.StructType(keys))
    texts = read.mapInArrow(trimmed(cut_texts), T.StructType([*others, *keys]))
    both = texts.unionByName(cells.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in others], "__slab", "__bucket", "__data"))
    met = both.repartition(max(least, (total >> 25) + 1), "__slab").sortWithinPartitions("__slab", "__bucket")
    return met.mapInArrow(trimmed(join), T.StructType([*others, *added]))
