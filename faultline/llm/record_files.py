"""Token ids as length-delimited binary records with an offset index.

A folder holds, for every part of the id range, a record file and its index, and a manifest
that is written last:

* ``part-N.rec``: one record per document, each number little-endian: payload length
  (8 bytes), masked CRC-32C of these (4), payload, masked CRC-32C of the payload (4). A
  payload is flags (4), the id (8) and the token ids, 4 bytes each, or 2 if the vocabulary
  fits. Flags: 1 the id is not null, 2 narrow token ids, 4 two bytes of padding follow them.
  Readers of the common framed-record format can read the files.
* ``part-N.idx``: for every record, and once more at the end, its byte offset and the
  tokens of the part before it (8 bytes each), so any record is one seek away.
* ``manifest``: a table of the parts with their sizes and the tokens before each.

Writing range-partitions the texts by id, sorts each part on disk if need be, and tokenizes
while it writes: memory is bounded by one Arrow batch (or one text, if longer). A part is
written under the name of its task attempt and renamed when complete, so an attempt lost
or repeated leaves no half file; files that the manifest does not name are not read. A
reader splits parts by their index, in ranges of bounded size, verifies lengths and both
checksums, and fails on any difference. With a seed, ranges and the records inside come in
a shuffled order.

A null or empty text has the end mark alone. Null ids come last. Rows that repeat an id
are records of their own, ordered by a hash of the text; a hot id is spread over parts by it
and by the row's number. Ids must be integers. An empty table gives a manifest without
parts and no rows. Columns beside id and text are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut_lineage, pick
from .textcode import ragged
from .token_ids import encoder

U32 = np.uint32
HEAD = 3  # words before a payload: length, its checksum
ID = 3  # words of a payload before the token ids
KNOWN, NARROW, PADDED = 1, 2, 4  # flags
MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78


# ---- checksums of many records at once ----------------------------------------------

def _word_step() -> list[int]:
    """What four zero bytes make of each bit of a CRC-32C state."""
    out = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(32):
            x = (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)
        out.append(x)
    return out


def _tables(columns: list[int]) -> np.ndarray:
    """The linear map with these columns, looked up by the four bytes of its argument."""
    out = np.zeros((4, 256), U32)
    for bit, c in enumerate(columns):
        out[bit // 8, (np.arange(256) >> bit % 8 & 1).astype(bool)] ^= U32(c)
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


_steps = [_tables(_word_step())]


def _step(level: int) -> np.ndarray:
    """The map of 2**level words."""
    while len(_steps) <= level:
        bits = (1 << np.arange(32, dtype=np.uint64)).astype(U32)
        _steps.append(_tables(_apply(_steps[-1], _apply(_steps[-1], bits)).tolist()))
    return _steps[level]


def crc32c(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRC-32C of runs of 32-bit words (each run has some): neighbours are joined pairwise, all runs
    in step, each level with the map of twice as many words."""
    x, count, level = words.astype(U32), count.astype(np.int64), 0
    x[np.cumsum(count) - count] ^= U32(0xFFFFFFFF)
    while len(count) and count.max() > 1:
        half = (count + 1) // 2
        both = np.zeros(2 * int(half.sum()), U32)  # an odd run gets a zero in front
        both[ragged((np.cumsum(half) - half) * 2 + (count & 1), count)] = x
        x, count = _apply(_step(level), both[0::2]) ^ both[1::2], half
        level += 1
    return _apply(_step(0), x) ^ U32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + U32(MASK_DELTA)


# ---- frames ---------------------------------------------------------------------------

def _narrowed(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of two bytes in words, and the words of each record."""
    half = (count + 1) // 2
    out = np.zeros(2 * int(half.sum()), "<u2")
    out[ragged(2 * (np.cumsum(half) - half), count)] = ids
    return out.view("<u4"), half


def frames(doc: np.ndarray, known: np.ndarray, ids: np.ndarray, count: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """The words of all records, and how many each has."""
    flags = known * KNOWN + (narrow * (NARROW + (count & 1) * PADDED))
    body, inside = _narrowed(ids, count) if narrow else (ids, count)
    payload = inside + ID
    size = payload + HEAD + 1
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), U32)
    length = (payload * 4).astype(np.uint64)
    head = np.stack([length.astype(U32), (length >> np.uint64(32)).astype(U32)], 1)
    out[at], out[at + 1] = head[:, 0], head[:, 1]
    out[at + 2] = masked(crc32c(head.reshape(-1), np.full(len(count), 2)))
    out[at + HEAD] = flags
    value = doc.astype(np.int64).view(np.uint64)
    out[at + HEAD + 1], out[at + HEAD + 2] = value.astype(U32), (value >> np.uint64(32)).astype(U32)
    out[ragged(at + HEAD + ID, inside)] = body
    out[at + size - 1] = masked(crc32c(out[ragged(at + HEAD, payload)], payload))
    return out, size


def unframed(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, known, ids, count of records with the given numbers of words; any damage is an
    error."""
    at, payload = np.cumsum(size) - size, size - HEAD - 1
    if len(size) and (payload.min() < ID or int(size.sum()) != len(words)):
        raise ValueError("index and record file do not fit")
    length = words[at].astype(np.uint64) | words[at + 1].astype(np.uint64) << np.uint64(32)
    head = np.stack([words[at], words[at + 1]], 1).reshape(-1)
    good = (length == (payload * 4).astype(np.uint64)) & (masked(crc32c(head, np.full(len(size), 2))) == words[at + 2])
    if not good.all() or (masked(crc32c(words[ragged(at + HEAD, payload)], payload)) != words[at + size - 1]).any():
        raise ValueError("a record is damaged")
    doc = (words[at + HEAD + 1].astype(np.uint64) | words[at + HEAD + 2].astype(np.uint64) << np.uint64(32)).view(np.int64)
    flags, inside = words[at + HEAD].astype(np.int64), payload - ID
    narrow = flags & NARROW > 0
    if narrow.any() and not narrow.all():
        raise ValueError("records of two widths in one range")
    ids, count = words[ragged(at + HEAD + ID, inside)], inside
    if narrow.any():
        count = 2 * inside - (flags & PADDED > 0)
        ids = ids.view("<u2")[ragged(2 * (np.cumsum(inside) - inside), count)].astype(U32)
    return doc, flags & KNOWN > 0, ids, count


# ---- files ----------------------------------------------------------------------------

def _opened(path: str):
    """File system and path; Spark's ``file:/x`` is a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _written(folder: str, tokenizer_path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():07d}", f"_attempt-{task.taskAttemptId()}"
        data = index = None
        records = tokens = offset = 0
        encode = encoder(tokenizer_path)
        narrow = max(encode.tokenizer.get_vocab_size(), end_id or 0) <= 1 << 16
        for batch in batches:
            doc_all, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            known_all = doc_all.is_valid().to_numpy(zero_copy_only=False)
            doc_all = doc_all.fill_null(0).to_numpy()
            for a, ids, count in encode(texts, end_id):
                if data is None:
                    data, index = (store.open_output_stream(f"{root}/{attempt}.{x}") for x in ("rec", "idx"))
                b = a + len(count)
                words, size = frames(doc_all[a:b], known_all[a:b], ids, count, narrow)
                data.write(words.tobytes())
                places = np.stack([offset + 4 * (np.cumsum(size) - size), tokens + np.cumsum(count) - count], 1)
                index.write(places.astype("<u8").tobytes())
                records, tokens, offset = records + len(count), tokens + int(count.sum()), offset + 4 * len(words)
        if data is None:
            return
        index.write(np.array([offset, tokens], "<u8").tobytes())
        for stream, kind in ((data, "rec"), (index, "idx")):
            stream.close()
            store.move(f"{root}/{attempt}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "name": name, "records": records, "tokens": tokens, "bytes": offset}])
    return run


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0, part_bytes: int = 128 << 20,
                  id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the records of all texts in ascending order of ids to a new folder that driver
    and executors share. A part takes about ``part_bytes`` of text, less if there would be
    fewer parts than twice the cores."""
    spark = docs.sparkSession
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(total // part_bytes + 1, 2 * spark.sparkContext.defaultParallelism)
    keyed = src.select("doc_id", "text", F.col("doc_id").isNull().alias("_last"), F.xxhash64("text").alias("_hash"),
                       F.monotonically_increasing_id().alias("_row"))
    order = ["_last", "doc_id", "_hash", "_row"]
    store, root = _opened(folder)
    store.create_dir(root, recursive=True)
    done = (keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
            .mapInArrow(_written(folder, tokenizer_path, end_id), PARTS))
    rows, before = [], 0
    for r in sorted(done.collect()):  # one row a part
        rows.append((*r, before))
        before += r["tokens"]
    spark.createDataFrame(rows, PARTS + ", first_token long").coalesce(1).write.parquet(f"{folder}/manifest")


PARTS = "part long, name string, records long, tokens long, bytes long"


def _ranges(folder: str, range_bytes: int):
    """Rows (part file, first token, first byte, word counts of its records), from the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{root}/{r['name']}.idx") as f:
                    n, at = r["records"], 0
                    while at < n:  # as many entries as a range can need, then the range
                        some = np.frombuffer(f.read_at(16 * (min(n - at, range_bytes // 32 + 1) + 1), 16 * at), "<u8").reshape(-1, 2).astype(np.int64)
                        end = max(1, int(np.searchsorted(some[:, 0], some[0, 0] + range_bytes, "right")) - 1)
                        yield pa.RecordBatch.from_pylist([{
                            "name": r["name"], "first_token": r["first_token"] + int(some[0, 1]), "first_byte": int(some[0, 0]),
                            "sizes": np.diff(some[:end + 1, 0]).tobytes()}])
                        at += end
    return run


def _read(folder: str, seed: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["sizes"], np.int64)
                with store.open_input_file(f"{root}/{r['name']}.rec") as f:
                    raw = f.read_at(int(sizes.sum()), r["first_byte"])
                doc, known, ids, count = unframed(np.frombuffer(raw, "<u4"), sizes // 4)
                start = r["first_token"] + np.cumsum(count) - count
                edges = np.concatenate([[0], np.cumsum(4 * count)])
                blobs = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])
                out = pa.RecordBatch.from_arrays([pa.array(doc, mask=~known), pa.array(start), pa.array(count.astype(np.int64)), blobs.cast(pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])
                if seed is not None:
                    out = out.take(pa.array(np.random.default_rng([seed, r["first_token"]]).permutation(len(count))))
                yield out
    return run


def read_records(spark: SparkSession, folder: str, seed: int | None = None, range_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens and ids (their bytes) of every
    record of the folder's manifest."""
    parts = spark.read.parquet(f"{folder}/manifest")
    total, files = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    cores = spark.sparkContext.defaultParallelism
    ranges = cut_lineage(parts.select("name", "records", "first_token").repartition(max(1, min(files, 4 * cores)), "name")
                         .mapInArrow(_ranges(folder, range_bytes), "name string, first_token long, first_byte long, sizes binary"))
    tasks = max(2 * cores, total // (16 * range_bytes) + 1)
    if seed is None:
        ranges = ranges.repartition(tasks, "name", "first_byte")
    else:
        place = F.xxhash64(F.lit(seed), "name", "first_byte")
        ranges = ranges.repartitionByRange(tasks, place).sortWithinPartitions(place)
    return ranges.mapInArrow(_read(folder, seed), "doc_id long, start long, n_tokens long, ids binary")
