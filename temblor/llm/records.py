"""Token ids in binary files of length-delimited records with an offset index.

A record is framed as: length (8 bytes, little-endian), masked checksum of the
length (4), payload, masked checksum of the payload (4). The checksum is CRC-32,
rotated right by 15 bits plus a constant. A payload is the document id (8), a
flag for a null id (1), the bytes per token (1), and the ids. Beside each data
file lies an index of (document id, offset, tokens) triples of 8 bytes, by which
records are read in any order. A manifest lists the files in document order.

Documents are range-sorted by id, so files and records ascend. Texts are
encoded by the tokenizers library. It sees each distinct word of a task once
where the file's rules make words independent (see ``Encoder``), else whole texts.

Defined cases: a null text is encoded like an empty one, to the end id alone;
null ids come first; rows with equal ids stand in text order; no documents give
no files and no rows; further columns are dropped.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temblor.llm.outputs import Output, opened, save_manifest, spread

#: Fixed values of the frame.
LENGTH, CHECK, HEAD, ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB"), struct.Struct("<qqq")
MASK_DELTA = 0xA282EAD8

#: Words a task remembers at most.
WORDS_KEPT = 400_000
BATCH_BYTES = 16 << 20
MANIFEST = "part int, number int, file string, records bigint, tokens bigint, bytes bigint"


def masked(data: bytes) -> int:
    """CRC-32, turned so that a checksum over checksums is no checksum."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc: int | None, width: int, ids: bytes) -> bytes:
    """A framed record of packed ids of ``width`` bytes each."""
    payload = HEAD.pack(doc or 0, doc is None, width) + ids
    size = LENGTH.pack(len(payload))
    return b"".join((size, CHECK.pack(masked(size)), payload, CHECK.pack(masked(payload))))


def entry(doc: int | None, offset: int, tokens: int) -> bytes:
    return ENTRY.pack(doc or 0, offset, tokens)


class Encoder:
    """Encodes whole texts to packed ids with the tokenizers library.

    Where the file lower-cases, drops white space and splits by a pattern
    without look-around, a text of Latin letters and plain punctuation is the
    sequence of its words' ids, and each word is encoded once. All other texts
    and files go to the library whole.
    """

    #: Characters whose normal form, case and class are the same everywhere.
    OTHER = r"[^\t\n\r\x20-\x7e¡-įĲ-ſ‐-‧€]"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.pattern, self.other = self._pattern(spec, regex), regex.compile(self.OTHER)

    @staticmethod
    def _pattern(spec: dict, regex):
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]
                or spec.get("post_processor") or parts[0]["behavior"] != "Removed" or not parts[0]["invert"]
                or parts[1]["use_regex"] or parts[1]["add_prefix_space"] or "(?" in parts[0]["pattern"]["Regex"]):
            return None
        return regex.compile(parts[0]["pattern"]["Regex"])

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self, wanted: set[str]) -> None:
        """Have all wanted words ready; words not used for long are forgotten."""
        missing = wanted - self.words.keys()
        if len(self.words) + len(missing) > WORDS_KEPT:
            self.older, self.words, missing = self.words, {}, wanted
        new = []
        for word in missing:
            known = self.older.get(word)
            if known is None:
                new.append(word)
            else:
                self.words[word] = known
        for begin in range(0, len(new), 20_000):
            part = new[begin:begin + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.words[word] = self.pack(found.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split: list = [None] * len(texts)
        if self.pattern:
            for k, text in enumerate(texts):
                if not self.other.search(text) and not any(x in text for x in self.special):
                    split[k] = self.pattern.findall(text.lower())
        whole = [k for k, words in enumerate(split) if words is None]
        self._learn({x for words in split if words for x in words})
        out = [b"" if words is None else b"".join(map(self.words.__getitem__, words)) for words in split]
        for k in whole:
            out[k] = self.pack(self.tokenizer.encode(texts[k], add_special_tokens=False).ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Ids and texts, about ``BATCH_BYTES`` at a time."""
    for part in frames:
        ids, texts = part["id"].tolist(), part["text"].tolist()
        begin = held = 0
        for k, text in enumerate(texts):
            held += len(text)
            if held > BATCH_BYTES // 4 or k == len(texts) - 1:
                yield ids[begin:k + 1], texts[begin:k + 1]
                begin, held = k + 1, 0


def write_records(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text: str = "text",
                  end_id: int = 2, file_bytes: int = 128 << 20) -> DataFrame:
    """Write all documents below ``folder``; returns the manifest, one row per file."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
        width, end = np.dtype(encode.dtype).itemsize, encode.pack([end_id])
        out = index = None
        records = tokens = 0

        def close() -> pd.DataFrame:
            out.commit()
            index.commit()
            return pd.DataFrame([(part, number, name, records, tokens, out.size)],
                                columns=["part", "number", "file", "records", "tokens", "bytes"])

        for ids, texts in _batches(frames):
            for doc, body in zip(ids, encode.encode(texts)):
                if out is not None and out.size >= file_bytes:
                    yield close()
                    out, number, records, tokens = None, number + 1, 0, 0
                if out is None:
                    name = f"part-{part:06d}-{number:04d}"
                    out, index = Output(folder, f"{name}.rec"), Output(folder, f"{name}.idx")
                doc = None if doc is None or doc != doc else int(doc)
                n = len(body) // width + 1
                index.write(entry(doc, out.write(frame(doc, width, body + end)), n))
                records, tokens = records + 1, tokens + n
        if out is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).cast("bigint").alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key", "text").select("id", "text")
    return save_manifest(dealt.mapInPandas(write, MANIFEST), folder)


def _payloads(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids and tokens of the records from the stream's position on; a broken checksum raises."""
    while (record := _payload(stream)) is not None:
        yield record


def _payload(stream) -> tuple[int | None, np.ndarray] | None:
    size = stream.read(LENGTH.size)
    if not size:
        return None
    if CHECK.unpack(stream.read(4))[0] != masked(size):
        raise ValueError("broken record length")
    payload = stream.read(LENGTH.unpack(size)[0])
    if CHECK.unpack(stream.read(4))[0] != masked(payload):
        raise ValueError("broken record")
    doc, null, width = HEAD.unpack_from(payload)
    tokens = np.frombuffer(payload, dtype=f"<u{width}", offset=HEAD.size)
    return (None if null else doc), tokens.astype("<u4")


SEQUENCES = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, size, names = [], 0, ["doc_id", "start", "n_tokens", "ids"]
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > BATCH_BYTES:
            yield pd.DataFrame(held, columns=names).astype({"doc_id": "Int64"})
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names).astype({"doc_id": "Int64"})


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files, checksums verified.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit integers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row per file, so this order over all of them stays small.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            fs, root = opened(folder)
            for part in frames:
                for name, start in zip(part["file"], part["start"]):
                    with fs.open_input_stream(f"{root}/{name}.rec") as stream:
                        for doc, tokens in _payloads(stream):
                            yield doc, start, len(tokens), tokens.tobytes()
                            start += len(tokens)
        yield from _frames(rows())

    return spread(files).mapInPandas(read, SEQUENCES)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``file, doc_id, offset, n_tokens`` of every record, from the index files."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        for part in frames:
            for name in part["file"]:
                with fs.open_input_stream(f"{root}/{name}.idx") as stream:
                    rows = np.frombuffer(stream.read(), dtype="<i8").reshape(-1, 3)
                yield pd.DataFrame({"file": name, "doc_id": rows[:, 0], "offset": rows[:, 1], "n_tokens": rows[:, 2]})

    return spread(spark.read.parquet(f"{folder}/manifest").select("file")).mapInPandas(
        read, "file string, doc_id bigint, offset bigint, n_tokens bigint")


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point to, in the order of the rows, for shuffled reads."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            fs, root = opened(folder)
            for part in frames:
                files = {name: fs.open_input_file(f"{root}/{name}.rec") for name in part["file"].unique()}
                for name, offset in zip(part["file"], part["offset"]):
                    stream = files[name]
                    stream.seek(int(offset))
                    doc, tokens = _payload(stream)
                    yield doc, None, len(tokens), tokens.tobytes()
                for stream in files.values():
                    stream.close()
        yield from _frames(rows())

    return index.select("file", "offset").mapInPandas(read, SEQUENCES).drop("start")
