"""Token ids in binary files of independent zstandard frames.

Documents are encoded, and written in ascending id order, one file for each range of ids. A file is a row of zstandard frames
(content checksum on) of little-endian unsigned 32-bit ids, each document ended by END_ID; then a skippable frame with the
index of its documents; then a skippable frame with the seek table in the public seekable format (compressed size, decompressed
size and XXH64 checksum of each frame). A reader fetches the tail, then only the frames of the documents it wants.

Files are written under a name of the attempt and listed by the task that ended well, so a task that is run again after a
lost executor does no harm: its leavings are not in the manifest.

Defined cases: a null text is an empty one and yields END_ID only; a null id comes first; equal ids keep no order among
themselves but by text; an empty table gives no files and no rows; very long texts may fill a frame alone; further columns are left out.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import map_arrow, shared_dir, stored, table

END_ID = 0
#: Ids of a frame before it is closed (1 MB); a document is never split over frames.
FRAME_IDS = 1 << 18
#: Distinct stretches and pieces whose ids a worker keeps in its young cache; at the bound that becomes the old one.
CACHE = 500_000
#: The bytes of a space and of a new line in tokens of byte-level vocabularies.
SPACE, NEW_LINE = "\u0120", "\u010a"
LEVEL = 1

# Fixed values of the zstandard seekable format.
SEEK_FRAME, SEEK_MAGIC, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
SEEK_ENTRY, SEEK_FOOT, INDEX_ENTRY = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<BqIII")


#: Blanks other than the space and the new line, in Python's or the tokenizer's sense.
RARE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
ODD = ("  ", " \n", "\n ", "<|", *RARE)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its cache serves later tasks as well."""
    return Encoder(path)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer, with a bounded cache of stretches: what stands between two spaces, led by the first.

    Byte-level pre-tokenization never joins characters over a single space between two non-blanks, so the ids of a text whose
    spaces all stand so are those of its stretches; other texts are encoded whole. The same holds the other way: new stretches are
    encoded as one text, whose ids are cut before each token that starts with the space, as a stretch has no other space.
    """

    def __init__(self, path: str):
        self.tok, self.cache, self.old = tokenizer(path), {}, {}
        vocabulary = self.tok.get_vocab()
        self.spaced, self.led = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        self.spaced[[x for t, x in vocabulary.items() if t[:1] == SPACE]] = True
        self.led[[x for t, x in vocabulary.items() if t[:1] in (SPACE, NEW_LINE)]] = True
        # Letters, then marks, then perhaps a new line that starts alike: letters with what leads them, and marks, are pre-tokens.
        letter, mark = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
        self.plain = re.compile(rf"({letter}+)({mark}*)(?:(\n{letter}+)({mark}*))?").fullmatch

    def odd(self, text: str) -> bool:
        """Whether the text has a space at its ends or beside another blank, a rare blank, or what may be a special token."""
        return text[0] == " " or text[-1] == " " or any(map(text.__contains__, ODD))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str, starts: np.ndarray) -> list[bytes]:
        """The ids of the text, cut before each one that starts a stretch or piece."""
        (raw,) = self._ids([text])
        at = (4 * np.flatnonzero(starts[np.frombuffer(raw, "<u4")])).tolist()
        return [raw[x:y] for x, y in zip(at, [*at[1:], len(raw)], strict=True)]

    def _learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids of stretches (without the space that leads them) that the young cache lacks: from the old one, or put together from
        pieces, or else encoded whole. Stretches over two lines hardly recur and are not kept.

        Marks stand in the cache by a key that starts with a space, letters after a new line by one that starts with that, as no stretch does.
        """
        old, young, whole, parts = self.old, self.cache, [], {}
        out = {s: old[s] for s in stretches if s in old}
        for s in stretches:
            if s not in out:
                m = None if s.isalpha() else self.plain(s)
                if m:
                    a, b, c, d = m.groups("")
                    parts[s] = [a, " " + b, c, " " + d]
                else:
                    whole.append(s)
        if whole:
            out.update(zip(whole, self._cut(" " + " ".join(whole), self.spaced), strict=True))
        young.update(out)
        pieces = {p for x in parts.values() for p in x if p not in young}
        young.update({p: old[p] for p in pieces if p in old})
        if marks := [p for p in pieces if p[:1] in ("", " ") and p not in old]:
            young.update(zip(marks, self._ids([p[1:] for p in marks]), strict=True))
        if letters := [p for p in pieces if p[:1] not in ("", " ") and p not in old]:
            young.update(zip(letters, self._cut("".join(p if p[0] == "\n" else " " + p for p in letters), self.led), strict=True))
        for s, x in parts.items():
            out[s] = b"".join([young[p] for p in x])
            if not x[2]:
                young[s] = out[s]
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """For each text its ids and END_ID, as little-endian unsigned 32-bit integers."""
        end, get = END_ID.to_bytes(4, "little"), self.cache.get
        split = [[t or ""] if not t or self.odd(t) else t.split(" ") for t in texts]
        # No space leads the first stretch: it is encoded by itself, as are texts that stay whole.
        heads = self._ids([x.pop(0) for x in split])
        found = [list(map(get, x)) for x in split]
        gaps = [[k for k, v in enumerate(y) if v is None] for y in found]
        learned = self._learn({x[k] for x, g in zip(split, gaps, strict=True) for k in g})
        out = []
        for head, x, y, g in zip(heads, split, found, gaps, strict=True):
            for k in g:
                y[k] = learned[x[k]]
            out.append(b"".join([head, *y, end]))
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        return out


class FrameWriter:
    """Documents into frames, then the index and the seek table."""

    def __init__(self, sink):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames, self.docs, self.held, self.size, self.n_ids = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > 4 * FRAME_IDS:
            self.flush()
        self.docs.append((doc_id is not None, doc_id or 0, len(self.frames), self.size // 4, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.n_ids += len(ids) // 4

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zip.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zip.compress(b"".join(INDEX_ENTRY.pack(*d) for d in self.docs))
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        # The index is told from frames of ids by its place: after the last listed frame.
        table = b"".join(SEEK_ENTRY.pack(*f) for f in self.frames) + SEEK_FOOT.pack(len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class FrameReader:
    """Reads documents of one file; frames are fetched and unpacked one by one, and only if asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, kind, magic = SEEK_FOOT.unpack(self._at(size - SEEK_FOOT.size, SEEK_FOOT.size))
        if magic != SEEK_MAGIC or not kind & 0x80:
            raise ValueError("no seek table")
        rows = self._at(size - SEEK_FOOT.size - n * SEEK_ENTRY.size, n * SEEK_ENTRY.size)
        self.frames = [SEEK_ENTRY.unpack_from(rows, k * SEEK_ENTRY.size) for k in range(n)]
        self.places = np.cumsum([0, *(f[0] for f in self.frames)]).tolist()
        magic, length = struct.unpack("<II", self._at(self.places[-1], 8))
        if magic != INDEX_FRAME:
            raise ValueError("no index")
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.places[-1] + 8, length))
        self.docs = [(d if there else None, frame, at, count) for there, d, frame, at, count in INDEX_ENTRY.iter_unpack(raw)]
        self._now: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self._now[0] != k:
            packed, size, check = self.frames[k]
            raw = zstandard.ZstdDecompressor().decompress(self._at(self.places[k], packed), max_output_size=max(1, size))
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self._now = (k, raw)
        return self._now[1]

    def ids(self, doc: tuple) -> bytes:
        _, frame, at, count = doc
        return self.frame(frame)[4 * at : 4 * (at + count)]


def qualified(spark: SparkSession, place: str) -> str:
    """The place with its scheme, as Spark's default file system resolves it, so that workers and Spark mean the same files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(place: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified place. Object stores have other scheme names here than in Hadoop."""
    if place.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    if place.startswith("/"):
        return pafs.LocalFileSystem(), place
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", place))


def write(docs: DataFrame, place: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below `place` and returns the manifest: name, part, n_docs and n_tokens of each file.

    Range partitioning by id needs no single sort; the only whole-corpus exchange is that of the texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, out, fs = encoder(vocabulary), None, None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        for b in batches:
            for k in range(0, b.num_rows, 64):
                ids, texts = b.column(0).slice(k, 64).to_pylist(), b.column(1).slice(k, 64).to_pylist()
                if out is None and ids:
                    fs, path = _open(place)
                    fs.create_dir(path, recursive=True)
                    out = FrameWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                for i, x in zip(ids, coder.encode(texts), strict=True):
                    out.add(i, x)
        if out is not None:
            out.close()
            out.sink.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "n_docs": [len(out.docs)], "n_tokens": [out.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return stored(map_arrow(rows, work, "name string, part int, n_docs bigint, n_tokens bigint"), "token-manifest")


def read(manifest: DataFrame, place: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    files = sorted(manifest.collect(), key=lambda r: r["part"])  # one row for each file
    spark, base, rows = manifest.sparkSession, 0, []
    for f in files:
        rows.append((f["name"], base))
        base += f["n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = _open(place)
                with fs.open_input_file(f"{path}/{name}") as file:
                    reader = FrameReader(file)
                    for k in range(0, len(reader.docs), 4096):
                        out = []
                        for doc in reader.docs[k : k + 4096]:
                            raw = reader.ids(doc)
                            out.append((doc[0], start, len(raw) // 4, zlib.crc32(raw)))
                            start += len(raw) // 4
                        cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "name string, start bigint")
    return map_arrow(listed.repartition(max(1, len(rows)), "name"), work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs below the shared folder and reads them back."""
    place = qualified(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}")
    return read(write(docs, place, str(vocabulary or vocabulary_path()), id_col, text_col), place)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op6_token_output": op6_token_output}
