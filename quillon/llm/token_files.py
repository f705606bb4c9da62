"""Token-ID / binary output as directly addressable codes.

A shard is a row of a Parquet table that holds one block of ids. Ids are cut into
chunks of 8 bits: level 0 stores the low chunk of every id, level j + 1 the next
chunk of those ids that go on. A bitmap for each level tells which do, and a rank
directory (set bits before each 512-bit block) leads from an id's place at one
level to its place at the next, so any id is read from a few bytes at known
places, without decoding its neighbours.

    shard        int     number of the shard, in ascending doc_id order
    n_tokens     long    ids in the shard
    doc_ids      binary  little-endian int64 for each document; nulls binary, 1 byte each
    ends         binary  little-endian int64: ids of the shard up to each document's end
    levels       array of (chunks binary, bitmap binary, ranks binary of little-endian uint32)

Defined cases: a null or empty text has only the end id, a null doc_id sorts
first, rows with equal ids stand side by side, an empty table writes no shard.
Extra columns are not read. A document is never split over shards.
"""

from __future__ import annotations

import array
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if, shared_dir
from ._text import slices, small_batches

BITS = 8
BLOCK = 512
#: Ids after which a shard is closed at the next document's end.
SHARD_TOKENS = 1 << 20
#: Words whose ids a Python worker keeps; beyond it starts anew, with the same ids.
CACHE = 1 << 20

#: Unknown words coded as one text, and the vocabulary's sign for a space.
RUN, SPACE = 256, "\u0120"

#: Shards (about 2 MB each) whose bases may be broadcast; beyond, the join is shuffled.
BROADCAST_SHARDS = 1 << 20

_LEVEL = "struct<chunks: binary, bitmap: binary, ranks: binary>"
SCHEMA = f"part int, shard int, n_tokens long, first_id long, doc_ids binary, nulls binary, ends binary, levels array<{_LEVEL}>"


def dac_encode(ids: np.ndarray) -> list[dict]:
    """The levels of an array of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(BITS)
        bits = more > 0
        padded = np.zeros(-(-max(1, len(bits)) // BLOCK) * BLOCK, bool)
        padded[: len(bits)] = bits
        counts = padded.reshape(-1, BLOCK).sum(1)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u4")
        levels.append({"chunks": (rest & np.uint32(255)).astype(np.uint8).tobytes(), "bitmap": np.packbits(padded, bitorder="little").tobytes(), "ranks": ranks.tobytes()})
        rest = more[bits]
        if not len(rest):
            return levels


def dac_decode(levels: list[dict]) -> np.ndarray:
    """All ids of a shard."""
    ids, at = np.frombuffer(levels[0]["chunks"], np.uint8).astype("<u4"), None
    for j, level in enumerate(levels):
        n = len(level["chunks"])
        bits = np.unpackbits(np.frombuffer(level["bitmap"], np.uint8), bitorder="little")[:n].astype(bool)
        where = np.flatnonzero(bits) if at is None else at[bits]
        if j + 1 < len(levels):
            ids[where] |= np.frombuffer(levels[j + 1]["chunks"], np.uint8).astype("<u4") << np.uint32(BITS * (j + 1))
        at = where
    return ids


def dac_get(levels: list[dict], i: int) -> int:
    """The id at place i, read through the rank directories alone."""
    value = 0
    for j, level in enumerate(levels):
        value |= level["chunks"][i] << (BITS * j)
        if not level["bitmap"][i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        own = np.frombuffer(level["bitmap"], np.uint8)[block * BLOCK // 8 : i // 8 + 1]
        bits = np.unpackbits(own, bitorder="little")[: i - block * BLOCK]
        i = int(np.frombuffer(level["ranks"], "<u4")[block]) + int(bits.sum())
    return value


class _Encoder:
    """Ids of whole texts through the tokenizer, remembering those of words.

    The byte-level tokenizer first cuts a text by a pattern and codes each piece alone.
    A single space between two characters that are not white space always starts a
    piece, so a text can be cut at such spaces and its words coded one by one, each
    with the space before it. Words that are not known yet are coded many at a time,
    joined by single spaces, and told apart by the ids that hold these. A text whose
    spaces do not all stand so is cut by the pattern itself. A text that holds an added token goes to the tokenizer as it is, and so do all
    texts of a tokenizer that is built otherwise.
    """

    _ODD = re.compile(r" (?=\s|$)|(?:^|(?<=\s)) ")
    _RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = _codes_pieces_alone(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose text starts with a space
        self.spaced[[i for x, i in vocabulary.items() if x[:1] == SPACE]] = True
        self.words: dict[str, bytes] = {}  # ids of a word with a space before it
        self.known: dict[str, bytes] = {}  # ids of a piece as it is

    def _plain(self, text: str) -> bool:
        """Whether every space of the text stands alone between other characters."""
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return False
        return not (self._RARE_SPACE.search(text) and self._ODD.search(text))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _code(self, pieces: set[str]) -> None:
        missing = list(pieces - self.known.keys())
        self.known.update(zip(missing, self._whole(missing), strict=True))

    def _learn(self, new: set[str]) -> None:
        """Add words, RUN of them coded as one text; of a word's ids only the first holds a space."""
        words = list(new)
        runs = [words[a : a + RUN] for a in range(0, len(words), RUN)]
        for run, raw in zip(runs, self._whole([" " + " ".join(run) for run in runs]), strict=True):
            starts = np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")]) * 4
            ends = [*starts[1:].tolist(), len(raw)]
            self.words.update((w, raw[a:b]) for w, a, b in zip(run, starts.tolist(), ends, strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        whole = [i for i, x in enumerate(texts) if not self.by_pieces or self.added and self.added.search(x)]
        if whole:
            aside = set(whole)
            rest = [i for i in range(len(texts)) if i not in aside]
            out = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
            out |= zip(rest, self.batch([texts[i] for i in rest]) if rest else [], strict=True)
            return [out[i] for i in range(len(texts))]
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.known) > CACHE // 4:
            self.known.clear()
        get, coded, leads, new = self.words.get, [], [], set()
        for text in texts:
            lead, *words = text.split(" ") if self._plain(text) else [text]
            ids = list(map(get, words))
            gaps = [i for i, x in enumerate(ids) if x is None]
            new.update([words[i] for i in gaps])
            leads.append(self.pieces.findall(lead))
            coded.append((words, ids, gaps))
        self._learn(new)
        self._code({x for own in leads for x in own})
        out, own, piece = [], self.words.__getitem__, self.known.__getitem__
        for lead, (words, ids, gaps) in zip(leads, coded, strict=True):
            for i in gaps:
                ids[i] = own(words[i])
            out.append(b"".join([*map(piece, lead), *ids]))
        for x in [x for x in new if len(x) > 64]:  # seldom met again
            del self.words[x]
        return out

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]


def _codes_pieces_alone(path: str) -> bool:
    """Whether the tokenizer is a byte-level one whose standard pattern cuts texts into pieces coded alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return plain and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _pack(part: int, shard: int, docs: list, blobs: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(blobs), "<u4")
    return {
        "part": part,
        "shard": shard,
        "n_tokens": len(ids),
        "first_id": next((d for d in docs if d is not None), None),
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
        "nulls": bytes(d is None for d in docs),
        "ends": np.cumsum([len(b) // 4 for b in blobs]).astype("<i8").tobytes(),
        "levels": dac_encode(ids),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0) -> None:
    """Encode ``docs(doc_id, text)`` and write the shards in ascending doc_id order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(docs.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, ids, blobs, held, shard, part = encoder(tokenizer), [], [], 0, 0, 0
        for batch in batches:
            coded = (blob for a, b in slices(batch["text"]) for blob in code.batch([x.as_py() or "" for x in batch["text"][a:b]]))
            for doc, blob, part in zip(batch["doc_id"].to_pylist(), coded, batch["part"].to_pylist(), strict=True):
                blob += end
                ids.append(doc)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= SHARD_TOKENS:
                    yield pa.RecordBatch.from_pylist([_pack(part, shard, ids, blobs)], schema)
                    ids, blobs, held, shard = [], [], 0, shard + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(part, shard, ids, blobs)], schema)

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The shards with ``base``, the ids of all shards before each."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    inside = shards.select("part", "shard", "n_tokens")
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("inner", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(parts, F.col("part") == F.col("p"))
    bases = inside.select("part", "shard", (F.col("above") + F.col("inner")).alias("base"))
    return shards.join(broadcast_if(bases, BROADCAST_SHARDS), ["part", "shard"])


def token_digest(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards."""
    spark = shards.sparkSession
    small_batches(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = dac_decode(row["levels"]).astype("<u4").tobytes()
                ends = np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([doc, pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = shards.select("base", "doc_ids", "nulls", "ends", "levels")
    return columns.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return the digest read back from them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return token_digest(read_tokens(spark, path))
