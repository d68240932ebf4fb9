"""Token-id output: shards of fixed-width bit-packed ids with random access.

A shard holds documents in ascending id order.  Each id takes the fewest bits that the
vocabulary needs.  Ids go into blocks of BLOCK, each padded to whole bytes.

    magic    8 bytes  b"EVENTOK1"
    blocks   packed ids, bit 0 of an id first, low bits of a byte first
    index    int64 doc ids, int64 first tokens (n_docs + 1), int64 block offsets (n_blocks + 1), null flags (uint8)
    footer   uint64 each: index offset, n_docs, n_tokens, n_blocks, bits, block length; magic

A reader takes any range of tokens from the blocks it touches, unpacked with numpy.

Null texts count as empty: only the end id.  Ids are whole numbers; a null id sorts last
and stays null.  Rows that repeat an id stand side by side, ordered by a hash of the text.
An empty table gives no rows.  Long texts are written block by block and read whole.
Other columns, also of the names used here, are not read.  Shard names carry the writing
attempt, and only shards in the returned list count, so a task that runs again leaves
no double.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstrand.llm import bpe, repeats, scratch
from evenstrand.ship import ship

MAGIC = b"EVENTOK1"
FOOTER = struct.Struct("<6Q8s")
BLOCK = 1 << 16
#: Characters of words kept between batches; dropping them changes no result.
CACHE = 6_000_000
#: Ids read at once.
READ = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    planes = ((ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):  # whole bytes
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Writes one shard; add() takes ids of documents in order."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.docs, self.starts, self.offsets, self.nulls = [], [0], [len(MAGIC)], []
        self.rest, self.held = [], 0
        sink.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {ids.max()} needs more than {self.bits} bits")
        self.docs.append(0 if doc is None else doc)
        self.nulls.append(doc is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids.astype(np.uint32))
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.rest)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._block(ids[at : at + self.block])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        for x in (self.docs, self.starts, self.offsets):
            self.sink.write(np.array(x, "<i8").tobytes())
        self.sink.write(np.array(self.nulls, np.uint8).tobytes())
        self.sink.write(FOOTER.pack(self.offsets[-1], len(self.docs), self.starts[-1], len(self.offsets) - 1, self.bits, self.block, MAGIC))


class Reader:
    """Random access to one shard through a seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, os.SEEK_END)
        size = source.tell()
        source.seek(size - FOOTER.size)
        index, n_docs, self.n_tokens, n_blocks, self.bits, self.block, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(index)
        data = source.read(size - FOOTER.size - index)
        numbers = np.frombuffer(data, "<i8", 2 * n_docs + n_blocks + 2)
        self.docs, self.starts, self.offsets = np.split(numbers, [n_docs, 2 * n_docs + 1])
        self.nulls = np.frombuffer(data, np.uint8, n_docs, 8 * len(numbers)).astype(bool)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start..end-1 of the shard."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        out, at = [], 0
        for b in range(first, last + 1):
            n = min(self.block, self.n_tokens - b * self.block)
            size = int(self.offsets[b + 1] - self.offsets[b])
            out.append(unpack(data[at : at + size], self.bits, n))
            at += size
        return np.concatenate(out)[start - first * self.block : end - first * self.block]


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


#: Characters whose normalisation looks at no neighbour: ASCII and the Latin letters beside it, but for the one that lower-cases to two.
PLAIN = re.compile("[\\x00-\\x7f\\u00a1-\\u012f\\u0131-\\u024f]*")
#: The normaliser whose effect on such characters is their lower case.
LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class Parts:
    """A vocabulary's own cut of words into parts, and the ids of parts by vectorised merge rounds (see bpe).

    For tokenizers that lower-case, cut by a pattern, spell parts in byte letters with a
    mark on the last, and merge by a table in which each merge makes a symbol of its own,
    later than its halves: `of` gives None for any other.
    """

    def __init__(self, spec: dict, pattern: str):
        vocab, suffix = spec["vocab"], spec["end_of_word_suffix"]
        self.find = re.compile(f"{plain_pattern(pattern)}|\n").findall  # a line end is a part of its own
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[c + s] for c in letters], np.int64) for s in ("", suffix))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        ranks = np.full(max(vocab.values()) + 1, bpe.NONE)
        letters_at, pairs = {*self.inner.tolist(), *self.last.tolist()}, {}
        for rank, (left, right) in enumerate(merges):
            to = vocab[left + right]
            if to in letters_at or ranks[to] != bpe.NONE or any(x not in letters_at and ranks[x] == bpe.NONE for x in (vocab[left], vocab[right])):
                raise ValueError(f"merge {rank} makes no symbol of its own, or comes before its halves")
            ranks[to], pairs[vocab[left], vocab[right]] = rank, to
        self.merges = bpe.Merges(pairs, ranks)

    @classmethod
    def of(cls, spec: dict) -> Parts | None:
        model, cut = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and model.get("end_of_word_suffix")
        lowers = (spec["normalizer"] or {}).get("normalizers") == LOWERS
        cuts = [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and "Regex" in cut[0]["pattern"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        return cls(model, cut[0]["pattern"]["Regex"]) if plain and lowers and cuts else None

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts end to end, and how many each has."""
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(x) for x in raw], np.int64)
        sym = self.inner[data]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[data[ends]]
        sym, word = self.merges.merge(sym, np.repeat(np.arange(len(raw)), size))
        return sym.astype(np.uint32), np.bincount(word, minlength=len(raw))


def plain_pattern(pattern: str) -> str:
    """The pattern for lower-cased PLAIN characters, with letters, numbers and white space spelt out."""
    import regex

    text = "".join(c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)).lower()
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(name, "".join(sorted(set(regex.findall(name, text)))))
    return pattern.replace(r"\s", r"\t-\r ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others follow U+00FF in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + other.index(b)) for b in range(256)]


class Lists:
    """Lists of ids by name, kept in flat arrays."""

    def __init__(self):
        self.at: dict = {}
        self.flat, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))

    def of(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists of these numbers end to end, and how many each has."""
        if not len(used):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = self.sizes[used]
        place = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[used] - place, sizes) + np.arange(int(sizes.sum()))], sizes


class WordEncoder:
    """The tokenizers library's ids, found once per word where its pre-tokenizer never looks over ASCII spaces.

    That holds for vocabularies that drop white space before the merges, as checked on
    load.  Words of PLAIN characters are cut into parts and merged here if Parts knows the
    vocabulary; the library encodes the others, and all that hold an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        whole = [self.lib.encode(t, add_special_tokens=False).ids for t in ("ab  cd\nef", "ab", "cd", "ef")]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [x["content"] for x in spec["added_tokens"]]
        self.by_word = whole[0] == whole[1] + whole[2] + whole[3] and not any(re.search(r"\s", x) for x in added)
        self.parts = Parts.of(spec) if self.by_word else None
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.clear()

    def clear(self) -> None:
        self.words, self.known, self.held = Lists(), Lists(), 0
        self.known.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, new: list[bytes]) -> None:
        """Keep the ids of words not met before."""
        own, rest = self._split(new) if self.parts else ([], new)
        if own:
            cut = self.parts.find((b"\n".join(own) + b"\n").decode().lower())
            used = np.fromiter(map(self.known.at.get, cut, repeat(-1)), np.int64, len(cut))
            missing = np.flatnonzero(used < 0)
            if len(missing):
                met = [cut[i] for i in missing.tolist()]
                unknown = list(dict.fromkeys(met))
                self.known.add(unknown, *self.parts.ids(unknown))
                self.held += sum(map(len, unknown))
                used[missing] = np.fromiter(map(self.known.at.__getitem__, met), np.int64, len(met))
            ids, sizes = self.known.of(used)
            ends = np.cumsum(sizes)[used == self.known.at["\n"]]
            self.words.add(own, ids, np.diff(ends, prepend=0))
        if rest:
            lists = [e.ids for e in self.lib.encode_batch([w.decode() for w in rest], add_special_tokens=False)]
            sizes = np.array([len(x) for x in lists], np.int64)
            self.words.add(rest, np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())), sizes)
        self.held += sum(map(len, new))

    def _split(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Words to cut and merge here, and the others."""
        plain = [w.isascii() or PLAIN.fullmatch(w.decode()) is not None for w in words]
        if self.added.search(b"\n".join(words).decode()):
            plain = [p and not self.added.search(w.decode()) for p, w in zip(plain, words, strict=True)]
        return list(compress(words, plain)), [w for w, p in zip(words, plain, strict=True) if not p]

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, the end id after each, and offsets."""
        if not self.by_word:
            lists = [[*e.ids, end] for e in self.lib.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            return np.array([i for x in lists for i in x], np.uint32), offsets
        if self.held > CACHE:
            self.clear()
        words, counts = [], []
        for text in texts:
            mine = text.split()
            counts.append(len(mine))
            words += mine
        used = np.fromiter(map(self.words.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(used < 0)
        if len(missing):
            met = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(met)))
            used[missing] = np.fromiter(map(self.words.at.__getitem__, met), np.int64, len(met))
        ids, sizes = self.words.of(used)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        offsets = np.concatenate([[0], np.cumsum(np.diff(cuts) + 1)]).astype(np.int64)
        out = np.full(offsets[-1], end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = ids
        return out, offsets


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, out: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into shards under out, in ascending id order over all shards.

    Gives the list of shards: shard (0, 1, ...), file, n_docs, n_tokens, start (tokens in the shards before).
    """
    spark = docs.sparkSession
    ship(spark)
    dealt = docs.select(repeats.doc_key(id_col).alias("doc"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange(scratch.partitions(spark), "doc", "tie").sortWithinPartitions("doc", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = file_system(out)
        system.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        words = encoder(path)
        with system.open_output_stream(f"{folder}/{file}") as sink:
            writer = Writer(sink, max(1, (max(words.size - 1, end)).bit_length()))
            for whole in batches:
                for batch in repeats.chunks(whole):
                    ids, offsets = words.encode(repeats.encoded(batch), end)
                    for i, (doc, none) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("no_id").to_pylist(), strict=True)):
                        writer.add(None if none else doc, ids[offsets[i] : offsets[i + 1]])
            writer.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{out}/{file}", "n_docs": len(writer.docs), "n_tokens": int(writer.starts[-1])}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shards = scratch.table(dealt.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long"), "shards")
    rows = shards.orderBy("shard").collect()  # one row per shard
    start, listed = 0, []
    for r in rows:
        listed.append((*r, start))
        start += r.n_tokens
    schema = T.StructType([*shards.schema.fields, T.StructField("start", T.LongType())])
    return spark.createDataFrame(listed, schema)


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it over all shards), ids (little-endian unsigned 32-bit integers)."""
    ship(spark)
    files = shards.select("file", "start").repartition(max(1, shards.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = file_system(row["file"])
                with system.open_input_file(name) as source:
                    reader = Reader(source)
                    at, n = 0, len(reader.docs)
                    while at < n:
                        end = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + READ, "right")) - 1)
                        ids = reader.tokens(int(reader.starts[at]), int(reader.starts[end])).astype("<u4").tobytes()
                        cuts = (4 * (reader.starts[at : end + 1] - reader.starts[at])).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[at:end], mask=reader.nulls[at:end]), pa.array(reader.starts[at:end] + row["start"]), pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                            ["doc_id", "start", "ids"],
                        )
                        at = end

    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = write_shards(docs, scratch.new_path(spark, "tokens"), default_vocabulary(), end=1)
    return read_shards(spark, shards).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
