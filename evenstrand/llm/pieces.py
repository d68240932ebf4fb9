"""SentencePiece encoding and decoding with numpy.

BPE models only.  A text is cut into words that no piece can cross (a run of spaces and
what follows; line ends where no piece holds one).  Words not met before are encoded
together: flat symbol arrays, the minimum pair rank of each word by a segmented
minimum, the leftmost pair of that rank merged in all words at once, compaction, until
no pair remains (see bpe).  Symbols left outside the vocabulary fall back to bytes, or to
the unknown id.

Null texts count as empty: only the begin and end ids.  Words kept between batches are
dropped at CACHE, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import bpe, repeats
from evenstrand.ship import ship

SPACE = "▁"
#: Characters of words kept between batches.
CACHE = 2_000_000


class Model:
    """The vocabulary of a BPE model file, its pair table and its words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        odd = np.array([lib.is_control(i) or lib.is_unknown(i) for i in range(n)])
        byte = np.array([lib.is_byte(i) for i in range(n)])
        scores = np.array([lib.get_score(i) for i in range(n)])
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in np.flatnonzero(byte)}
        real = {pieces[i]: int(i) for i in range(n) if not odd[i] and not byte[i]}
        assert not any(lib.is_unused(i) for i in range(n)), "models with unused pieces are not supported"
        # symbols: vocabulary ids, then characters of pieces that are no pieces themselves
        self.symbols = dict(real)
        for c in sorted({c for p in real for c in p} - set(real)):
            self.symbols[c] = n + len(self.symbols) - len(real)
        self.n_vocab, self.n_symbols = n, n + len(self.symbols) - len(real)
        _, rank = np.unique(-scores, return_inverse=True)
        pairs = {}
        for piece, i in real.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.merges = bpe.Merges(pairs, np.append(rank, np.full(self.n_symbols - n, bpe.NONE)))
        inner = {c for p in real if len(p) > 1 for c in p}
        assert not any(SPACE in p.lstrip(SPACE) for p in real), "pieces that go on over a space are not supported"
        self.pattern = re.compile(r" *[^ \n]+| +|\n" if "\n" not in inner else r" *[^ ]+| +")
        self.texts = [b"" if odd[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if self.unk >= 0:
            self.texts[self.unk] = " ⁇ ".encode()
        self.is_byte = byte
        self.text_size = np.array([len(t) for t in self.texts])
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer(b"".join(self.texts), np.uint8)
        # what the library's normaliser does with spaces at the front
        self.prefix = " " if lib.encode_as_pieces("a")[0].startswith(SPACE) else ""
        assert lib.encode_as_pieces("a  b  Ωé") == [*self._spell(lib, "a  b  Ωé")], "models that change characters are not supported"
        self.clear()

    @staticmethod
    def _spell(lib, text: str) -> list[str]:
        """The pieces of a text, if they spell it out unchanged."""
        got = lib.encode_as_pieces(text)
        raw = b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.encode() for p in got).decode()
        return got if raw in (SPACE + text.replace(" ", SPACE), text.replace(" ", SPACE)) else []

    def clear(self) -> None:
        self.word_at: dict[str, int] = {}
        self._flat, self._sizes, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    # encoding

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end (flat), and offsets."""
        chars = "".join(words).replace(" ", SPACE)
        code = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(code, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in distinct.tolist()], np.int64)
        sym = known[inverse].astype(np.int64) if len(code) else np.zeros(0, np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        sym, word = self.merges.merge(sym, word)
        out = (sym < 0) | (sym >= self.n_vocab)
        if out.any():
            sym, word = self._fall_back(sym, word, out)
        return sym.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def _fall_back(self, sym: np.ndarray, word: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = {i: c for c, i in self.symbols.items() if i >= self.n_vocab}
        spelt = {}
        for s in np.unique(sym[out]).tolist():
            char = names[s] if s >= 0 else chr(-1 - s)
            spelt[s] = [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk]
        count = np.ones(len(sym), np.int64)
        where = np.flatnonzero(out)
        count[where] = [len(spelt[s]) for s in sym[where].tolist()]
        start = np.cumsum(count) - count
        full = np.repeat(sym, count)
        for i in where.tolist():
            ids = spelt[int(sym[i])]
            full[start[i] : start[i] + len(ids)] = ids
        return full, np.repeat(word, count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each between the begin and end id, and offsets."""
        if self.held > CACHE:
            self.clear()
        find, at, counts, flat = self.pattern.findall, self.word_at, [], []
        for text in texts:
            words = find(self.prefix + text.replace(SPACE, " ")) if text else []  # to the model both are the same mark
            counts.append(len(words))
            flat += words
        new = [w for w in dict.fromkeys(flat) if w not in at]
        if new:
            ids, offsets = self.encode_words(new)
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            self.held += sum(map(len, new))
            self._flat, self._sizes = np.concatenate([self._flat, ids]), np.concatenate([self._sizes, np.diff(offsets)])
            self._starts = np.cumsum(self._sizes) - self._sizes
        ends = np.array([self.bos, self.eos], np.int32)
        used = np.fromiter((at[w] for w in flat), np.int64, len(flat))
        sizes = self._sizes[used] if len(used) else used
        place = np.cumsum(sizes) - sizes
        ids = self._flat[np.repeat(self._starts[used] - place, sizes) + np.arange(int(sizes.sum()))] if len(used) else np.zeros(0, np.int32)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])] if counts else np.zeros(1, np.int64)
        n = np.diff(cuts)
        offsets = np.concatenate([[0], np.cumsum(n + 2)]).astype(np.int64)
        out = np.empty(offsets[-1], np.int32)
        inner = np.ones(len(out), bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        out[inner] = ids
        out[offsets[:-1]], out[offsets[1:] - 1] = ends
        return out, offsets

    # decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts that ids spell; bytes that are no UTF-8 become U+FFFD each."""
        sizes = self.text_size[ids]
        place = np.cumsum(sizes) - sizes
        data = self.text_flat[np.repeat(self.text_start[ids] - place, sizes) + np.arange(int(sizes.sum()))].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        out = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            mine = ids[offsets[i] : offsets[i + 1]]
            real = mine[self.text_size[mine] > 0][:1]
            skip = self.prefix and len(real) and not self.is_byte[real[0]] and data[a : a + 1] == b" "
            try:
                out.append(data[a + bool(skip) : b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_bytes(mine, bool(skip)))
        return out

    def _decode_bytes(self, ids: np.ndarray, skip: bool) -> str:
        parts, run = [], b""

        def flush(run: bytes) -> str:
            text = ""
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        text, run = text + run[:n].decode(), run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    text, run = text + "�", run[1:]
            return text

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.texts[i]
            elif self.texts[i]:
                parts += [flush(run), self.texts[i].decode()]
                run = b""
        return "".join([*parts, flush(run)])[1 if skip else 0 :]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col: the text's ids as little-endian unsigned 32-bit integers, begin and end ids included."""
    return _mapped(docs, path, text_col, [(ids_col, "ids")])


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with ids_col and the text decoded from them."""
    return _mapped(docs, path, text_col, [(ids_col, "ids"), (decoded_col, "decoded")])


def _mapped(docs: DataFrame, path: str, text_col: str, wanted: list[tuple[str, str]]) -> DataFrame:
    ship(docs.sparkSession)
    kinds = {"ids": ("binary", pa.binary()), "decoded": ("string", pa.string())}
    names = [w for _, w in wanted]
    from pyspark.sql import types as T

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([packed.schema["row"], *(T.StructField(w, T.BinaryType() if w == "ids" else T.StringType()) for w in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for whole in batches:
            for batch in repeats.chunks(whole):
                ids, offsets = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
                raw = ids.astype("<u4").tobytes()
                cuts = (4 * offsets).tolist()
                columns = {"ids": pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())}
                if "decoded" in names:
                    columns["decoded"] = pa.array(bpe.decode(ids, offsets), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(columns[w].cast(kinds[w][1]) for w in names)], ["row", *names])

    out = packed.mapInArrow(run, schema)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in [c for c, _ in wanted]), *(F.col(w).alias(c) for c, w in wanted))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_model())
    return docs.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
