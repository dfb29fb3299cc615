"""Token files: documents as ids on end, with Elias-Fano coded document boundaries.

*File.* ``ids | boundaries | doc ids | footer``, little-endian. Ids are 16-bit where the vocabulary allows, else 32-bit.
Boundaries are the n + 1 offsets of the documents into the ids, a sequence that never falls, coded by Elias and Fano:
of each value, the low ``l = floor(log2(last / count))`` bits are stored as they are, and the high bits as gaps in unary,
about 2 + l bits a document. Two select structures go with the high bits: the position of every ``SAMPLE``-th one bit, so
that an offset is found by a jump and a short scan of words with their popcounts. Document ids are coded alike (less
their minimum) when they do not fall, which the writer sees to, after a bitmap-free count of leading nulls. The footer
has the sizes, ends in the magic bytes, and is read first.

*Writing.* Ranges of the ids' order, one for each partition of the input, come from a sample of the id column alone (``CUTS``
ids a range, ``MOST_CUTS`` in all: it decides where ranges end, not what they hold); a task encodes its rows,
packs each document's ids (zstandard, for the shuffle only) and tells its range; rows go straight to the range's
partition, are sorted there, and streamed to files of about ``FILE_TOKENS`` ids (``FILE_DOCS`` documents at most) under names that no other attempt uses.
An id that fills several ranges (a third of all rows may lack an id) is dealt out to them by the checksum of its documents' token ids.
The committed manifest lists the files that count. A file's first offset is the sum of the files before it.

*Reading.* A file is read in blocks of ``READ_DOCS`` documents: two selects find where a block's offsets stand in the high bits,
and only these are taken apart, so what a reader holds grows neither with the file's documents nor its ids.

*Encoding.* The tokenizer drops white space and never joins across it, so a batch is split at spaces and line ends, and
the library encodes each distinct piece of the batch once; ids of documents are gathered from those of their pieces. The
ids of pieces seen are kept from batch to batch, in a table of bounded size.

Defined results. A null or empty text has the end id alone. Null ids come first. Repeated ids keep all their rows,
ordered by their token ids' checksum and bytes. An empty table writes no file. Only the id and text columns are read.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, input_partitions, map_arrow, materialise, new_path, ragged, segments, slices, table

END_ID, SAMPLE, FILE_TOKENS, FILE_DOCS, SLICE, CUTS, MOST_CUTS, READ_DOCS, READ_IDS, KEPT, JOINED = 2, 256, 64 << 20, 4 << 20, 8 << 20, 100, 1 << 22, 1 << 13, 1 << 20, 400_000, 400
CLOSING = ".,;:!?#$%&*+-/=@^_`~()[]{}\"'\\"  # not those of which special tokens are made
MAGIC = b"CLTOKEF1"
MANIFEST = "shard int, seq int, path string, docs long, tokens long"


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A sequence that never falls, in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("values fall")
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        ones = high + np.arange(n)  # where the one bits stand in the unary code of the gaps
        bits = np.zeros((int(ones[-1]) // 64 + 1 if n else 0) * 64, np.uint8)
        bits[ones] = 1
        low = np.zeros(0, np.uint64)
        if low_bits and n:
            # Low parts as one bit string: each lies in one word or two.
            low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u8"))

    def select(self, k: int) -> int:
        """Position of the k-th one bit: from the sample before it, skip whole words by popcount, then bits."""
        at = int(self.samples[k // SAMPLE])
        left, word = k % SAMPLE, at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return (word << 6) + ((bits & -bits).bit_length() - 1)

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), np.uint64)
        at = k * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        up = (np.uint64(64) - shift) & np.uint64(63)
        part = np.where(over, part | (self.low[np.minimum(word + 1, len(self.low) - 1)] << up), part)
        return part & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return ((self.select(k) - k) << self.low_bits) | int(self._low(np.array([k]))[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Values from start to below end: two selects tell which words of the high bits have their one bits, and these
        words alone are taken apart."""
        if not 0 <= start <= end <= self.n:
            raise IndexError((start, end))
        if start == end:
            return np.empty(0, np.uint64)
        first, last = self.select(start), self.select(end - 1)
        words = self.high[first >> 6 : (last >> 6) + 1]
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")) + (first >> 6 << 6)
        at = int(np.searchsorted(ones, first))
        k = np.arange(start, end)
        return ((ones[at : at + end - start] - k).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(k)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, *sizes = struct.unpack_from("<QQQQQ", data)
        words = np.frombuffer(data, "<u8", offset=40)
        a, b, c = np.cumsum(sizes)
        return cls(n, low_bits, words[:a], words[a:b], words[b:c])


# ---------------------------------------------------------------- files


class TokenFileWriter:
    """Streams ids, and keeps 16 bytes a document until the file is closed."""

    def __init__(self, stream, width: int):
        self.stream, self.kind = stream, "<u2" if width == 2 else "<u4"
        self.width, self.nulls, self.tokens = width, 0, 0
        self.offsets, self.doc_ids = array.array("q", [0]), array.array("q")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is not None:
            self.doc_ids.append(doc_id)
        elif self.doc_ids:
            raise ValueError("null ids must come first")
        else:
            self.nulls += 1
        self.stream.write(ids.astype(self.kind).tobytes())
        self.tokens += len(ids)
        self.offsets.append(self.tokens)

    def close(self) -> tuple[int, int]:
        """Write what follows the ids; (documents, ids)."""
        ids = np.frombuffer(self.doc_ids, np.int64)
        least = int(ids[0]) if len(ids) else 0
        boundaries, doc_ids = EliasFano.encode(np.frombuffer(self.offsets, np.int64)).to_bytes(), EliasFano.encode(ids - least).to_bytes()
        footer = json.dumps({"width": self.width, "docs": len(self), "tokens": self.tokens, "nulls": self.nulls, "least": least, "boundaries": len(boundaries), "doc_ids": len(doc_ids)}).encode()
        self.stream.write(boundaries + doc_ids + footer + struct.pack("<I", len(footer)) + MAGIC)
        self.stream.close()
        return len(self), self.tokens


class TokenFile:
    """Reads a file that allows seeks."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = self._at(max(0, size - 12), 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<I", tail[:4])[0]
        self.meta = m = json.loads(self._at(size - 12 - n, n))
        ids = m["tokens"] * m["width"]
        self.boundaries = EliasFano.from_bytes(self._at(ids, m["boundaries"]))
        self._ids = EliasFano.from_bytes(self._at(ids + m["boundaries"], m["doc_ids"]))
        self.kind = "<u2" if m["width"] == 2 else "<u4"

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        data = self.stream.read(n)
        if len(data) != n:
            raise ValueError("truncated token file")
        return data

    def __len__(self) -> int:
        return self.meta["docs"]

    def doc_ids(self, start: int = 0, end: int | None = None) -> list[int | None]:
        """Ids of documents from start to below end."""
        end, nulls = len(self) if end is None else end, self.meta["nulls"]
        own = self._ids.slice(max(0, start - nulls), max(0, end - nulls)).astype(np.int64) + self.meta["least"]
        return [None] * max(0, min(end, nulls) - start) + own.tolist()

    def blocks(self, docs: int = READ_DOCS, ids: int = READ_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, its n + 1 offsets) of consecutive blocks of documents, of about so many ids."""
        for a in range(0, len(self), docs):
            bounds = self.boundaries.slice(a, min(len(self), a + docs) + 1).astype(np.int64)
            k = 0
            while k < len(bounds) - 1:
                to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + ids, side="right")) - 1)
                yield a + k, bounds[k : to + 1]
                k = to

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._at(start * self.meta["width"], (end - start) * self.meta["width"]), self.kind)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by two selects."""
        return self.tokens(self.boundaries[k], self.boundaries[k + 1])


# ---------------------------------------------------------------- encoding


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_pieces(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, piece of every place, n + 1 offsets of each text's places): texts split at single spaces, with
    line ends and tabs as spaces."""
    col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    for c in "\n\t\r":
        col = pc.replace_substring(col, c, " ")
    parts = pc.split_pattern(col, " ")
    words = pc.dictionary_encode(parts.flatten())
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), segments(counts)


@functools.lru_cache(4096)
def _ends_in_letter(c: str) -> bool:
    """Whether a character, normalised and in lower case, ends in a letter: some then end in a mark."""
    return unicodedata.normalize("NFC", c).lower()[-1].isalpha()


class Encoder:
    """Encodes batches, and keeps the ids (as bytes of 32-bit integers) of pieces seen, in a table of bounded size."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        # Tokens that end a word, where the vocabulary tells them apart.
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Words of letters many at a time: each ends with one token that ends a word, which tells where to cut. If there
        are more such tokens than words in a text, or the vocabulary has none, words are encoded one by one."""
        plain = [p for p in new if p.isalpha()]
        single = [p for p in new if not p.isalpha()]
        texts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)] if self.ends.any() else []
        for words, ids in zip(texts, self._encode([" ".join(x) for x in texts]), strict=True):
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(words):
                single += words
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(words, ends.tolist(), strict=True):
                self.known[w] = raw[at:to]
                at = to
        if not texts:
            single = new
        for p, ids in zip(single, self._encode(single), strict=True):
            self.known[p] = ids.tobytes()

    def pieces(self, distinct: list[str]) -> list[bytes]:
        """Ids of every piece. A word and the marks that close it are encoded each on its own: the tokenizer ends a
        token where letters end, and none of these marks combines with a letter."""
        known = self.known
        if len(known) > KEPT:
            for old in list(itertools.islice(known, len(known) - KEPT // 2)):
                del known[old]
        out = list(map(known.get, distinct))
        cut: dict[int, tuple[str, str]] = {}
        new: dict[str, None] = {}
        lacking = [i for i, x in enumerate(out) if x is None]
        for i in lacking:
            p = distinct[i]
            word = p.rstrip(CLOSING)
            if len(word) < len(p) and word and _ends_in_letter(word[-1]):
                cut[i] = (word, p[len(word) :])
                for part in cut[i]:
                    if part not in known:
                        new[part] = None
            else:
                new[p] = None
        self._learn(list(new))
        for i in lacking:
            out[i] = known[cut[i][0]] + known[cut[i][1]] if i in cut else known[distinct[i]]
        return out

    def encode(self, col: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, each followed by end_id, n + 1 offsets)."""
        distinct, which, at = split_pieces(col)
        ids = self.pieces(distinct.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        starts = segments(lengths)
        if end_id is not None:  # as a further piece at the end of each text
            which = np.insert(which.astype(np.int64), at[1:], len(ids))
            at = at + np.arange(len(at))
            flat, lengths = np.append(flat, np.uint32(end_id)), np.append(lengths, 1)
        own = lengths[which]
        return flat[ragged(starts[which], own)], segments(own)[at]


def width_of(tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


# ---------------------------------------------------------------- Spark


def write_token_files(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS, path: str | None = None) -> DataFrame:
    """Write all documents in the order of their ids; the manifest as a committed table, without an order of its own."""
    import zstandard

    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = range_cuts(docs.select("doc_id"), input_partitions(docs))

    def encode(batches):
        tokenizer = _tokenizer(tokenizer_path)
        encoder, kind = Encoder(tokenizer), "<u2" if width_of(tokenizer) == 2 else "<u4"
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = encoder.encode(part.column("text"), end_id)
                ids = ids.astype(kind)
                own = part.column("doc_id")
                raw = [ids[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]
                check = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
                yield pa.record_batch([pa.array(shard_of(cuts, own, check)), own, pa.array(check), pa.array(map(pack, raw), pa.binary())], names=["shard", "doc_id", "check", "ids"])

    def write(batches):
        width = width_of(_tokenizer(tokenizer_path))
        kind = "<u2" if width == 2 else "<u4"
        unpack = zstandard.ZstdDecompressor().decompress
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        out, done, name, seq, at = None, [], "", 0, None

        def close():
            nonlocal out
            docs, tokens = out.close()
            done.append((at, seq, f"{path}/{name}", docs, tokens))
            out = None

        for batch in batches:
            for shard, doc_id, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if out is not None and (out.tokens >= file_tokens or len(out) >= FILE_DOCS or shard != at):
                    close()
                if out is None:
                    seq = seq + 1 if shard == at else 0
                    name, at = f"{uuid.uuid4().hex}.tok", shard
                    out = TokenFileWriter(fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20), width)
                out.add(doc_id, np.frombuffer(unpack(ids), kind))
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "seq", "path", "docs", "tokens"])

    rows = map_arrow(docs, encode, "shard int, doc_id long, check long, ids binary").repartitionById(len(cuts) + 1, "shard")
    return materialise(map_arrow(rows.sortWithinPartitions("shard", "doc_id", "check", "ids"), write, MANIFEST), "token-manifest")


def _keys(ids: pa.Array) -> np.ndarray:
    """Ids in their order, null first."""
    least = np.iinfo(np.int64).min
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), least, np.maximum(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), least + 1))


def range_cuts(ids: DataFrame, ranges: int) -> np.ndarray:
    """Where ranges - 1 of so many ranges of ids (doc_id) of about equal size end; an id that fills several is there as often."""
    n = ids.count()
    if ranges < 2 or not n:
        return np.empty(0, np.int64)
    share = min(1.0, min(CUTS * ranges, MOST_CUTS) / n)
    sample = ids if share == 1.0 else ids.where(F.rand(11) < share)
    keys = np.sort(_keys(pa.concat_arrays(sample.toArrow().column("doc_id").chunks or [pa.array([], pa.int64())])))
    return keys[len(keys) * np.arange(1, ranges) // ranges] if len(keys) else keys


def shard_of(cuts: np.ndarray, ids: pa.Array, check: np.ndarray) -> np.ndarray:
    """The range of every row, in the order of (id, checksum): what equals several cuts is dealt out between them."""
    keys = _keys(ids)
    low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    return (low + ((high - low + 1) * check >> 32) * (high > low)).astype(np.int32)


def read_token_files(manifest: DataFrame, *, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files in blocks."""
    order = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = filesystem(uri)
                with fs.open_input_file(at) as stream:
                    f = TokenFile(stream)
                    for k, bounds in f.blocks():
                        wide, cuts = f.tokens(bounds[0], bounds[-1]).astype("<u4"), (bounds - bounds[0]).tolist()
                        crc = [zlib.crc32(wide[a:b]) for a, b in itertools.pairwise(cuts)]
                        columns = [pa.array(f.doc_ids(k, k + len(crc)), pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                        if ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(wide.astype(np.int32))))
                        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return map_arrow(files.select("path", "base").repartition(max(1, min(10_000, manifest.count()))), run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
