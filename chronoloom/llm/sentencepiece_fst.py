"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into one weighted transducer from characters to pieces, the composition N o P o G of

* N, the normaliser, of two states: the start writes a mark (U+2581) before a text that is not empty, reading nothing; then a space
  (or a mark) is read and a mark written, and any other character is copied;
* P, the closure of all pieces: a trie whose states lead back to the start where a piece ends, with byte fallback as a further path
  from the start: a character that is no piece is read, and the pieces of its UTF-8 bytes (or the unknown piece) are written;
* G, the weights: states are last pieces, and an arc to the next piece has a weight. In a unigram model that is
  the piece's negated score, whatever came before. In a BPE model it is zero if the model's merges, run over the
  last piece and the next joined, end in just these two, else infinite: of all sequences of pieces with a text's
  characters, exactly one has all its neighbours so, the model's own segmentation, and it has the least total weight.

N and P are composed when the model is compiled (trie arcs read what the normaliser reads); G's arcs are weighed as they are
met, and kept. An input is composed with the machine position by position, and the shortest path is taken in the tropical
semiring (min, +) by relaxing arcs in order of position. In a BPE model at most one state of G has a finite weight at a position (every
prefix has one segmentation), so a state is a position there too.

Pieces that start with a mark have it only in front, so no path crosses the start of a run of spaces, nor a
character that occurs in no longer piece, nor the end of a word where no piece has more after a letter (found out when
the model is compiled): the transducer is back in its start state there. A text so falls into segments
whose shortest paths are independent; a batch composes each distinct segment once, and ids of texts are gathered from
those of their segments. The most frequent segments' paths are kept from batch to batch, in a table of bounded size.

Decoding joins the pieces' bytes, turns the marks into spaces and drops the first.

Defined results. A null or empty text has no ids and decodes to an empty text. Control pieces in a text are ordinary
characters. A text that itself has U+2581 decodes to spaces in its place. Other normalisers than the one above (a model with a
character map, or that removes spaces) are an error, and so are models with user-defined pieces, which are matched before all others. Only the id and text columns are read.
"""

from __future__ import annotations

import array
import functools
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, ragged, segments, slices, table

MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
SLICE, KEPT, LONG_SEGMENT, MEMO = 2 << 20, 300_000, 48, 300_000


class Grammar:
    """G: the weight of a piece after the last one. Arcs are weighed when they are first met."""

    def __init__(self, score: dict[str, float], unigram: bool):
        self.score, self.unigram = score, unigram
        self.unknown = 10.0 - min(score.values())
        self.least = min(0.0, *(-x for x in score.values())) if unigram else 0.0  # no arc weighs less
        self.forget()

    def forget(self) -> None:
        """Let go of the arcs of last pieces; a worker may go on to other tasks."""
        self._arcs: dict[str | None, dict[str, float]] = {}
        self._kept = 0

    def table(self) -> dict[str | None, dict[str, float]]:
        """Weights known of what follows each last piece (None: the start, and in a unigram model whatever came before)."""
        if self._kept >= MEMO:
            self.forget()
        return self._arcs

    def weigh(self, last: str | None, piece: str, arcs: dict[str, float]) -> float:
        """The weight of an arc, which is entered among arcs."""
        if self.unigram:
            w = -self.score[piece] if piece in self.score else self.unknown
        else:
            w = 0.0 if self._merged((last or "") + piece) == ([piece] if last is None else [last, piece]) else math.inf
        self._kept += 1
        arcs[piece] = w
        return w

    def _merged(self, text: str) -> list[str]:
        """The BPE model's own segmentation: join the neighbours whose join scores best, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], -math.inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model's normaliser is not supported")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("unigram and BPE models only")
        if any(p.type == USER for p in m.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.unknown_id = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == 3 else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.encode() for p in m.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a space")
        self.start = self._compile()
        self.grammar = Grammar({p.piece: p.score for p in m.pieces if p.type == NORMAL}, m.trainer_spec.model_type == 1)
        # Characters that stand alone on every path.
        joined = set(itertools.chain.from_iterable(p for p in self.ids if len(p) > 1))
        self.splits_at_line_end = "\n" not in joined
        self.splits_after_letters = not any(a.isalpha() and not b.isalpha() for p in self.ids for a, b in itertools.pairwise(p))

    @functools.cache  # noqa: B019  one for each model
    def surfaces(self) -> pa.Array:
        """Bytes of every piece, then those of every piece that opens a text."""
        return pa.array([*self.surface, *(x.removeprefix(MARK.encode()) for x in self.surface)], pa.large_binary())

    def _compile(self) -> dict:
        """N o P but for the default arc of byte fallback, as the start's arcs: an arc by character read leads to a state (its arcs, the piece
        written on the way back to the start, or none)."""
        start: dict = {}
        for piece in self.ids:
            state = start
            for c in piece:
                arc = " " if c == MARK else c  # N writes a mark for what is read as a space
                state = state.setdefault(arc, {})
            state[""] = piece

        def settled(arcs: dict) -> dict:
            return {c: (settled(state), state.get("")) for c, state in arcs.items() if c}

        return settled(start)

    def shortest(self, segment: str) -> list[str]:
        """What the shortest path writes: pieces, and characters that take byte fallback. The segment is composed with
        the machine as it is read."""
        n, start, grammar, inf = len(segment), self.start, self.grammar, math.inf
        table, least, unigram = grammar.table(), grammar.least, grammar.unigram
        weight: list[float] = [0.0] + [inf] * n
        last: list[str | None] = [None] * (n + 1)
        for i in range(n):
            base = weight[i]
            if base == inf:
                continue
            before = None if unigram else last[i]
            arcs = table.get(before)
            if arcs is None:
                arcs = table[before] = {}
            lightest, ways, alone, j = base + least, start, False, i
            while j < n and (state := ways.get(segment[j])) is not None:
                j += 1
                ways, piece = state
                if piece is not None:
                    alone = alone or j == i + 1
                    if lightest < weight[j]:  # else no arc can relax the position
                        w = arcs.get(piece)
                        w = base + (grammar.weigh(before, piece, arcs) if w is None else w)
                        if w < weight[j]:
                            weight[j], last[j] = w, piece
            if not alone and lightest < weight[i + 1]:
                c = MARK if segment[i] == " " else segment[i]
                w = arcs.get(c)
                w = base + (grammar.weigh(before, c, arcs) if w is None else w)
                if w < weight[i + 1]:
                    weight[i + 1], last[i + 1] = w, c
        out, at = [], n
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def encode_segment(self, segment: str) -> list[int]:
        ids: list[int] = []
        for piece in self.shortest(segment):
            at = self.ids.get(piece)
            if at is not None:
                ids.append(at)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif not ids or ids[-1] != self.unknown_id:
                ids.append(self.unknown_id)
        return ids


@functools.cache
def transducer(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


class Encoder:
    """Encodes batches; keeps the ids (as bytes of 32-bit integers) of segments seen."""

    def __init__(self, fst: Transducer):
        self.fst, self.known = fst, {}

    def segment_ids(self, segment: str) -> bytes:
        got = self.known.get(segment)
        if got is None:
            if self.fst.splits_after_letters and not segment[-1].isalpha():
                n = len(segment)
                while n and not segment[n - 1].isalpha():
                    n -= 1
                if n:  # no piece goes on after letters: a word and what follows it are segments of their own
                    return self.segment_ids(segment[:n]) + self.segment_ids(segment[n:])
            got = array.array("i", self.fst.encode_segment(segment)).tobytes()
            if len(segment) <= LONG_SEGMENT:
                if len(self.known) >= KEPT:
                    for old in list(itertools.islice(self.known, KEPT // 2)):  # the half that came first
                        del self.known[old]
                self.known[segment] = got
        return got

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, n + 1 offsets)."""
        fst = self.fst
        col = col.fill_null("")
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        text = col
        if pc.any(pc.match_substring(text, MARK)).as_py():
            text = pc.replace_substring(text, MARK, " ")  # N reads both alike
        if fst.prefix:  # N's first arc
            text = pc.if_else(pc.equal(col, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        # Cut before a space that follows none, and on both sides of a line end. U+001E marks the cuts.
        cut = "\x1e"
        if pc.any(pc.match_substring(text, cut)).as_py():
            return self._each(text.to_pylist())
        text = pc.replace_substring(text, " ", cut + " ")
        if pc.any(pc.match_substring(text, f" {cut} ")).as_py():
            text = pc.replace_substring(text, f" {cut} ", "  ")
            text = pc.replace_substring(text, f" {cut} ", "  ")
        if fst.splits_at_line_end:
            text = pc.replace_substring(text, "\n", f"{cut}\n{cut}")
        parts = pc.split_pattern(text, cut)
        words = pc.dictionary_encode(parts.flatten())
        return self._gather(words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), segments(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._gather(texts, np.arange(len(texts)), np.arange(len(texts) + 1))

    def _gather(self, distinct: list[str], which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.segment_ids(s) if s else b"" for s in distinct]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        own = lengths[which]
        return flat[ragged(segments(lengths)[:-1][which], own)], segments(own)[at]


def decode(ids: np.ndarray, at: np.ndarray, fst: Transducer) -> pa.Array:
    """Texts, as UTF-8 bytes, of ids on end with n + 1 offsets."""
    ids = ids.astype(np.int64)
    if fst.prefix:  # a text's first piece loses its first mark
        ids[at[:-1][np.diff(at) > 0]] += len(fst.surface)
    parts = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), fst.surfaces().take(pa.array(ids)))
    return pc.replace_substring(pc.binary_join(parts, pa.scalar(b"", pa.large_binary())), MARK.encode(), b" ")


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per document (doc_id, n_tokens, ids_crc32, decoded_bytes, round_trip[, ids]). round_trip: the ids decode to the
    text as it was."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_bytes long, round_trip boolean" + ", ids array<int>" * ids

    def run(batches):
        encoder = Encoder(transducer(model_path))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                col = part.column("text")
                own, at = encoder.encode(col)
                cuts = at.tolist()
                text = decode(own, at, encoder.fst)
                same = pc.equal(text, col.fill_null("").cast(pa.large_string()).cast(pa.large_binary()))
                wide = own.astype("<u4")
                columns = [part.column("doc_id"), pa.array(np.diff(at)), pa.array([zlib.crc32(wide[a:b]) for a, b in itertools.pairwise(cuts)], pa.int64()), pc.binary_length(text).cast(pa.int64()), same]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own)))
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_crc32", "decoded_bytes", "round_trip", "ids"][: len(columns)])
        encoder.fst.grammar.forget()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), _model())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_bytes, round_trip, ids) of every row of docs."""
    return encode_documents(docs, _model(), ids=True)
