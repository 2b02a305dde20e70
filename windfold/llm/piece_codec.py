"""SentencePiece merge-type encoding and decoding through a prefix table.

Every prefix of a text has one encoding, so it has one last token.  An automaton
over the vocabulary lists the pieces that end at a position; of these the last
token is the one that is compatible with the last token of the prefix before it,
which means that the two pieces, joined and merged by priority, come out as
themselves.  The table of last tokens is filled from left to right and the ids are
read from it backwards.

Pieces never span a place that no piece of the vocabulary spans, so a text falls
into short chunks which are encoded each on its own and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from windfold.llm import common as c

SPACE = "▁"
#: Chunks and pairs of tokens that a worker remembers; beyond that it starts anew, with the same results.
REMEMBERED_CHUNKS, REMEMBERED_PAIRS, LONGEST_CHUNK = 700_000, 2_000_000, 40


class PieceCodec:
    """Vocabulary of one model file; merges take the best score, the leftmost of equal ones.

    The model must be of the merge type with byte fallback, leave texts as they
    are but for one space put before them, and define no symbols of the user;
    others are refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" a  ﬁb ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁb{SPACE}" or sp.piece_to_id("<0x00>") == sp.unk_id():
            raise ValueError(f"{path}: not an identity model with a space before the text and byte fallback")
        size = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        at = {i: bytes([b]) for b, i in enumerate(self.byte)}
        unknown = sp.decode([sp.unk_id()]).encode()
        self.decimals, self.lengths = [f"{i}," for i in range(size)], [*map(len, self.pieces)]
        #: What each id adds to a decoded text.
        self.token_bytes = [at[i] if i in at else unknown if sp.is_unknown(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        joined = sorted({x for p in self.ids if len(p) > 1 for x in p} - {SPACE})
        within = "".join(map(re.escape, joined))
        # a space belongs to what follows it, if no piece has one behind another character
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.chunks = re.compile(f"[{SPACE}{within}]+|[^{SPACE}{within}]", re.S).findall
        else:
            self.chunks = re.compile(f"{SPACE}*[{within}]+|{SPACE}+|[^{SPACE}{within}]", re.S).findall
        self._known: dict[str, tuple[str, bytes]] = {}
        self._pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Symbols that priority merging makes of ``text``, by definition and for short texts only."""
        symbols, score = list(text), self.score
        while True:
            best, where = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if best is None:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def _compatible(self, pair: int, one: int, two: int) -> bool:
        a, b = self.pieces[one], self.pieces[two]
        if len(self._pairs) >= REMEMBERED_PAIRS:
            self._pairs.clear()
        # if both make a piece, that is what comes out
        fits = self._pairs[pair] = a + b not in self.automaton and self.merged(a + b) == [a, b]
        return fits

    def last_tokens(self, chunk: str) -> list[int]:
        """Last token of every prefix of ``chunk``; -1 where a character is no piece of its own."""
        last, pairs, size = [-1] * (len(chunk) + 1), self._pairs, len(self.pieces)
        for end, (length, token) in self.automaton.iter(chunk):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                # nothing merges with what is no piece
                if before >= 0:
                    pair = before * size + token
                    fits = pairs.get(pair)
                    if not (self._compatible(pair, before, token) if fits is None else fits):
                        continue
                last[end] = token
        return last

    def encode_chunk(self, chunk: str) -> list[int]:
        last, lengths = self.last_tokens(chunk), self.lengths
        out, i = [], len(chunk)
        while i:
            token = last[i]
            if token < 0:
                out += [self.byte[b] for b in reversed(chunk[i - 1].encode())]
                i -= 1
            else:
                out.append(token)
                i -= lengths[token]
        out.reverse()
        return out

    def known(self, chunk: str) -> tuple[str, bytes]:
        """Ids of a chunk in decimals, each before a comma, and the bytes that they decode to."""
        ids = self.encode_chunk(chunk)
        entry = "".join([self.decimals[i] for i in ids]), b"".join([self.token_bytes[i] for i in ids])
        if len(chunk) <= LONGEST_CHUNK:
            if len(self._known) >= REMEMBERED_CHUNKS:
                self._known.clear()
            self._known[chunk] = entry
        return entry

    def entries(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Entries of the chunks of ``text`` in order; none of an empty text."""
        if not text:
            return iter(())
        get, make = self._known.get, self.known
        return (get(chunk) or make(chunk) for chunk in self.chunks(SPACE + text.replace(" ", SPACE)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for decimals, _ in self.entries(text) for i in decimals[:-1].split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library gives it, for ids that :meth:`encode` made: the space before the first is taken off."""
        return b"".join([self.token_bytes[i] for i in ids])[1:].decode()


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def model_path() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: token ids without begin or end ids, and the text that they decode to.

    Null and empty texts have no ids.  Identifiers are carried as they are, null
    ones too; repeated rows give repeated results; further columns are ignored.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            for lo, hi in _some(batch.column(1)):
                ids = [pieces.encode(t.as_py()) for t in batch.column(1)[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(ids, pa.list_(pa.int32())), pa.array(map(pieces.decode, ids), pa.string())], names=["_id", "ids", "decoded"])

    c.prepared(docs)
    return c.texts(docs, id_col, text_col).mapInArrow(run, "_id long, ids array<int>, decoded string").select(c.id_back().alias("doc_id"), "ids", "decoded")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, hashed chunk by chunk so that no list of ids is kept.  Cases as in :func:`encoded`."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            rows = [_digest(pieces, t.as_py()) for t in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    c.prepared(docs)
    return c.texts(docs, id_col, text_col).mapInArrow(run, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").select(c.id_back().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


#: Chunks hashed together.
_GROUP = 1 << 16


def _digest(pieces: PieceCodec, text: str) -> tuple[int, str, str]:
    ids, decoded, n, entries, first = hashlib.sha256(), hashlib.sha256(), 0, pieces.entries(text), True
    while held := list(islice(entries, _GROUP)):
        decimals, raw = zip(*held)
        # the text's first chunk loses the space before it, its last the comma behind it
        joined, raw = "".join(decimals), b"".join(raw)
        n += joined.count(",")
        ids.update((joined[:-1] if first else "," + joined[:-1]).encode())
        decoded.update(raw[1:] if first else raw)
        first = False
    return n, ids.hexdigest(), decoded.hexdigest()


def _some(column: pa.Array) -> Iterator[tuple[int, int]]:
    for lo, hi, _, _ in c.slices(column):
        yield lo, hi
