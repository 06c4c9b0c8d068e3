"""SentencePiece encoding and decoding (operator 6), merge-type (BPE) models.

*Prefix table.* The encoding of a text's prefix ends in exactly one token, and a
token sequence is an encoding if and only if each neighbouring pair is the
encoding of its own text. So the last token of every prefix is found from left to
right: an Aho-Corasick automaton over the pieces gives the tokens that end at each
position, and the one that is compatible with the last token before it is stored.
The ids are then read from the table backwards. Pair compatibility is tested on
the two pieces' text alone and remembered.

*Segments.* No piece holds a space mark after another character, nor a newline or
tab, so merges never cross these places. Texts are cut there with numpy, equal
segments of a block are encoded once (:mod:`quire.llm.words` hashes them), and ids
are gathered back by position. Segments are remembered within a task and pair tests
per Python worker, up to a fixed number of entries; this only saves time, and an idle
worker holds no segment.

Only models that these rules hold for are accepted (identity normaliser, dummy
prefix, byte fallback, no piece that crosses a cut): :class:`Model` checks them.

Defined results: null or empty texts give only the begin and end ids and decode
to the empty string; texts of any length are encoded whole; repeated rows give
equal rows; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.session import ship_package

MARK = "▁"
REMEMBER = 150_000          # segments, twice
REMEMBER_PAIRS = 200_000
CUTS = b"\n\t"
_EVER = float("inf")


class Model:
    """Pieces of a SentencePiece BPE model, as plain data that travels to tasks."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids]
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in ids if not special[i] and not sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.scores and not sp.is_byte(i)}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.name = hashlib.sha256(repr((self.pieces, sorted(self.scores.items()))).encode()).hexdigest()
        crossing = [p for p in self.scores if MARK in p.lstrip(MARK) or any(chr(c) in p for c in (*CUTS, 0x20))]
        if crossing or len(self.bytes_) != 256 or min(self.begin, self.end) < 0:
            raise ValueError("not a byte-fallback BPE model whose pieces stay inside segments")
        if sp.encode(" a  AÅÅ") != sp.encode(MARK + "a" + MARK * 2 + "AÅÅ") or \
                sp.decode(sp.encode("  Å ")) != "  Å ":
            raise ValueError("not a model with the identity normaliser and a dummy prefix")
        self.text = [b""] * len(self.pieces)   # what each id decodes to
        for p, i in self.ids.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes_.items():
            self.text[i] = bytes([b])


class Coder:
    """Encoder and decoder of one model, with its automaton and memories."""

    def __init__(self, model: Model):
        import ahocorasick
        self.model = model
        self.automaton = ahocorasick.Automaton()
        self.known = {p for p in model.ids if len(p) == 1}
        self.size = {i: len(p) for p, i in model.ids.items()}
        self.grown: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.memory: dict[int, bytes] = {}       # segments met lately
        self.older: dict[int, bytes] = {}        # and before that
        for p, i in model.ids.items():
            if self.edges(i) is not None:        # others end no encoding
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        lengths = np.array([len(t) for t in model.text], np.int64)
        self.text_sizes = lengths
        self.text_starts = np.cumsum(lengths) - lengths
        self.text_pool = np.frombuffer(b"".join(model.text), np.uint8)

    def edges(self, token: int) -> tuple[list, list] | None:
        """How a piece grows when its text is merged (best score first, leftmost of
        equals): its successive first and last parts with the score each was made
        at. None if its text does not merge back into the piece."""
        got = self.grown.get(token, ())
        if got != ():
            return got
        piece, scores = self.model.pieces[token], self.model.scores
        parts = list(piece)
        left, right = [(parts[0], _EVER)], [(parts[-1], _EVER)]
        while len(parts) > 1:
            best, at = None, -1
            for j in range(len(parts) - 1):
                s = scores.get(parts[j] + parts[j + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, j
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 1:
                right.append((parts[-1], best))
        got = self.grown[token] = (left, right) if parts == [piece] else None
        return got

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their own text: as both grow,
        no merge across their border comes first. ``before`` is the number of ids
        where ``token`` begins the text."""
        mine = self.edges(token)
        if before == len(self.model.pieces) or mine is None:
            return mine is not None
        return self._apart(self.edges(before)[1], mine[0])

    def _apart(self, last: list, first: list) -> bool:
        i = j = 0
        scores = self.model.scores
        while True:
            next_i = last[i + 1][1] if i + 1 < len(last) else -_EVER
            next_j = first[j + 1][1] if j + 1 < len(first) else -_EVER
            across = scores.get(last[i][0] + first[j][0])
            if across is not None and across > next_i and across >= next_j:
                return False
            if next_i == next_j == -_EVER:
                return True
            if next_i >= next_j:
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        """Give the memory of segments back, at the end of a task."""
        self.memory, self.older = {}, {}

    def _run(self, text: str) -> list[int]:
        """Ids of a text of known characters, by the prefix table."""
        many = len(self.model.pieces)
        last = [-1] * (len(text) + 1)    # the last token of each prefix
        last[0] = many
        fits = self.fits
        for stop, (size, token) in self.automaton.iter(text):
            stop += 1
            if last[stop] >= 0:
                continue
            key = last[stop - size] * many + token
            ok = fits.get(key)
            if ok is None:
                if len(fits) >= REMEMBER_PAIRS:
                    fits.clear()
                ok = fits[key] = self.compatible(last[stop - size], token)
            if ok:
                last[stop] = token
        ids, at, size = [], len(text), self.size
        while at:
            token = last[at]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids

    def segment(self, text: str) -> list[int]:
        """Ids of a segment; characters without a piece become byte tokens."""
        if self.known.issuperset(text):
            return self._run(text)
        ids, run = [], ""
        for c in [*text, None]:
            if c in self.known:
                run += c
                continue
            if run:
                ids, run = ids + self._run(run), ""
            if c is not None:
                ids += [self.model.bytes_[b] for b in c.encode()]
        return ids

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block of marked bytes, and where each text's begin."""
        space = data == 0x20
        cut = np.isin(data, list(CUTS))
        start = cut.copy()
        start[1:] |= (space[1:] & ~space[:-1]) | cut[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(start | edge[:-1])
        ends = np.append(starts[1:], len(data))
        keys = W.rolling(W._BYTE_VALUES[data], starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        pool = []
        raw, starts_at, ends_at = data.tobytes(), starts.tolist(), ends.tolist()
        for key, j in zip(distinct.tolist(), first.tolist()):
            got = self.memory.get(key)
            if got is None:
                got = self.older.get(key)
                if got is None:
                    text = raw[starts_at[j]:ends_at[j]].decode().replace(" ", MARK)
                    got = array("I", self.segment(text)).tobytes()
                if len(got) <= 64:
                    if len(self.memory) >= REMEMBER:
                        self.older, self.memory = self.memory, {}
                    self.memory[key] = got
            pool.append(got)
        sizes = np.array([len(p) // 4 for p in pool], np.int64)
        flat = np.frombuffer(b"".join(pool), "<u4")
        ids, ends_of = _gather(flat, np.cumsum(sizes) - sizes, sizes, which)
        at = np.searchsorted(starts, offsets)
        return ids, np.concatenate([[0], ends_of])[at]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each id's bytes end."""
        return _gather(self.text_pool, self.text_starts, self.text_sizes, ids)

    def decode(self, ids) -> str:
        """Text of one id sequence: control ids are silent, the dummy prefix goes,
        invalid bytes become U+FFFD."""
        raw, _ = self.decode_bytes(np.asarray(ids, np.int64))
        return _plain(raw.tobytes())

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without begin and end."""
        marked = (" " + text.replace(MARK, " ")).encode() if text else b""
        if not marked:
            return []
        return self.encode_block(np.frombuffer(marked, np.uint8), np.array([0, len(marked)]))[0].tolist()


def _plain(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _gather(flat, starts, sizes, which):
    """Concatenation of flat[starts[w]:starts[w]+sizes[w]] for w in which, and the
    running ends."""
    n = sizes[which]
    ends = np.cumsum(n)
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


_coders: dict[str, Coder] = {}


def coder(model: Model) -> Coder:
    """One coder per model and Python worker."""
    if model.name not in _coders:
        _coders[model.name] = Coder(model)
    return _coders[model.name]


def token_digests(model: Model):
    """Kernel: id, n_tokens, ids_sha256, decoded_sha256 of marked texts."""
    def run(batches):
        c = coder(model)
        ends = [np.array([i], "<u4").tobytes() for i in (model.begin, model.end)]
        try:
            for batch in batches:
                for first, data, offsets in W.string_blocks(batch.column(1), 2 * W.BLOCK_BYTES):
                    if len(data):
                        ids, at = c.encode_block(data, offsets)
                        raw, raw_ends = c.decode_bytes(ids)
                        raw_at = np.concatenate([[0], raw_ends])[at]
                    else:
                        ids, raw = np.zeros(0, "<u4"), np.zeros(0, np.uint8)
                        at = raw_at = np.zeros(len(offsets), np.int64)
                    n, coded, decoded = [], [], []
                    for j in range(len(offsets) - 1):
                        own = ids[at[j]:at[j + 1]]
                        n.append(len(own) + 2)
                        coded.append(hashlib.sha256(ends[0] + own.tobytes() + ends[1]).hexdigest())
                        decoded.append(hashlib.sha256(
                            _plain(raw[raw_at[j]:raw_at[j + 1]].tobytes()).encode()).hexdigest())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            c.forget()
    return run


def sentencepiece_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: one narrow pass."""
    ship_package(docs.sparkSession)
    t = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, " ")
    marked = F.when(t == "", "").otherwise(F.concat(F.lit(" "), t))
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), marked.alias("text")).mapInArrow(
        token_digests(Model(model_path)),
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
