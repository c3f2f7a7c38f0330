"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

Only the vocabulary comes from the model file; encoding and decoding are the numpy code below.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hardwood.llm.common import in_small_batches, table

SPACE = "▁"
#: A word: the mark of one or more spaces and what follows up to the next. No piece has a mark after another character.
PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Texts are encoded in groups of about this many characters, and this many words are remembered.
GROUP_CHARS, CACHE_WORDS = 4_000_000, 150_000
NONE = np.iinfo(np.int64).max
#: Chars that no piece contains are carried as this minus their code point.
UNKNOWN = -2
SLOT_BITS = 20
LONG_WORD = 64
#: Words encoded together: their arrays fit the processor's cache.
AT_ONCE = 8_000


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class PieceModel:
    """Vocabulary, pair ranks and byte table of a byte-fallback BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        special = [sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces with a space mark after other characters are not supported")
        self.bytes_at = np.zeros(256, np.int64)
        surfaces = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes_at[int(p[1:-1], 16)] = i
                surfaces.append(bytes([int(p[1:-1], 16)]))
            else:
                surfaces.append(b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.surface_len = np.array([len(x) for x in surfaces], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.marked = np.array([p.startswith(SPACE) and not s for p, s in zip(pieces, special, strict=True)])
        # Characters that only occur inside pieces get symbols past the vocabulary.
        self.n_pieces = n
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            ids[c] = len(ids) + n
        self.of_char = UNKNOWN - np.arange(0x110000, dtype=np.int64)
        self.char_of = {}
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
                self.char_of[i] = p
        # Equal scores share a rank, as ties go to the leftmost pair.
        rank_of = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids.values() if i < n}, reverse=True))}
        pairs, inner = {}, set()
        for p, i in ids.items():
            if len(p) < 2:
                continue
            inner.update((ord(a) << 21) | ord(b) for a, b in zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[(ids[p[:k]] << 21) | ids[p[k:]]] = (rank_of[sp.get_score(i)], i)
        # Open addressing: a pair lies in its slot or one of the next.
        self.slots = np.full((1 << SLOT_BITS) + len(pairs), -1, np.int64)
        self.pair_rank = np.full(len(self.slots), NONE)
        self.pair_piece = np.zeros(len(self.slots), np.int64)
        for key, (rank, piece) in pairs.items():
            at = int(_slot(np.array([key]))[0])
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.pair_rank[at], self.pair_piece[at] = key, rank, piece
        self.inner = np.array(sorted(inner), np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't merge) and piece of each pair of symbols."""
        keys = (left << 21) | right  # negative if a symbol is unknown
        at = _slot(keys)
        there = self.slots[at]
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            at[on] += 1
            there = self.slots[at[on]]
            on = on[(there != keys[on]) & (there >= 0)]
        hit = self.slots[at] == keys
        return np.where(hit, self.pair_rank[at], NONE), self.pair_piece[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers.

        Each round, every segment merges the pairs of its lowest rank, from the left and without
        overlap. Where one of those merges would give rise to a pair of no higher rank, only the
        leftmost is made. Segments without pairs leave the arrays.
        """
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.zeros(len(codes), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        # In long words, no merge crosses two characters that stand together in no piece.
        if lengths.max() > LONG_WORD:
            long = np.flatnonzero(np.repeat(lengths > LONG_WORD, lengths)[1:])
            beside = (codes[long] << 21) | codes[long + 1]
            at = np.searchsorted(self.inner, beside)
            at[at == len(self.inner)] = 0
            first[long[self.inner[at] != beside] + 1] = True
        sym, seg = self.of_char[codes], np.cumsum(first) - 1
        word_of = np.repeat(np.arange(len(words)), lengths)[first]
        done_sym, done_seg = [], []
        rank, piece = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        within = np.flatnonzero(seg[1:] == seg[:-1])
        rank[within], piece[within] = self._pairs(sym[within], sym[within + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            low = np.minimum.reduceat(rank, starts)
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sym)]))
            live = low[run] != NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_seg.append(seg[~live])
                sym, seg, rank, piece, run = sym[live], seg[live], rank[live], piece[live], run[live]
                if not len(sym):
                    break
            spot = rank == low[run]
            # Of neighbouring spots, the first, third and so on.
            edge = np.flatnonzero(spot & ~np.r_[False, spot[:-1]])
            order = np.arange(len(sym))
            since = np.zeros(len(sym), np.int64)
            since[edge] = edge
            spot &= (order - np.maximum.accumulate(since)) % 2 == 0
            many = np.bincount(run[spot], minlength=run[-1] + 1) > 1
            check = np.flatnonzero(spot & many[run])
            if len(check):
                pad = np.r_[-1, -1, sym, -1, -1]
                own = np.r_[-1, -1, run, -1, -1]
                merged = piece[check]
                bad = np.zeros(len(check), bool)
                for other, side in ((check + 1, 0), (check + 4, 1)):
                    with_other = self._pairs(pad[other], merged)[0] if side == 0 else self._pairs(merged, pad[other])[0]
                    bad |= (own[other] == run[check]) & (with_other <= rank[check])
                after = np.flatnonzero((check[1:] - check[:-1] == 2) & (run[check[1:]] == run[check[:-1]]))
                bad[after] |= self._pairs(merged[after], merged[after + 1])[0] <= rank[check[after]]
                if bad.any():
                    only = np.zeros(len(many), bool)
                    only[run[check[bad]]] = True
                    here = np.flatnonzero(spot)
                    lead = here[np.r_[True, run[here[1:]] != run[here[:-1]]]]
                    spot &= ~only[run]
                    spot[lead] = True
            sym[spot] = piece[spot]
            keep = ~np.r_[False, spot[:-1]]
            sym, seg, rank, piece, spot = sym[keep], seg[keep], rank[keep], piece[keep], spot[keep]
            # Only the pairs that a merge touched are looked up again.
            touched = np.flatnonzero(spot | np.r_[spot[1:], False])
            rank[touched] = NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[seg[touched] == seg[touched + 1]]
            rank[touched], piece[touched] = self._pairs(sym[touched], sym[touched + 1])
        sym, seg = np.concatenate(done_sym) if done_sym else sym, np.concatenate(done_seg) if done_seg else seg
        order = np.argsort(seg, kind="stable")
        sym, word = sym[order], word_of[seg[order]]
        # Symbols outside the vocabulary become the ids of their bytes.
        lost = np.flatnonzero((sym < 0) | (sym >= self.n_pieces))
        if len(lost):
            raw = [(chr(UNKNOWN - s) if s < 0 else self.char_of[s]).encode("utf-8", "surrogatepass") for s in sym[lost].tolist()]
            size = np.ones(len(sym), np.int64)
            size[lost] = [len(x) for x in raw]
            sym, word = np.repeat(sym, size), np.repeat(word, size)
            gone = (sym < 0) | (sym >= self.n_pieces)
            sym[gone] = self.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        flat = sym.astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Text of a sequence of ids; begin and end ids vanish, and so does the first space mark."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)
        ids = ids.astype(np.int64)
        ids = ids[(ids != self.bos) & (ids != self.eos)]
        if not len(ids):
            return ""
        size = self.surface_len[ids]
        total = int(size.sum())
        at = np.repeat(self.surface_at[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        raw = self.surface[at].tobytes()
        return raw[1 if self.marked[ids[0]] else 0 :].decode("utf-8", "replace")


def normal(text: str | None) -> str:
    """The model's normal form: a space in front, and each space its mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Encoder:
    """A PieceModel with remembered words."""

    def __init__(self, model_file: str):
        self.model, self.cache = PieceModel(model_file), {}
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos, self.model.eos))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids, begin and end included, as little-endian unsigned 32-bit integers."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end] or "") <= GROUP_CHARS):
                chars += len(texts[end] or "")
                end += 1
            split = [PRETOKEN.findall(normal(t)) for t in texts[start:end]]
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            new = list({w for ws in split for w in ws} - self.cache.keys())
            for i in range(0, len(new), AT_ONCE):
                part = new[i : i + AT_ONCE]
                self.cache.update(zip(part, self.model.encode_words(part), strict=True))
            for ws in split:
                yield b"".join([self.begin, *map(self.cache.__getitem__, ws), self.end])
            start = end


@lru_cache(maxsize=2)
def _encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded text of each row.

    A null text counts as empty: begin and end ids only. Any text is encoded whole; a very long
    one makes a group of its own. Repeated rows give repeated rows; extra columns are ignored; an
    empty table gives no rows. ``model_file`` must exist under that path on every executor, as
    installed packages do. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = list(encoder.encode(part.column("text").to_pylist()))
                out = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.model.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "decoded"])

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """As ``encode_documents``, with digests in place of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, ids, decoded = [], [], []
                for x in encoder.encode(part.column("text").to_pylist()):
                    n.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest())
                    decoded.append(hashlib.sha256(encoder.model.decode(x).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_model())
