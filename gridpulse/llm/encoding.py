"""Whole-text encoding with the public tokenizers through a bounded word memo.

A BPE tokenizer first cuts a text into pieces and then merges inside each
piece. No piece of the two vocabularies used here reaches from a non-space
character over a following white-space character, so a text may be cut there
and every part encoded alone: the concatenated ids equal ``encode`` of the
whole text (tests compare them). Natural text repeats its words, so each
distinct part is encoded once by the tokenizers library and then looked up.
Parts not seen yet are encoded together as one joined text.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 1

#: Parts kept per worker, in two generations: when the younger is full it becomes the older,
#: and of the one before only the parts that came up again are left.
MEMO_PARTS = {BYTE_BPE: 800_000, WORD_BPE: 1_600_000, PIECE_BPE: 200_000}
#: New parts that are encoded at once: their tokens, before they are ids in the memo, take far more memory than the text.
LEARN_PARTS = 20_000
#: Texts are handled in groups of about so many bytes (or characters).
GROUP_CHARS = 4_000_000
#: Where every word becomes a Python object, fewer at once.
SLICE_BYTES = 1_000_000

_MARK = "\x01"
# White space as the byte vocabulary takes it: Unicode's White_Space (Python's, too, but for \x1c-\x1f). The word vocabulary drops
# control characters without a break, so its texts are cut at four characters only.
_WHITE, _WORD_WHITE, _LEADS = b"\t\n\x0b\x0c\r ", b"\t\n\r ", b" \n"
_WIDE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_END = re.compile(b"(?:" + _WIDE.pattern + rb")\Z")
_WIDE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")

# str.split() cuts at ASCII white space alone unless a text has one of these.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Runs without ASCII white space."""
    return _WORDS.findall(text) if _ODD.search(text) else text.split()


def coded_parts(column, white_bytes: bytes = _WHITE, wide: bool = True) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """An Arrow column of texts cut into parts, a run of white space and what stands behind it up to the next one.

    For each group of rows of about GROUP_CHARS bytes: the distinct parts, the codes of all parts in order, and the first part of each row (and the
    number of parts). The texts' own buffer is cut and coded; no part but the distinct ones becomes a Python object.
    """
    import pyarrow as pa
    column = column.cast(pa.large_string()).fill_null("")
    offsets, data = column.buffers()[1:]
    offsets = np.frombuffer(offsets, "<i8", len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, "<i8")
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    is_white, row = np.isin(np.arange(256), list(white_bytes)), 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP_CHARS, "right")) - 1)
        raw, starts = data[offsets[row]:offsets[end]].tobytes(), offsets[row:end + 1] - offsets[row]
        white = is_white[np.frombuffer(raw, np.uint8)]
        if wide and any(map(raw.__contains__, _WIDE_LEADS)):
            for m in _WIDE.finditer(raw):
                white[m.start():m.end()] = True
        first = white.copy()
        first[1:] &= ~white[:-1]
        first[starts[:-1][starts[:-1] < starts[1:]]] = True  # every text begins a part
        at = np.flatnonzero(first)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype("<i8")), pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        yield coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(at, starts)
        row = end


def slices(batch, column: int, most: int = SLICE_BYTES) -> Iterator:
    """An Arrow batch cut between rows, so that the texts of a slice have about so many bytes, or are one row's."""
    import pyarrow.compute as pc
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype="i8") // most
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        if start < end:
            yield batch.slice(start, end - start)


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """File of a public vocabulary; ``folder`` overrides the installed place."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Memo:
    """part -> ids. The ids lie in one array, so that those of many parts are gathered at once."""

    def __init__(self):
        self.at: dict = {}  # part (bytes; for the piece vocabulary a word) -> place in begins and sizes
        self.ids, self.begins, self.sizes, self.n_ids = np.zeros(1024, "<u4"), np.zeros(1024, "<i8"), np.zeros(1024, "<i8"), 0

    def add(self, parts: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New distinct parts, their ids one after the other, and how many each has."""
        old, n = len(self.at), len(parts)
        while old + n > len(self.sizes):
            self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at.update(zip(parts, range(old, old + n)))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.sizes[old:old + n] = sizes
        self.begins[old:old + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)

    def places(self, parts: list) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, parts), "<i8", len(parts))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts one after the other, where each part's ids begin and, last, how many there are)."""
        sizes = self.sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.begins[places] - ends[:-1], sizes)], ends


class TextEncoder:
    """Ids of whole texts, as little-endian uint32 bytes."""

    def __init__(self, name: str, folder: str | None = None, memo_parts: int | None = None):
        self.memo, self.older = Memo(), Memo()
        memo_parts = memo_parts or MEMO_PARTS[name]
        self.memo_parts = memo_parts
        self.name = name
        self.white, self.wide = (_WHITE, True) if name == BYTE_BPE else (_WORD_WHITE, False)
        if name == PIECE_BPE:  # each word alone, as after a space
            from sentencepiece import SentencePieceProcessor
            self.pieces = SentencePieceProcessor(model_file=vocabulary_path(name, folder))
            return
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary_path(name, folder))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if hasattr(self.tokenizer.model, "_resize_cache"):  # the memo does its work; ids are the same
            self.tokenizer.model._resize_cache(0)
        if name == BYTE_BPE:  # a token of the byte alphabet has a character for each byte
            vocab = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(vocab.values()) + 1, "<i8")
            for token, i in vocab.items():
                self.token_bytes[i] = len(token)
        else:
            self.mark_id, = self.tokenizer.encode(_MARK, add_special_tokens=False).ids

    def learn(self, parts: list) -> None:
        """Distinct new parts go to the memo."""
        learn = {BYTE_BPE: self._learn_bytes, WORD_BPE: self._learn_words, PIECE_BPE: self._learn_pieces}[self.name]
        for k in range(0, len(parts), LEARN_PARTS):
            learn(parts[k:k + LEARN_PARTS])

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_bytes(self, parts: list[bytes]) -> None:
        """Parts that begin with white space and end without it stay whole in a joined text."""
        joined = [p for p in parts if p[0] in _LEADS and p[-1] not in _WHITE and (p[-1] < 128 or not _WIDE_END.search(p))]
        if joined:
            ids = self._ids(b"".join(joined).decode())
            ends = np.cumsum(np.fromiter(map(len, joined), "<i8", len(joined)))
            self.memo.add(joined, ids, np.diff(np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1, prepend=0))
        if len(joined) < len(parts):
            self._learn_alone(set(parts).difference(joined))

    def _learn_words(self, parts: list[bytes]) -> None:
        """White space gives no id. A mark that no joined part holds stands between the parts."""
        mark = _MARK.encode()
        joined = [p for p in parts if mark not in p]
        if joined:
            ids = self._ids(f" {_MARK} ".encode().join(joined).decode())
            marks = ids == self.mark_id
            self.memo.add(joined, ids[~marks], np.diff(np.flatnonzero(np.append(marks, True)), prepend=-1) - 1)
        if len(joined) < len(parts):
            self._learn_alone(set(parts).difference(joined))

    def _learn_alone(self, parts: Iterable[bytes]) -> None:
        for p in parts:
            ids = self._ids(p.decode())
            self.memo.add([p], ids, np.array([len(ids)]))

    def _learn_pieces(self, words: list[str]) -> None:
        ids = self.pieces.encode(words, num_threads=1)
        self.memo.add(words, np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), "<i8", len(ids)))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn (null or empty: none)."""
        import pyarrow as pa
        yield from self.encode_column(pa.array(list(texts), pa.large_string()))

    def encode_column(self, column) -> Iterator[bytes]:
        """Ids of each text of an Arrow column in turn (null or empty: none)."""
        for parts, codes, bounds in coded_parts(column, self.white, self.wide):
            yield from self._texts(self._places(parts)[codes], bounds)

    def encode_words(self, cut: list[list[str]]) -> Iterator[bytes]:
        """Ids of texts that are cut into words, for the piece vocabulary."""
        self._places(list(set().union(*cut)))
        yield from self._texts(self.memo.places(list(chain.from_iterable(cut))), np.cumsum([0, *map(len, cut)]))

    def _texts(self, places: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        ids, ends = self.memo.gather(places)
        ends = ends[bounds].tolist()
        for start, end in zip(ends[:-1], ends[1:]):
            yield ids[start:end].tobytes()

    def _places(self, parts: list) -> np.ndarray:
        """Where the memo has distinct parts; those not seen yet are learnt."""
        if len(self.memo.at) > self.memo_parts // 2:
            self.older, self.memo = self.memo, Memo()
        memo, older = self.memo, self.older
        new = [p for p in parts if p not in memo.at]
        again = [p for p in new if p in older.at] if older.at else []
        if again:
            ids, ends = older.gather(older.places(again))
            memo.add(again, ids, np.diff(ends))
            new = [p for p in new if p not in older.at]
        self.learn(new)
        return memo.places(parts)


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(name: str, folder: str | None = None) -> TextEncoder:
    """The worker's encoder of this vocabulary, kept between tasks until another vocabulary is asked for: Spark hands a worker on to other operators."""
    key = (name, folder)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(name, folder)
    return _ENCODERS[key]
