"""Exact token counts of every prefix of a text, by dynamic programming.

Byte-pair encoding has a prefix property: if a piece's encoding ends with token t, what stands before is the encoding of the piece
without t. So the encoding of each prefix is known by its last token alone, and

    count[i] = count[i - len(t)] + 1,   t: the one token that ends at i and may follow the last token of prefix i - len(t).

Two tokens may stand side by side when no merge over their border comes before the merges that build them; this is read off the right
edge of the one and the left edge of the other. Counts add up over the pieces that the tokenizer's pattern cuts; a prefix that ends inside
white space, a contraction or a special token's string is cut in its own way, and its count is that of the library for this prefix.

The table of a text holds the changes of the count from one code point to the next in blocks, each with the count before it. How many tokens any
prefix has, where to cut for a budget and how to split into windows are read from it; nothing is encoded again.
Changes are found once for each distinct run of white space and characters behind it, and then looked up.
"""
from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from operator import sub
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import run_folder, text_of
from .encoding import BYTE_BPE, vocabulary_path

LIMIT = 1024
#: Code points in a block of a table.
BLOCK = 4096
#: Texts are handled in groups of about so many characters; parts kept per worker, in two generations.
GROUP_CHARS, MEMO_PARTS = 1_000_000, 1_000_000
NEVER = 1 << 60

# White space is Unicode's White_Space (Python's, too, but for \x1c-\x1f).
_WHITE = re.compile(r"[^\S\x1c-\x1f]*")
_PARTS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_PIECES = re.compile(r"'(?:re|ve|ll|[stmd])|[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")


class _Classes(dict):
    """For str.translate: other letters to A, numbers to 0, the rest to !, as the library's own pattern takes them."""

    def __init__(self, pre_tokenizer):
        self.cut = lambda text: len(pre_tokenizer.pre_tokenize_str(text))

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c if point < 128 else "A" if self.cut("a" + c) == 1 else "0" if self.cut("1" + c) == 1 else "!"
        return self[point]


class PieceCounts:
    """Token counts of all prefixes of pieces (byte strings the pattern leaves whole)."""

    def __init__(self, tokenizer):
        import json
        model = json.loads(tokenizer.to_str())["model"]
        vocab = model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte alphabet
        alphabet = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.rank, self.made = {}, {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank[vocab[a], vocab[b]] = rank
            self.made[vocab[a + b]] = (rank, vocab[a], vocab[b])
        self.nodes: dict[int, int] = {}  # tokens by their bytes from the last to the first: node << 8 | byte -> node
        self.token = [-1]  # that ends at a node
        for token, i in vocab.items():
            if len(tokenizer.model.tokenize(token)) != 1:
                continue  # never the encoding of its own bytes
            node = 0
            for c in reversed(token):
                node = self.nodes.setdefault(node << 8 | alphabet[c], len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(part, rank of the merge that takes it up) along the token's right or left edge, from its byte up."""
        known = self.edges[right]
        if token not in known:
            out, taken, t = [], NEVER, token
            while True:
                out.append((t, taken))
                if t not in self.made:
                    break
                taken, *halves = self.made[t]
                t = halves[right]
            known[token] = out[::-1]
        return known[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a``: no merge over the border comes first (of equal ranks, the left one does)."""
        left, right, i, j = self._edge(a, True), self._edge(b, False), 0, 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < until_x and rank <= until_y:
                return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def counts(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(piece, token counts of its prefixes by bytes, from 0 bytes on). In sorted order neighbours share their first counts."""
        step, token_at, pairs, fit = self.nodes.get, self.token, self.pairs, self.fit
        if len(pairs) > 4 * MEMO_PARTS:
            pairs.clear()
        before, count, last = b"", [0], [-1]
        for piece in sorted(pieces):
            i = len(commonprefix((piece, before)))
            del count[i + 1:], last[i + 1:]
            for end in range(i, len(piece)):
                node, at = 0, end
                while True:
                    node = step(node << 8 | piece[at])
                    if node is None:
                        raise ValueError("a piece that the vocabulary's bytes can't spell")
                    token = token_at[node]
                    if token >= 0:
                        previous = last[at]
                        if previous < 0:  # the whole prefix is one token
                            break
                        key = previous << 32 | token
                        if key not in pairs:
                            pairs[key] = fit(previous, token)
                        if pairs[key]:
                            break
                    at -= 1
                count.append(count[at] + 1)
                last.append(token)
            before = piece
            yield piece, count


class PrefixCounter:
    """Prefix tables of whole texts. ``changes`` has an int16 for each code point."""

    def __init__(self, name: str = BYTE_BPE, folder: str | None = None, memo_parts: int = MEMO_PARTS):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(vocabulary_path(name, folder))
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) or tokenizer.normalizer is not None:
            raise ValueError("only vocabularies whose special strings stand for themselves, without a normalizer")
        strings = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.pieces, self.classes = PieceCounts(tokenizer), _Classes(tokenizer.pre_tokenizer)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_parts = memo_parts

    def _one_piece(self, part: str) -> bool:
        """Letters only, perhaps behind one space."""
        rest = part[1:] if part[0] == " " else part
        return (rest if rest.isascii() else rest.translate(self.classes)).isalpha()

    def _cut(self, part: str) -> tuple[str, str, list[str]]:
        """(white space, space that the next piece takes along, pieces of the rest)."""
        white = _WHITE.match(part).group()
        rest = part[len(white):]
        taken = " " if rest and white.endswith(" ") else ""
        shape = rest if rest.isascii() else rest.translate(self.classes)
        if taken and shape[:1] == "'":  # behind a space an apostrophe opens no contraction
            shape = "!" + shape[1:]
        return white, taken, [rest[m.start():m.end()] for m in _PIECES.finditer(shape)]

    def _learn(self, parts: list[str]) -> None:
        """Changes of parts: white space and the characters up to the next."""
        whole = set(filter(self._one_piece, parts))
        mixed = [(p, *self._cut(p)) for p in parts if p not in whole]
        need = {" ", "'", "r", "v", "l"}
        for _, white, taken, pieces in mixed:
            need.update((white, white[-1]) if white else ())
            need.update([taken + p if k == 0 else p for k, p in enumerate(pieces)])
        known = {}
        for piece, count in self.pieces.counts({p.encode() for p in need | whole}):
            text = piece.decode()
            if len(text) < len(piece):  # code points end at bytes that no continuation byte follows
                count = [0, *(c for c, b in zip(count[1:], (*piece[1:], 0)) if b & 0xC0 != 0x80)]
            known[text] = array("h", map(sub, count[1:], count))
        for part in whole:
            self.memo[part] = known[part].tobytes()
        for part, white, taken, pieces in mixed:
            out = array("h", known[white]) if white else array("h")
            for k, piece in enumerate(pieces):
                if taken and k == 0:
                    out += known[" " + piece][1:]
                elif piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():  # a contraction's first two characters are two pieces
                    first, second = known["'"][0], known[piece[1]][0]
                    out.extend((first, second, sum(known[piece]) - first - second))
                else:
                    out += known[piece]
            if pieces and len(white) > 1:  # the run's last character leaves the piece of the others
                out[len(white)] += known[white[-1]][0] - known[white][-1]
            self.memo[part] = out.tobytes()

    def _ordinary(self, cut: list[list[str]]) -> Iterator[np.ndarray]:
        """Changes of texts cut into parts."""
        if len(self.memo) > self.memo_parts // 2:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, []
        for p in set().union(*cut):
            if p not in memo:
                if p in older:
                    memo[p] = older[p]
                else:
                    new.append(p)
        if new:
            self._learn(new)
        for parts in cut:
            yield np.frombuffer(b"".join(map(memo.__getitem__, parts)), "<i2")

    def changes(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, the change of the prefix count at each code point."""
        plan, cut = [], []
        for text in texts:
            found = list(self.special.finditer(text)) if self.special else []
            at, segments = 0, []
            for m in found:  # up to its last character a special string is ordinary text
                segments.append((len(cut), m.start() - at))
                cut.append(_PARTS.findall(text[at:m.end() - 1]))
                at = m.end()
            segments.append((len(cut), None))
            cut.append(_PARTS.findall(text[at:]))
            plan.append(segments)
        done = list(self._ordinary(cut))
        for segments in plan:
            if len(segments) == 1:
                yield done[segments[0][0]]
                continue
            out = []
            for k, before in segments:
                out.append(done[k])
                if before is not None:
                    out.append(np.array([1 - int(done[k][before:].sum(dtype="<i8"))], "<i2"))
            yield np.concatenate(out)

    def tables(self, texts: Iterable[str | None]) -> Iterator[PrefixTable]:
        """The table of each text in turn; null counts as empty."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from map(PrefixTable, self.changes(group))
                group, chars = [], 0
        yield from map(PrefixTable, self.changes(group))


class PrefixTable:
    """Token count of every prefix of a text, by code points."""

    def __init__(self, changes: np.ndarray):
        self.changes = changes
        sums = np.add.reduceat(changes, np.arange(0, len(changes), BLOCK), dtype="<i8") if len(changes) else np.zeros(0, "<i8")
        self.bases = np.concatenate([[0], np.cumsum(sums)])

    @property
    def total(self) -> int:
        return int(self.bases[-1])

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points: one block is read."""
        chars = min(chars, len(self.changes))
        block = chars // BLOCK
        return int(self.bases[block] + self.changes[block * BLOCK:chars].sum(dtype="<i8"))

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens. Counts may fall from one prefix to the next, so blocks are
        read from the end on; a block whose changes can't reach the budget from its base is passed over."""
        for block in reversed(range(len(self.bases) - 1)):
            inside = self.bases[block] + np.cumsum(self.changes[block * BLOCK:(block + 1) * BLOCK], dtype="<i8")
            fits = np.flatnonzero(inside <= budget)
            if len(fits):
                return block * BLOCK + int(fits[-1]) + 1
        return 0

    def to_bytes(self) -> bytes:
        """Code points, bases of the blocks, their lengths, and the changes of each block compressed alone."""
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = [pack(self.changes[k:k + BLOCK].tobytes()) for k in range(0, len(self.changes), BLOCK)]
        return struct.pack("<q", len(self.changes)) + self.bases.astype("<i8").tobytes() + np.array([len(b) for b in blocks], "<u4").tobytes() + b"".join(blocks)

    @staticmethod
    def from_bytes(raw: bytes) -> PrefixTable:
        import zstandard
        n, = struct.unpack_from("<q", raw)
        blocks = -(-n // BLOCK)
        at = 8 + 8 * (blocks + 1)
        lengths = np.frombuffer(raw, "<u4", blocks, at).tolist()
        at += 4 * blocks
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for k, length in enumerate(lengths):
            out.append(unpack(raw[at:at + length], max_output_size=2 * BLOCK))
            at += length
        return PrefixTable(np.frombuffer(b"".join(out), "<i2"))


_COUNTERS: dict[tuple, PrefixCounter] = {}


def counter(name: str, folder: str | None = None) -> PrefixCounter:
    """The worker's counter of this vocabulary, kept between tasks."""
    if (name, folder) not in _COUNTERS:
        _COUNTERS[name, folder] = PrefixCounter(name, folder)
    return _COUNTERS[name, folder]


def count_tokens(docs: DataFrame, limits: tuple[int, ...] = (LIMIT,), vocabulary: str = BYTE_BPE, id_column: str = "doc_id", text_column: str = "text",
                 tokenizers: str | None = None, with_table: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, fit_chars (array: code points of the longest prefix within each limit), and, if asked for,
    prefix_table (``PrefixTable.to_bytes``).

    Counts are those of the tokenizers library by default: special strings inside a text are one token, none are added. A null text counts as
    empty: no bytes, no tokens. Null ids and repeated rows stay; an empty table gives none; other columns are not read. Texts are never cut:
    a text of many megabytes costs its length.
    """
    run_folder(docs.sparkSession, "tokencounts")
    limits = tuple(limits)

    def fill(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(1)
            tables = counter(vocabulary, tokenizers).tables(x.as_py() for x in texts)
            rows = [(t.total, [t.fit(limit) if t.total > limit else len(t.changes) for limit in limits], t.to_bytes() if with_table else None) for t in tables]
            n_tokens, fits, packed = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.list_(pa.int64()))]
            names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
            if with_table:
                columns.append(pa.array(packed, pa.binary()))
                names.append("prefix_table")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("t"), F.octet_length(text_of(text_column)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(fill, "doc_id long, n_bytes long, n_tokens long, fit_chars array<long>" + (", prefix_table binary" if with_table else ""))


def truncate(counted: DataFrame, docs: DataFrame, budget: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens, by the stored tables of ``count_tokens(docs, with_table=True)``.

    Rows are matched by id, so ids must be unique; rows without a table (null ids among them) raise an error. Null texts stay null.
    """
    def fits(batches):
        import pyarrow as pa
        for batch in batches:
            out = [PrefixTable.from_bytes(x).fit(budget) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["cut_id", "cut_chars"])

    cuts = counted.select("doc_id", "prefix_table").mapInArrow(fits, "cut_id long, cut_chars long")
    joined = docs.join(cuts, docs[id_column] == cuts["cut_id"], "left")
    cut = F.when(cuts["cut_chars"].isNull(), F.raise_error(F.lit("a row without a prefix table"))).otherwise(F.substring(docs[text_column], F.lit(1), cuts["cut_chars"].cast("int")))
    return joined.select(*(cut.alias(c) if c == text_column else docs[c] for c in docs.columns))


def op11_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents: doc_id, n_bytes, n_tokens, over_limit, and the code points that fit into the limit."""
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.get("fit_chars", F.lit(0)).alias("fit_chars"))
