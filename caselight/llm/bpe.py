"""BPE encoding and decoding with a published vocabulary, exact to the ``tokenizers`` library.

Common path. The vocabulary's pre-tokeniser never joins across white space, so a text's ids are
the ids of its words in order. A batch of texts is split into words, and its distinct words into
letters and the punctuation after them, in Arrow. Each task keeps a bounded store of pieces and
their ids as flat columns; only pieces that it lacks reach the library, in batches. Ids are put
together by the pieces' numbers, in numpy: no Python runs per word.

Long unsplit text (a run of ``RUN_CHARS`` or more without white space) goes by tree
concatenation. The run's pre-tokens are cut into leaves, which Spark deals out and encodes in
parallel. Then halves are joined pairwise, level by level: a window around the join is encoded
again and doubled until, on either side, it holds one token that the half has at the same bytes.
The result takes the left half up to there, the window, and the right half from there on. A BPE
sequence is the encoding of its bytes if and only if each two neighbours encode to themselves;
every two neighbours of the result stand together in one of the three exact encodings, so the
result is exact.

Defined results: null text counts as empty; an empty text has no ids and decodes to "";
repeated rows and repeated ids give a row each; an empty table gives an empty table; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpointed

#: Runs without white space of at least so many characters are cut into leaves.
RUN_CHARS = 4096
#: Code points in a leaf.
LEAF_CHARS = 2048
#: Bytes of the texts whose words are numbered together (a longer text goes alone).
BYTES_AT_ONCE = 1 << 23
#: Pieces in a task's store; the older half goes when it is full.
STORED = 400_000

#: White space as the vocabulary's normaliser has it.
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words without these characters may be put in lower case before the library sees them.
_KEEP_CASE = re.compile("[^\x00-įı-˿]")
_PLAIN_WORD = "^(?P<a>[a-zà-öø-ÿ]+)(?P<b>[!-/:-@\\[-`{-~]*)$"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def resolved(path: str | None) -> str:
    """The vocabulary's file where this runs: packages need not be in the same place everywhere."""
    return path or default_vocabulary()


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Maximal runs without white space, of all texts in order, and where each text's begin."""
    if pc.any(pc.match_substring_regex(texts, _ODD_SPACE.pattern)).as_py():
        found = [_WORD.findall(t) for t in texts.to_pylist()]
        return pa.array([w for words in found for w in words], pa.string()), np.cumsum([0, *map(len, found)])
    lists = pc.utf8_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not some.all():
        words, offsets = words.filter(pa.array(some)), np.r_[0, np.cumsum(some)][offsets]
    return words, offsets


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _piece_tokenizer(path: str):
    """Encodes normalised pre-tokens: no normaliser, no splitting."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.normalizer = normalizers.Sequence([])
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def _word_tokenizer(path: str):
    """Encodes normalised pre-tokens that are joined by a space."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.normalizer = normalizers.Sequence([])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id stands for."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token.removesuffix("</w>"))
    return out


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


class Store:
    """Strings and their ids, as flat columns."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.keys = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def places(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``ids`` and number of ids of each word; those not yet here are learned."""
        numbered = words.dictionary_encode()
        distinct = numbered.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.keys) + len(new) > STORED:
                half = len(self.keys) // 2
                self.ids, self.sizes = self.ids[self.sizes[:half].sum() :], self.sizes[half:]
                self.keys = pa.concat_arrays([self.keys.slice(half)])
                at = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy().astype(np.int64)
                new = np.flatnonzero(at < 0)
            unknown = distinct.take(pa.array(new))
            ids, sizes = self.learn(unknown.to_pylist())
            at[new] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, unknown])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        at = at[numbered.indices.to_numpy()]
        return starts[at], self.sizes[at]


class WordEncoder:
    """Encodes texts word by word."""

    def __init__(self, path: str):
        self.tok, self.tokens = tokenizer(path), _word_tokenizer(path)
        self.last = _word_ends(path)
        self.letters, self.marks, self.others = Store(self._pieces), Store(self._pieces), Store(self._others)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # each piece's last id is one that ends a word
        lines = [pieces[k : k + 512] for k in range(0, len(pieces), 512)]
        found = self.tokens.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary doesn't mark where words end")
        return ids, np.diff(ends, prepend=0)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        # letters and the punctuation after them are separate pre-tokens that no normaliser changes
        low = pc.if_else(pc.match_substring_regex(words, _KEEP_CASE.pattern), words, pc.utf8_lower(words))
        split = pc.extract_regex(low, _PLAIN_WORD)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        none = pc.fill_null(pc.equal(pc.struct_field(split, "b"), ""), True).to_numpy(zero_copy_only=False)
        rows = (np.flatnonzero(plain), np.flatnonzero(~none), np.flatnonzero(~plain))
        parts = (pc.struct_field(split, "a"), pc.struct_field(split, "b"), words)
        # a word's letters, or else all of it, then its marks
        starts, sizes, flat, held = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64), [], 0
        for store, part, at, k in zip((self.letters, self.marks, self.others), parts, rows, (0, 1, 0), strict=True):
            if len(at):
                place, size = store.places(part.take(pa.array(at)))
                starts[at, k], sizes[at, k] = held + place, size
                flat.append(store.ids)
                held += len(store.ids)
        return gathered(np.concatenate(flat), starts.ravel(), sizes.ravel()) if flat else np.zeros(0, "<u4"), sizes.sum(axis=1)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' ids, in order; where each text's begin, and the last end; and which texts have
        a long run (these have no ids here)."""
        words, offsets = words_of(texts)
        runs = np.flatnonzero(pc.greater_equal(pc.binary_length(words), RUN_CHARS).to_numpy(zero_copy_only=False))
        runs = runs[pc.utf8_length(words.take(pa.array(runs))).to_numpy() >= RUN_CHARS]
        long = np.zeros(len(texts), bool)
        if len(runs):
            long[np.searchsorted(offsets, runs, "right") - 1] = True
            keep = ~np.repeat(long, np.diff(offsets))
            words, offsets = words.filter(pa.array(keep)), np.r_[0, np.cumsum(keep)][offsets]
        numbered = words.dictionary_encode()
        flat, size = self._distinct(numbered.dictionary)
        codes = numbered.indices.to_numpy()
        sizes = size[codes]
        return gathered(flat, (np.cumsum(size) - size)[codes], sizes), np.r_[0, np.cumsum(sizes)][offsets], long


@lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray:
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token.endswith("</w>")
    return out


def parts_of(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BYTES_AT_ONCE``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield at, end
        at = end


# --- tree concatenation -------------------------------------------------------------------------


class Node:
    """An exact encoding of ``data[lo:hi]``; ``ends`` has the byte after each id's own."""

    def __init__(self, lo: int, hi: int, ids: np.ndarray, ends: np.ndarray):
        self.lo, self.hi, self.ids, self.ends = lo, hi, ids, ends

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([self.lo], self.ends[:-1])) if len(self.ends) else self.ends


def encode_piece(path: str, data: bytes, lo: int, hi: int) -> Node:
    ids = np.array(_piece_tokenizer(path).encode(data[lo:hi].decode(), add_special_tokens=False).ids, np.int64)
    return Node(lo, hi, ids, lo + np.cumsum(_token_bytes(path)[ids]))


def _at_character(data: bytes, at: int, step: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def _agreed(half: Node, window: Node, before: int | None, after: int | None) -> tuple[int, int] | None:
    """Indexes (in half, in window) of a token that both have at the same bytes; the window's own
    edges count as agreed where they are the half's edges."""
    starts = half.starts
    near = range(int(np.searchsorted(starts, window.lo)), int(np.searchsorted(half.ends, window.hi, "right")))
    key = {(int(starts[n]), int(half.ends[n]), int(half.ids[n])): n for n in near}
    tokens = list(enumerate(zip(window.starts, window.ends, window.ids, strict=True)))
    for n, (s, e, i) in reversed(tokens) if before is not None else tokens:
        if (before is None or e <= before) and (after is None or s >= after):
            found = key.get((int(s), int(e), int(i)))
            if found is not None:
                return found, n
    return None


def join(path: str, data: bytes, left: Node, right: Node, width: int = 32) -> Node:
    """The exact encoding of two neighbours' bytes, from theirs."""
    cut = left.hi
    while True:
        lo, hi = _at_character(data, max(left.lo, cut - width), -1), _at_character(data, min(right.hi, cut + width), 1)
        lo, hi = max(lo, left.lo), min(hi, right.hi)
        window = encode_piece(path, data, lo, hi)
        head = (0, 0) if lo == left.lo else _agreed(left, window, cut, None)
        tail = (len(right.ids), len(window.ids)) if hi == right.hi else _agreed(right, window, None, cut)
        if head and tail and head[1] <= tail[1]:
            # the agreed tokens themselves come from the window
            ids = np.concatenate((left.ids[: head[0]], window.ids[head[1] : tail[1]], right.ids[tail[0] :]))
            ends = np.concatenate((left.ends[: head[0]], window.ends[head[1] : tail[1]], right.ends[tail[0] :]))
            return Node(left.lo, right.hi, ids, ends)
        width *= 2


def join_all(path: str, data: bytes, leaves: list[Node]) -> Node:
    while len(leaves) > 1:
        level = [join(path, data, a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = level + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


#: Kinds of segment: words for the library as they are; a special token; a normalised pre-token;
#: a leaf of the pre-token that ``run`` numbers.
WORDS, SPECIAL, PIECE, LEAF = range(4)


def cut(path: str, text: str) -> Iterator[tuple[int, int, str]]:
    """Segments ``(kind, run, text)`` of a text with long runs, in order."""
    tok = tokenizer(path)
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")
    held: list[str] = []
    size = run = 0
    for word in _WORD.findall(text):
        if len(word) < RUN_CHARS:
            held.append(word)
            size += len(word)
            if size >= RUN_CHARS:
                yield WORDS, -1, " ".join(held)
                held, size = [], 0
            continue
        if held:
            yield WORDS, -1, " ".join(held)
            held, size = [], 0
        at = 0
        for m in [*special.finditer(word), None]:
            plain = word[at : m.start() if m else len(word)]
            if plain:
                plain = tok.normalizer.normalize_str(plain) if tok.normalizer else plain
                for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(plain):
                    piece = plain[a:b]
                    if len(piece) < RUN_CHARS:
                        yield PIECE, -1, piece
                        continue
                    for k in range(0, len(piece), LEAF_CHARS):
                        yield LEAF, run, piece[k : k + LEAF_CHARS]
                    run += 1
            if m:
                yield SPECIAL, -1, m[0]
                at = m.end()
    if held:
        yield WORDS, -1, " ".join(held)


def encode_segment(path: str, kind: int, text: str) -> np.ndarray:
    if kind == SPECIAL:
        return np.array([tokenizer(path).token_to_id(text)], np.int64)
    tok = tokenizer(path) if kind == WORDS else _piece_tokenizer(path)
    return np.array(tok.encode(text, add_special_tokens=False).ids, np.int64)


def joined(path: str, segments: list[tuple[int, int, str, np.ndarray]]) -> np.ndarray:
    """Ids of a text from its encoded segments, in order."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(segments):
        kind, run, _, ids = segments[k]
        if kind != LEAF:
            out.append(ids)
            k += 1
            continue
        pieces: list[bytes] = []
        leaves: list[Node] = []
        at = 0
        while k < len(segments) and segments[k][0] == LEAF and segments[k][1] == run:
            data, ids = segments[k][2].encode(), segments[k][3]
            leaves.append(Node(at, at + len(data), ids, at + np.cumsum(_token_bytes(path)[ids])))
            pieces.append(data)
            at += len(data)
            k += 1
        out.append(join_all(path, b"".join(pieces), leaves).ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


# --- Spark --------------------------------------------------------------------------------------


_SEGMENT = "row long, seq int, kind int, run int, piece string"


def encode_then(docs: DataFrame, path: str | None, rows: Callable[[list, np.ndarray, np.ndarray], list], schema: str) -> DataFrame:
    """Rows made from each document's ids.

    ``rows(doc_ids, ids, bounds)`` makes the columns of the rows of some texts: text ``k`` has the
    ids from ``bounds[k]`` to ``bounds[k + 1]``. ``doc_id`` is the first column of ``schema``. One
    pass over the texts gives the rows of most and the segments of those with long runs; it is
    checkpointed, so neither part is made twice and segments keep their labels.
    """
    result = StructType.fromDDL(schema)
    mixed = StructType.fromDDL(f"{schema}, {_SEGMENT}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    like = to_arrow_schema(mixed)

    def made(columns: list, fields: list) -> list[pa.Array]:
        return [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = resolved(path)
        encoder = WordEncoder(file)  # a task's own: nothing stays in the worker
        label = TaskContext.get().partitionId() << 40
        own, others = list(like)[: len(result)], list(like)[len(result) :]
        for b in batches:
            all_ids, all_texts = b.column("doc_id"), b.column("text")
            for at, end in parts_of(all_texts):
                names, texts = all_ids.slice(at, end - at), all_texts.slice(at, end - at)
                ids, bounds, long = encoder.encode(texts)
                short = np.flatnonzero(~long)
                if len(short):  # (texts with long runs have no ids here, so bounds close up)
                    columns = made(rows(names.take(pa.array(short)).to_pylist(), ids, np.r_[bounds[short], bounds[-1]]), own)
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), f.type) for f in others)], names=like.names)
                for k in np.flatnonzero(long).tolist():
                    found = [(label, n, *s) for n, s in enumerate(cut(file, texts[k].as_py()))]
                    nothing = [pa.nulls(len(found), f.type) for f in own[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([names[k].as_py()] * len(found), pa.int64()), *nothing, *made(list(zip(*found, strict=True)), others)], names=like.names)
                    label += 1

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = resolved(path)
        for b in batches:
            ids = [encode_segment(file, k, p).astype("<u4").tobytes() for k, p in zip(b.column("kind").to_pylist(), b.column("piece").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, type=pa.binary())], names=[*b.schema.names, "ids"])

    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        parts = [(k, r, p if k == LEAF else "", np.frombuffer(i, "<u4").astype(np.int64)) for k, r, p, i in zip(t["kind"].to_pylist(), t["run"].to_pylist(), t["piece"].to_pylist(), t["ids"].to_pylist(), strict=True)]
        ids = joined(resolved(path), parts).astype("<u4")
        return pa.Table.from_arrays(made(rows([t["doc_id"][0].as_py()], ids, np.array([0, len(ids)])), list(like)[: len(result)]), names=list(result.names))

    both = checkpointed(docs.mapInArrow(first, mixed))
    segments = both.where("kind is not null").select("doc_id", "row", "seq", "kind", "run", "piece")
    encoded = segments.repartition(F.col("row"), F.col("seq")).mapInArrow(leaves, f"doc_id long, {_SEGMENT}, ids binary")
    return both.where("kind is null").select(*result.names).unionByName(encoded.groupBy("row").applyInArrow(tree, result))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=4)
def _strings(path: str) -> tuple[pa.StringArray, pa.StringArray]:
    """Each id in decimal, and its token."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    tokens = [""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = token
    return pa.array([str(i) for i in range(len(tokens))]), pa.array(tokens)


def _spaced(strings: pa.StringArray, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Of each text the strings of its ids, joined by a space."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), strings.take(pa.array(ids)))
    return pc.binary_join(lists, " ").to_pylist()


def decoded(path: str, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """As the library decodes, special tokens kept; without a decoder it joins tokens by a space."""
    tok = tokenizer(path)
    if tok.decoder is None:
        return _spaced(_strings(path)[1], ids, bounds)
    return [tok.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def encode_decode(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``keep`` also the ids
    (``array<int>``) and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def rows(doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> list:
        file = resolved(path)
        texts = decoded(file, ids, bounds)
        extra = [[ids[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], texts] if keep else []
        return [doc_ids, np.diff(bounds), [_digest(x) for x in _spaced(_strings(file)[0], ids, bounds)], [_digest(x) for x in texts], *extra]

    return encode_then(docs, path, rows, schema)
