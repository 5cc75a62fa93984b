"""Token counts by overlap resynchronisation.

Documents longer than a chunk are encoded by the library in overlapping chunks.
Two neighbouring chunks are spliced where both start a word (the tokenizer's own pre-token) at the same
character, and from there on have the same tokens at the same offsets, up to the last word that the left
chunk's end can't have touched. Words are matched from left to right without looking back, so from a start
that is true in the left chunk, a chunk that starts a word there has the tokens of the whole text. Where the
overlap holds no such start, it is widened; once it would reach the left chunk's own splice, both are encoded
as one chunk. A tokenizer without words of its own thus encodes whole texts; sentencepiece models, whose
words aren't reported, always do.

The library spends more on normalising and splitting a text and on offsets than on its tokens. Where a tokenizer file asks
for steps that can't change anything in a text (see `Library.fitting`), the library encodes that text without
them, with the same tokens, offsets and words. There, a token also says what text it covers and whether it ends
a word, so chunks are encoded without offsets; only the overlap, encoded by itself, needs them.
"""
from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from probity.llm.common import slices

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 1 << 12, 1 << 7
#: Chunks that are encoded at once.
TOGETHER = 64
#: Characters before a chunk's end in which its tokens may differ from the text's, at least; the longest
#: special string may ask for more.
MARGIN = 16
#: Words whose tokens a BPE model keeps, at most (about 250 bytes each). The library's own 10,000 are soon full.
WORDS = 1 << 17

#: Steps of a tokenizer file that can be left out or done with less.
NFC, BLANKS, LOWER = {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The same words as SPLIT's: letters and digits begin no other branch, so they may be tried first.
LETTERS_FIRST = r"[\p{L}]+|[\p{N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+"
#: What BYTES doesn't leave as it is, white space aside.
UNPRINTED = re.compile(r"[^\t-\r -~]")


class Token(NamedTuple):
    id: int
    start: int  # in the text
    first: bool  # of a word, and of what its character became: one character may give the ends of two words


class Chunk:
    """text[at:to] as the library encodes it, with offsets or without. Tokens are looked at one by one, since only overlaps need theirs."""

    def __init__(self, at: int, to: int, found):
        self.at, self.to, self.found, self.n = at, to, found, len(found)

    @cached_property
    def ids(self) -> list[int]:
        return self.found.ids

    def token(self, k: int) -> Token:
        e = self.found
        start = e.token_to_chars(k)[0]
        return Token(self.ids[k], self.at + start, k == 0 or e.token_to_word(k) != e.token_to_word(k - 1) and e.token_to_chars(k - 1)[1] <= start)


class Library:
    """The library that a tokenizer file is for: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.margin = MARGIN
        if path.endswith(".model"):
            import sentencepiece

            self.proc = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tok = None
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_padding()
            self.tok.no_truncation()
            self.margin = max([MARGIN, *(2 * len(t.content) for t in self.tok.get_added_tokens_decoder().values())])
            self.composed = self.printed = self.tok
            self.ends: set[int] = set()  # tokens that end a word
            self._lessen(path)

    def _lessen(self, path: str) -> None:
        """Tokenizers for texts that are composed (NFC) and for printed ASCII, if the file's steps are the known ones."""
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        if isinstance(self.tok.model, models.BPE):
            self.tok.model._resize_cache(WORDS)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        # a string that is matched in normalised text needs all steps
        if (
            steps.get("normalizer") != {"type": "Sequence", "normalizers": [NFC, BLANKS, LOWER]}
            or steps.get("pre_tokenizer") != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
            or any(t["normalized"] for t in steps.get("added_tokens", []))
        ):
            return
        split = pre_tokenizers.Split(Regex(LETTERS_FIRST), "removed", invert=True)
        self.composed, self.printed = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tok in (self.composed, self.printed):
            tok.no_padding()
            tok.no_truncation()
            tok.model = self.tok.model  # one store of words for all
            tok.normalizer = normalizers.Lowercase()
        self.composed.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.printed.pre_tokenizer = split
        # tokens tell their text if every byte has one, and their words' ends by the suffix, which only a last one has
        end, vocab = steps["model"].get("end_of_word_suffix"), self.tok.get_vocab(with_added_tokens=False)
        if end and all(b in vocab and b + end in vocab for b in pre_tokenizers.ByteLevel.alphabet()):
            self.ends = {i for t, i in vocab.items() if t.endswith(end)} | set(self.tok.get_added_tokens_decoder())

    def fitting(self, text: str):
        """The tokenizer with the fewest steps that gives this text the file's tokens, offsets and words: NFC keeps
        a text that is composed already, the splitter drops white space whether it was made one blank or not, and
        printed ASCII is its own byte alphabet."""
        if not UNPRINTED.search(text):
            return self.printed
        return self.composed if unicodedata.is_normalized("NFC", text) else self.tok

    def encoded(self, texts: list[str], offsets: bool) -> list:
        """Each text as the library encodes it, without offsets for less."""
        if self.tok is None:
            return self.proc.encode(texts, num_threads=1)
        groups: dict[int, tuple] = {}
        for k, text in enumerate(texts):
            tok = self.fitting(text)
            groups.setdefault(id(tok), (tok, []))[1].append(k)
        out: list = [None] * len(texts)
        for tok, rows in groups.values():
            encode = tok.encode_batch if offsets else tok.encode_batch_fast
            for k, e in zip(rows, encode([texts[k] for k in rows], add_special_tokens=False)):
                out[k] = e
        return out

    def chunks(self, parts: Iterable[tuple[str, int, int]]) -> Iterator[Chunk]:
        """text[at:to] of each (text, at, to) with offsets."""
        return self.pieces(parts, offsets=True)

    def pieces(self, parts: Iterable[tuple[str, int, int]], offsets: bool) -> Iterator[Chunk]:
        """text[at:to] of each (text, at, to), encoded TOGETHER at a time: a huge text's tokens are never all held."""
        parts = iter(parts)
        while some := list(islice(parts, TOGETHER)):
            found = self.encoded([t[a:z] for t, a, z in some], offsets)
            yield from (Chunk(a, z, e) for (_, a, z), e in zip(some, found))

    def lengths(self, texts: list[str]) -> Iterator[int]:
        """The tokens of each text, TOGETHER at a time."""
        for s in range(0, len(texts), TOGETHER):
            yield from map(len, self.encoded(texts[s : s + TOGETHER], offsets=False))

    def chunk(self, text: str, at: int, to: int, offsets: bool = True) -> Chunk:
        return next(self.pieces([(text, at, to)], offsets))

    def bare(self, text: str) -> bool:
        """Whether the text's chunks need no offsets."""
        return bool(self.ends) and self.fitting(text) is not self.tok


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    """A Python worker keeps its library, and the words it knows, from one task to the next."""
    return Library(path)


def splice(left: Chunk, right: Chunk, least: int, margin: int) -> tuple[int, int, int] | None:
    """Indices of the token of either chunk from which on the right one takes over, `least` at least in the
    left one, and where it starts; None if the overlap has none."""
    tail: list[Token] = []  # the left chunk's tokens inside the overlap, up to its last untouched word
    for k in range(left.n - 1, least - 1, -1):
        t = left.token(k)
        if t.start <= right.at:
            break
        if tail or t.first and t.start <= left.to - margin:
            tail.append(t)
            begin = k
    tail.reverse()
    head: list[Token] = []
    for k in range(right.n):
        t = right.token(k)
        if not tail or t.start > tail[-1].start:
            break
        head.append(t)
    places: dict[int, int] = {}
    for j, t in enumerate(head):
        if t.first and t.start > right.at:
            places.setdefault(t.start, j)
    for i, t in enumerate(tail):
        j = places.get(t.start) if t.first else None
        if j is not None and tail[i:-1] == head[j : j + len(tail) - 1 - i]:
            return begin + i, j, t.start
    return None


def splice_bare(left: Chunk, right: Chunk, over: Chunk, least: int, lib: Library) -> tuple[int, int, int] | None:
    """As splice, for chunks without offsets. The same tokens cover the same text, so those that the overlap has in
    common with the left chunk, counted from their common end, and with the right one, counted from their
    common start, lie where the overlap's own lie."""
    firsts = [k for k in range(1, over.n) if (t := over.token(k)).first and over.at < t.start <= left.to - lib.margin]
    if not firsts or right.ids[: firsts[-1]] != over.ids[: firsts[-1]]:
        return None
    for j in firsts:
        k = left.n - over.n + j
        if k >= least and left.ids[k:] == over.ids[j:] and (k == 0 or left.ids[k - 1] in lib.ends):
            return k, j, over.token(j).start
    return None


def counts(lib: Library, texts: list[str], chunk: int, overlap: int) -> list[int]:
    """The tokens of each text, from chunks of so many characters."""
    overlap = min(overlap, chunk // 2)

    def cuts(text: str) -> list[tuple[int, int]]:
        return [(a, min(len(text), a + chunk)) for a in range(0, len(text) - overlap, chunk - overlap)]

    long = [lib.tok is not None and len(t) > chunk for t in texts]
    bare = [is_long and lib.bare(t) for t, is_long in zip(texts, long)]
    # one chunk has nothing to splice, so its offsets aren't asked for
    one = lib.lengths([t for t, is_long in zip(texts, long) if not is_long])
    whole = [t for t, is_long, is_bare in zip(texts, long, bare) if is_long and not is_bare]
    found = lib.chunks((t, a, z) for t in whole for a, z in cuts(t))
    some = [t for t, is_bare in zip(texts, bare) if is_bare]
    pieces = lib.pieces(((t, a, z) for t in some for a, z in cuts(t)), offsets=False)
    overs = lib.chunks((t, a, z) for t in some for (_, z), (a, _) in pairwise(cuts(t)))
    return [
        spliced(lib, t, islice(pieces, len(cuts(t))), overlap, overs) if is_bare else spliced(lib, t, islice(found, len(cuts(t))), overlap) if is_long else next(one)
        for t, is_long, is_bare in zip(texts, long, bare)
    ]


def spliced(lib: Library, text: str, chunks: Iterator[Chunk], overlap: int, overs: Iterator[Chunk] | None = None) -> int:
    """The text's tokens, from its overlapping chunks in order; `overs` has the overlaps, if the chunks are
    without offsets."""
    left = next(chunks)
    total = begin = start = 0
    for right in chunks:
        over = next(overs) if overs is not None else None
        wide = overlap
        while True:
            hit = splice(left, right, begin, lib.margin) if over is None else splice_bare(left, right, over, begin, lib)
            if hit is not None:
                total += hit[0] - begin
                left, (_, begin, start) = right, hit
                break
            wide *= 4
            at = left.to - wide
            if at <= start:
                left = lib.chunk(text, left.at, right.to, over is None)
                break
            right = lib.chunk(text, at, right.to, over is None)
            over = lib.chunk(text, at, left.to) if over is not None else None
    return total + left.n - begin


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Each row's key, n_bytes, n_tokens and over_limit (n_tokens > limit).

    No begin, end or other added tokens; special strings in a text count as the library counts them.
    A null text is empty: 0 bytes and tokens. Rows are independent, so repeated rows and null keys stay
    as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = counts(lib, texts, chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)
