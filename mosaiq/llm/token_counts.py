"""Token counts with a whole-token shortcut.

Most words of a text are one token. For each string of the vocabulary it is proved once, on the driver, whether the
library encodes it alone as exactly that token; a pre-token found in this table counts 1 without any merging, and only
the rest goes through the library's merges. White-space separated pieces never share a token in this vocabulary (white
space is dropped), so pieces are counted one by one and remembered.

Cases: null and empty text have 0 bytes and 0 tokens; a text that holds a special token's string goes to the library
whole; repeated rows are counted each; columns other than the two named are ignored; text of any length is counted in
full; an empty table gives no rows; a vocabulary whose file cuts texts in another way is counted by the library alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ._common import byte_of_char

#: The vocabulary's own pre-token pattern (a fixed value of its file).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the shortcut takes for granted (fixed values of the vocabulary's file, which are compared with it).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: str.split() takes these as white space, the library doesn't.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_kept: dict[str, _Counter] = {}


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """The strings that the tokenizer at `path` provably encodes alone as the one token of their name."""
    tokenizer = _load(path)
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
    byte, found = byte_of_char(), {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(suffix) and len(token) > len(suffix):
            chars = token[: len(token) - len(suffix)]
            try:
                found[bytes(byte[c] for c in chars).decode()] = number
            except (KeyError, UnicodeDecodeError):
                continue
    strings = list(found)
    codes = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, codes, strict=True) if e.ids == [found[s]])


class _Counter:
    """Counts of pieces, remembered up to `most` pieces."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 400_000) -> None:
        self.tokenizer, self.whole, self.most = _load(path), whole, most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        #: the shortcut is for vocabularies that drop white space, lower-case, and cut by PRE_TOKEN; others are counted whole
        self.fits = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        self.split = regex.compile(PRE_TOKEN).findall
        self.known: dict[str, int] = {}

    def _learn(self, pieces: set[str]) -> None:
        rest: dict[str, list[str]] = {}
        for piece in pieces:
            parts = self.split(piece.lower()) if piece.isascii() else [piece]
            merge = [p for p in parts if p not in self.whole]
            self.known[piece] = len(parts) - len(merge)
            for p in merge:
                rest.setdefault(p, []).append(piece)
        if rest:
            codes = self.tokenizer.encode_batch(list(rest), add_special_tokens=False)
            for owners, code in zip(rest.values(), codes, strict=True):
                for piece in owners:
                    self.known[piece] += len(code)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        out = []
        for text in texts:
            if not self.fits or any(s in text for s in self.special) or any(c in text for c in _ODD):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False)))
                continue
            pieces = text.split()
            if new := set(pieces).difference(self.known):
                self._learn(new)
            out.append(sum(map(self.known.__getitem__, pieces)))
        return out


def _counter(path: str, whole: Broadcast) -> _Counter:
    """This worker's counter: what it has learned stays from task to task."""
    if path not in _kept:
        _kept[path] = _Counter(path, whole.value)
    return _kept[path]


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; map-side only, no shuffle.

    The broadcast table of proven strings is bounded by the vocabulary."""
    spark = documents.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, whole)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, text = batch.column(0)[i : i + 256], batch.column(1)[i : i + 256].fill_null("")
                n = pa.array(counter.count(text.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
