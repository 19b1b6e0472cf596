"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is halved until a piece is short, pieces are encoded on their own, and neighbours are joined by
encoding a window around their border again. The window grows until tokens outside provably stay as they are:

* an end stands where *every* chain of matches of the pattern has a border, whatever lies on the other side; or
* an end stands inside a long run of one class (letters, digits, marks, white space), which is one match, and the token
  before it and the first one of the window are what their bytes together encode to. A sequence of tokens is the
  encoding of its bytes if and only if that holds for every two neighbours, so nothing further out can change.

Decoding concatenates bytes up the same kind of tree.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded
each on its own; very long texts and runs of one character cost in proportion to their length, times the logarithm for
copies of lists; columns other than the id and the text are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import threading
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, map_texts, named

#: Characters of a leaf. Shorter leaves only add joins; the ids never depend on it.
LEAF = 64
#: First width, in characters, of the window on either side of a border.
WINDOW = 32
#: Characters around an end inside a run that must belong to it too: contractions and a run's last space behave otherwise.
MARGIN = 4
#: White space as patterns understand it, and letters younger than some tables of them.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
YOUNG = range(0x2EBF0, 0x2EE5E)

_loaded: dict[tuple[str, str, int], ByteBPE] = {}
_lock = threading.Lock()


@functools.lru_cache(1 << 16)
def kind(c: str) -> str:
    """Class of a character in the pattern: S white space, L letter, N digit, O other; ? if tables may differ on it."""
    if c in SPACES:
        return "S"
    major = unicodedata.category(c)
    if major == "Cn" or ord(c) in YOUNG:
        return "?"
    return major[0] if major[0] in "LN" else "O"


def certain(text: str, p: int, end: int) -> bool:
    """Whether every chain of matches over ``text`` up to ``end`` has a border at ``p``.

    No alternative of the pattern looks back, holds a non-space character followed by white space, mixes letters, digits
    and marks (but for an apostrophe and letters), or goes on after white space other than one space before them.
    White space before a word ends one character early.
    """
    before, after = kind(text[p - 1]), kind(text[p])
    if after == "S":
        return before != "S" or p + 1 < end and kind(text[p + 1]) != "S"
    if before == "S":
        return text[p - 1] != " "
    return before != after and "?" not in (before, after) and not (after == "L" and text[p - 1] == "'")


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 for itself, others from U+0100 on."""
    visible = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of byte tokens and of special tokens, from ranks in tiktoken's format or a tokenizer's ``.json``.

    A JSON file must be byte-level BPE whose merges make ids in their order: then an id is a rank, and both formats mean the same.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model, of = read["model"], letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    plain = not any(read.get(k) for k in ("normalizer", "truncation", "padding")) and (read["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not read["pre_tokenizer"].get("add_prefix_space")
    odd = [t for t in read["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if not plain or odd or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path} is not a plain byte-level BPE whose ids follow its merges")
    special = {t["content"]: t["id"] for t in read["added_tokens"]}
    return {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}, special


class ByteBPE:
    """Encoder and decoder for a file of ranks (``read_ranks``). Special tokens' strings are plain text."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        ranks, self.special = read_ranks(ranks_path)
        self.leaf, self._pattern = leaf, pattern
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token

    @functools.cached_property
    def _encoding(self):
        """The leaf encoder; workers that only decode never build it."""
        import tiktoken

        ranks = {token: rank for rank, token in enumerate(self._bytes) if token}
        return tiktoken.Encoding("tarn", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    @functools.cached_property
    def _stays(self):
        """Whether two neighbours inside a match stay as they are."""
        whole = self._encoding._core_bpe.encode_single_piece
        return functools.lru_cache(1 << 16)(lambda a, b: whole(self._bytes[a] + self._bytes[b]) == [a, b])

    @property
    def tokens(self) -> list[bytes]:
        """The bytes of every id."""
        return self._bytes

    @classmethod
    def cached(cls, ranks_path: str, pattern: str, leaf: int = LEAF) -> ByteBPE:
        """One encoder a worker process."""
        with _lock:
            if (ranks_path, pattern, leaf) not in _loaded:
                _loaded[ranks_path, pattern, leaf] = cls(ranks_path, pattern, leaf)
            return _loaded[ranks_path, pattern, leaf]

    def encode(self, text: str) -> list[int]:
        """Token ids of the whole text."""
        return self._range(text, 0, len(text))

    def encode_special(self, text: str) -> list[int]:
        """Token ids of the whole text, the strings of special tokens as their ids."""
        if not any(t in text for t in self.special):
            return self.encode(text)
        longest = sorted(self.special, key=len, reverse=True)
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, longest)) + ")", text):
            out += [self.special[part]] if part in self.special else self.encode(part)
        return out

    def _range(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._piece(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._range(text, lo, mid), self._range(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        before = after = WINDOW
        while True:
            p, i, outer = self._end(text, lo, mid, hi, left, before, -1)
            q, j, next_ = self._end(text, lo, mid, hi, right, after, 1)
            if p == q:
                return left + right
            new = self._piece(text[p:q])
            good = outer is None or self._stays(outer, new[0]), next_ is None or self._stays(new[-1], next_)
            if all(good):
                return left[: len(left) - i] + new + right[j:]
            before, after = before if good[0] else 2 * before, after if good[1] else 2 * after

    def _end(self, text: str, lo: int, mid: int, hi: int, ids: list[int], width: int, step: int) -> tuple[int, int, int | None]:
        """An end of the window on one side of ``mid``, about ``width`` characters away at most: where it stands, how many
        of the side's tokens it covers, and the token beyond it if they are in one match."""
        far = lo if step < 0 else hi
        seen = lambda at: mid if at < mid else hi  # noqa: E731  # the side's own chain must have the border too
        stop = max(lo, mid - width) if step < 0 else min(hi, mid + width)
        for at in range(mid, stop, step):
            if lo < at < hi and certain(text, at, seen(at)):
                return at, self._covering(ids, len(text[min(at, mid) : max(at, mid)].encode()), step), None
        if stop != far and (found := self._inside(text, lo, mid, hi, ids, width, step)):
            return found
        at = stop
        while at != far:  # characters of unsure class, or a run that ends near by
            if certain(text, at, seen(at)):
                return at, self._covering(ids, len(text[min(at, mid) : max(at, mid)].encode()), step), None
            at += step
        return far, len(ids), None

    def _inside(self, text: str, lo: int, mid: int, hi: int, ids: list[int], width: int, step: int) -> tuple[int, int, int] | None:
        """An end between two tokens of a run of one class, if that goes on far enough."""
        raw = b""
        for n in range(1, len(ids)):
            token = self._bytes[ids[n - 1] if step > 0 else ids[-n]]
            raw = raw + token if step > 0 else token + raw
            if len(raw) < width:
                continue
            try:
                at = mid + step * len(raw.decode())
            except UnicodeDecodeError:
                continue  # between the bytes of a character
            beyond = ids[n] if step > 0 else ids[-n - 1]
            reach = len(self._bytes[beyond]) + MARGIN
            first, last = (at - reach, at + MARGIN) if step < 0 else (at - MARGIN, at + reach)
            kinds = {kind(c) for c in text[max(lo, first) : last]}
            if first < lo or last > hi or len(kinds) > 1 or "?" in kinds:
                return None
            return at, n, beyond
        return None

    def _covering(self, ids: list[int], n_bytes: int, step: int) -> int:
        """How many tokens at one end of ``ids`` make up ``n_bytes``."""
        count = 0
        while n_bytes > 0:
            n_bytes -= len(self._bytes[ids[count] if step > 0 else ids[-1 - count]])
            count += 1
        if n_bytes:
            raise ValueError("a certain border lies inside a token")
        return count

    def decode(self, ids) -> bytes:
        """Bytes of the ids, halves first."""
        if len(ids) <= self.leaf:
            table = self._bytes
            return b"".join([table[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids packed as little-endian unsigned 32-bit integers, one row per input row."""

    def setup():
        bpe = ByteBPE.cached(ranks_path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.array(bpe.encode(t), dtype="<u4").tobytes() if t else b"" for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return work

    key = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, text_col, [named(id_col).alias("doc_id")], f"doc_id {key}, ids binary", setup)


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``(*keep, decoded)``: the bytes that each row's packed ids stand for."""
    kept = encoded.select(*map(named, keep))

    def run(batches):
        bpe = ByteBPE.cached(ranks_path, pattern)
        for batch in batches:
            out = [bpe.decode(np.frombuffer(b or b"", dtype="<u4").tolist()) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], [*keep, "decoded"])

    bound_batches(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return encoded.select(named(ids_col).alias("ids_in"), *map(named, keep)).mapInArrow(run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode what was encoded: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    encoded = encode_texts(docs, ranks_path, pattern, id_col, text_col).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )
    decoded = decode_ids(encoded, ranks_path, pattern, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
