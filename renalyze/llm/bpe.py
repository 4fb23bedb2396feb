"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be joined
by a merge, whatever stands around it: between its bytes there is a certain
cut.  Every text is cut at such pairs, the fragments are encoded one by one,
and their ids are concatenated.  The vocabulary's own splitting pattern is
applied too, since it cuts some pairs that tokens do contain.

Cuts are taken in two steps.  No token holds a space after another byte (but
for a no-break space's last byte, which the pattern parts from the space that
follows a letter), so texts first fall into words there (``str.split``); a
word's ids depend on nothing else and are kept in a bounded table, since words
repeat.  A word that isn't in the table is split by the
pattern, and each piece at its forced byte pairs; what is left goes
through the merges in rank order.

Long fragments use a heap of candidate merges (n log n), short ones a plain
scan; both give the lowest rank, leftmost first.  Ids are carried as packed
little-endian unsigned 32-bit integers.

Defined cases: null text is empty, and no ids decode to an empty text; the
vocabulary's special strings in a text become their single ids, as in the
tokenizers library; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_WORDS = 600_000            # words kept a worker; speed only
TABLE_CHARS = 48                 # longer words aren't kept
SCAN_BYTES = 48                  # longer fragments use the heap

_SPACE_BEFORE_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_NO_MERGE = (1 << 60, -1)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file:
    printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Word -> packed ids, filled on demand up to a bound."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.prefix + word)
        if len(self) < TABLE_WORDS and len(word) <= TABLE_CHARS:
            self[word] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        raw = {token: bytes(letters[c] for c in token) for token in vocab}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: raw[t] for t, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.byte_id = [0] * 256
        for token, i in vocab.items():
            if len(raw[token]) == 1:
                self.byte_id[raw[token][0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        inside = np.zeros(65536, dtype=bool)
        for data in raw.values():
            for x, y in zip(data, data[1:]):
                inside[x << 8 | y] = True
        self.inside = inside.tolist()
        self.pattern = regex.compile(PATTERN)
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        from tokenizers import Tokenizer
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.first, self.spaced = _Words(self._chunk, ""), _Words(self._chunk, " ")

    # ---- encoding

    def encode(self, text: str) -> bytes:
        """Packed ids of ``text``."""
        if self.special_split is None or "<" not in text:
            return self._plain(text)
        parts = self.special_split.split(text)
        return b"".join(self.specials[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        words = _CUT.split(text) if _SPACE_BEFORE_SPACE.search(text) else text.split(" ")
        head = self.first[words[0]] if words[0] else b""
        return head + b"".join(map(self.spaced.__getitem__, words[1:]))

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces(chunk)
        if len(pieces) > 1:
            return b"".join([self.spaced[p[1:]] if p[0] == " " else self.first[p] for p in pieces])
        out: list[int] = []
        for piece in pieces:
            for fragment in self.fragments(piece.encode()):
                out += self.merge(fragment)
        return pack_ids(out)

    def pieces(self, chunk: str) -> list[str]:
        """``chunk`` split by the vocabulary's pattern.  Code points unassigned in
        this Python's Unicode tables may be letters in the library's: it splits those."""
        if not chunk.isascii() and any(category(c) == "Cn" for c in chunk):
            return [chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk)]
        return self.pattern.findall(chunk)

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` cut at every byte pair that no token contains."""
        inside, cuts = self.inside, [0]
        for k in range(1, len(data)):
            if not inside[data[k - 1] << 8 | data[k]]:
                cuts.append(k)
        cuts.append(len(data))
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > SCAN_BYTES:
            return self._merge_heap(ids)
        get, none = self.merges.get, _NO_MERGE
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k:k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, a, b, new) for rank, new, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue                      # one of the two has been merged since
            ids[k], ids[r], right[k] = new, -1, right[r]
            if right[r] >= 0:
                left[right[r]] = k
                if m := merges.get((new, ids[right[r]])):
                    heapq.heappush(heap, (m[0], k, new, ids[right[r]], m[1]))
            if left[k] >= 0 and (m := merges.get((ids[left[k]], new))):
                heapq.heappush(heap, (m[0], left[k], ids[left[k]], new, m[1]))
        return [i for i in ids if i >= 0]

    # ---- decoding

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder (and word table) a worker process."""
    return ByteBpe(path)


class CompiledWords(ByteBpe):
    """The same ids; words that aren't in the table go through a compiled
    encoder of the same vocabulary (for operators that only need the ids)."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken
        ranks = {self.token_bytes[i]: i for i in self.token_bytes if i not in self.specials.values()}
        self.compiled = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and any(category(c) == "Cn" for c in chunk):
            return super()._chunk(chunk)
        return pack_ids(self.compiled(chunk))


@lru_cache(maxsize=2)
def compiled_encoder(path: str) -> CompiledWords:
    return CompiledWords(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, packed little-endian unsigned 32-bit), decoded (string)."""
    path = path or vocabulary_path()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string"

    def run(batches):
        bpe = encoder(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
                                  names=["doc_id", "ids", "decoded"])

    return src.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    d = encode_decode(docs, path)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
