"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token starts as its bytes.  The leaves of a segment tree hold, for every
adjacent pair, its merge rank and place; the root is their minimum, that is the
leftmost pair of lowest rank.  A merge changes three leaves, each of which is
carried to the root in logarithmic time, until no pair left can be merged.

Texts are encoded in bounded slices.  The distinct pre-tokens of a slice are
merged together: trees of one size are rows of one array, and one step merges
one pair in each of them.  Long pre-tokens, of which there are few, take the
same tree one at a time.  Nothing is shuffled; the vocabulary, of a fixed size,
is read on the driver from the path given and broadcast.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .cluster import ready

# fixed values: Unicode white space, and how a text is cut into pre-tokens
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")
SPACES = re.compile(f"[{SPACE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # split() takes these for space
NONE = np.int64(1) << 60
BATCH_LEAVES = 64  # pairs of the largest tree that is merged in rows
CACHE = 400_000  # chunks a task remembers


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, as arrays: small, and the same in every task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in (vocab | self.special).items()}
        self.size = max(token) + 1
        self.tokens = [token.get(i, "") for i in range(self.size)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.pair, self.rank_of = key[order], np.arange(len(pairs))[order]

    def encoder(self) -> "Encoder":
        """One encoder a worker: what it remembers serves the next task too."""
        if not hasattr(self, "_encoder"):
            self._encoder = Encoder(self)
        return self._encoder

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE if it can't be merged."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], NONE)


def merge_rows(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Merges each row of symbols (padded with -1) to the end; -1 where a symbol has gone."""
    rows, k = sym.shape
    leaves = 1 << max(1, (k - 1).bit_length())
    tree = np.full((rows, 2 * leaves), NONE, np.int64)
    place = np.arange(k - 1)
    r = v.rank(sym[:, :-1], sym[:, 1:])
    tree[:, leaves: leaves + k - 1] = np.where(r < NONE, r * leaves + place, NONE)
    for node in range(leaves - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    after = np.tile(np.arange(1, k + 1), (rows, 1))
    before = np.tile(np.arange(-1, k - 1), (rows, 1))
    live = np.flatnonzero(tree[:, 1] < NONE)
    depth = leaves.bit_length() - 1

    def put(row, leaf, value):
        node = leaves + leaf
        tree[row, node] = value
        for _ in range(depth):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    while len(live):
        rank, at = np.divmod(tree[live, 1], leaves)
        gone = after[live, at]
        nxt = after[live, gone]
        sym[live, at] = v.merged[rank]
        sym[live, gone] = -1
        after[live, at] = nxt
        inside = nxt < k
        before[live[inside], nxt[inside]] = at[inside]
        put(live, gone, NONE)
        right = np.where(inside, sym[live, np.minimum(nxt, k - 1)], -1)
        r = v.rank(sym[live, at], right)
        put(live, at, np.where(r < NONE, r * leaves + at, NONE))
        prev = before[live, at]
        has = prev >= 0
        p, rows_p = prev[has], live[has]
        r = v.rank(sym[rows_p, p], sym[rows_p, at[has]])
        put(rows_p, p, np.where(r < NONE, r * leaves + p, NONE))
        live = live[tree[live, 1] < NONE]
    return sym


def merge_one(v: Vocabulary, sym: list[int]) -> list[int]:
    """The same tree for one long pre-token."""
    k = len(sym)
    leaves = 1 << max(1, (k - 1).bit_length())
    none = int(NONE)
    table = dict(zip(v.pair.tolist(), v.rank_of.tolist())) if not hasattr(v, "table") else v.table
    v.table, merged = table, v.merged
    tree = [none] * (2 * leaves)

    def key(i, j):
        r = table.get(sym[i] * v.size + sym[j]) if 0 <= i and j < k else None
        return none if r is None else r * leaves + i

    for i in range(k - 1):
        tree[leaves + i] = key(i, i + 1)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, k + 1)), list(range(-1, k - 1))

    def put(leaf, value):
        node = leaves + leaf
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low

    while tree[1] < none:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        sym[at], sym[gone] = int(merged[rank]), -1
        after[at] = after[gone]
        if after[at] < k:
            before[after[at]] = at
        put(gone, none)
        put(at, key(at, after[at]))
        if before[at] >= 0:
            put(before[at], key(before[at], at))
    return [s for s in sym if s >= 0]


def encode_words(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Token ids of each pre-token (its UTF-8 bytes), as little-endian unsigned 32-bit integers."""
    out: list = [None] * len(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    level = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
    for bits in np.unique(level):
        at = np.flatnonzero(level == bits)
        if (1 << int(bits)) > BATCH_LEAVES:
            for i in at.tolist():
                b = np.frombuffer(words[i], np.uint8)
                out[i] = np.array(merge_one(v, [*v.inner[b[:-1]].tolist(), int(v.final[b[-1]])]), "<u4").tobytes()
            continue
        n, k = size[at], int(size[at].max())
        flat = np.frombuffer(b"".join(words[i] for i in at), np.uint8)
        sym = np.full((len(at), max(k, 2)), -1, np.int64)
        row = np.repeat(np.arange(len(at)), n)
        sym[row, W._ramp(n)] = v.inner[flat]
        sym[np.arange(len(at)), n - 1] = v.final[flat[np.cumsum(n) - 1]]
        sym = merge_rows(v, sym)
        kept = sym >= 0
        ids = sym[kept].astype("<u4").tobytes()
        end = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        for i, a, b in zip(at.tolist(), [0, *end], end):
            out[i] = ids[a:b]
    return out


def normalise(text: str) -> list[str]:
    """Chunks between white space of the composed, lower-cased text."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing is by character
    text = text.lower()
    return [x for x in SPACES.split(text) if x] if ODD_SPACE.search(text) else text.split()


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        self.special = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.known.keys())
        if len(self.known) + len(new) > CACHE:  # the older half goes
            for c in [c for c in islice(self.known, len(self.known) // 2) if c not in chunks]:
                del self.known[c]
        parts = [PRE_TOKEN.findall(c) for c in new]
        words = list({w for p in parts for w in p})
        of = dict(zip(words, encode_words(self.v, [w.encode() for w in words])))
        for c, p in zip(new, parts):
            self.known[c] = of[p[0]] if len(p) == 1 else b"".join([of[w] for w in p])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            t = t or ""
            if self.special and "<|" in t:
                cut.append([(x if x in self.v.special else normalise(x)) for x in self.special.split(t)])
            else:
                cut.append([normalise(t)])
        self.learn({c for parts in cut for p in parts if isinstance(p, list) for c in p})
        known = self.known
        return [b"".join([np.uint32(self.v.special[p]).astype("<u4").tobytes() if isinstance(p, str)
                          else b"".join([known[c] for c in p]) for p in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(vocabulary, text: str, names: list[str], decode: bool):
    def run(batches):
        enc = vocabulary.value.encoder()
        for rows, _, _ in W.chunks(batches, text, 4 * W.CHUNK_BYTES):
            ids = enc.encode(rows.column(rows.schema.get_field_index(text)).to_pylist())
            for a in range(0, len(ids), 256):  # bounds what is sent at once
                part = ids[a: a + 256]
                new = [pa.array(part, pa.binary())] + ([pa.array(map(enc.decode, part), pa.large_string()).cast(pa.string())] if decode else [])
                keep = rows.slice(a, len(part))
                yield pa.RecordBatch.from_arrays([keep.column(rows.schema.get_field_index(c)) for c in names[: len(names) - len(new)]] + new, names)
    return run


def encode_decode(docs: DataFrame, vocab_path: str, text: str = "text", columns: list[str] | None = None,
                  decode: bool = True) -> DataFrame:
    """``columns`` of every row of ``docs``, ``ids`` (binary, little-endian
    unsigned 32-bit) and, with ``decode``, ``decoded``.

    A null or blank text has no ids and decodes to the empty string.  The whole
    of a text is encoded, whatever its length.  The file's special tokens are
    recognised in texts.  Repeated rows are answered each; an empty table gives
    no rows.  Columns of ``docs`` called ``ids`` or ``decoded`` can't be kept.
    """
    spark = ready(docs)
    columns = ["doc_id"] if columns is None else [c for c in columns if c not in ("ids", "decoded")]
    wide = docs.select(*dict.fromkeys([*columns, text]))
    new = [T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decode
    schema = T.StructType([wide.schema[c] for c in columns] + new)
    sent = spark.sparkContext.broadcast(Vocabulary(vocab_path))
    return wide.mapInArrow(_coder(sent, text, [f.name for f in schema], decode), schema)


def digests(coded: DataFrame) -> DataFrame:
    """The contract's columns of :func:`encode_decode`."""
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
