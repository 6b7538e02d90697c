"""Token counts of texts under a unigram vocabulary, by trie-shared dynamic programming.

A text's pre-tokens are its words, each behind the vocabulary's word mark.  The
distinct pre-tokens of a slice of texts are put into a trie.  A trie node is a
shared prefix, and its best score and token count are computed once, from the
nodes that lie one vocabulary piece above it; the counts are stored at the
nodes where pre-tokens end and summed per text.

The nodes of one depth are computed together as arrays.  Slices are bounded, so
is the trie; what a task has counted it remembers up to a bound.  Nothing is
shuffled, and the vocabulary, of a fixed size, is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W
from .cluster import ready

CACHE = 1 << 19
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest score of a piece, for a character without one


class Unigram:
    """Pieces of a vocabulary file with their scores, keyed by a hash of their bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        data = [p.encode() for p, _ in pieces]
        flat = np.frombuffer(b"".join(data), np.uint8)
        n = np.fromiter(map(len, data), np.int64, len(data))
        h = rolling(flat, np.cumsum(n) - n, n)
        order = np.argsort(h)
        self.key, self.score = h[order], np.array([s for _, s in pieces])[order]
        self.longest = int(n.max())
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    @classmethod
    def load(cls, path: str) -> "Unigram":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
                    if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])

    def find(self, h: np.ndarray):
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return self.key[at] == h, self.score[at]


_STEP, _BYTE = W.U(0x9E6C63D0876A9A63), W.seeds(256, 17)


def rolling(flat, start, n):
    """Hash of each span that can be built up byte by byte."""
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(n.max(initial=0))):
            live = np.flatnonzero(n > k)
            h[live] = h[live] * _STEP + _BYTE[flat[start[live] + k]]
    return h


def count_words(v: Unigram, words: list[bytes]) -> np.ndarray:
    """Tokens of the best segmentation of each distinct word (bytes, mark included).

    Highest total score wins; of equal ones the one whose last piece is the
    shortest, and so on towards the front.  A character that no piece covers
    costs one token for each of its bytes.
    """
    words_at = sorted(range(len(words)), key=words.__getitem__)
    flat = np.frombuffer(b"".join(words[i] for i in words_at), np.uint8)
    n = np.fromiter((len(words[i]) for i in words_at), np.int64, len(words))
    start = np.cumsum(n) - n
    out = np.zeros(len(words), np.int32)
    # per depth: the node of each word (sorted words of one prefix stand together)
    node = np.zeros(len(words), np.int64)
    hashes, scores, counts, parents = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)], []
    live = np.arange(len(words))
    powers = np.ones(v.longest + 2, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, len(powers)):
            powers[k] = powers[k - 1] * _STEP
    depth = 0
    base = 0  # first depth kept: pieces reach back no further
    while len(live):
        b = flat[start[live] + depth]
        new = np.ones(len(live), bool)
        new[1:] = (node[live][1:] != node[live][:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        parent, byte = node[live][first], b[first]
        with np.errstate(over="ignore"):
            h = hashes[-1][parent] * _STEP + _BYTE[byte]
        best = np.full(len(first), -np.inf)
        count = np.zeros(len(first), np.int64)
        up, chain = parent, []
        for length in range(1, min(depth + 1, v.longest, 1 + depth - base) + 1):
            if length > 1:
                up = parents[depth - length + 1 - base][up]
            chain.append(up)
            anc = depth + 1 - length - base
            with np.errstate(over="ignore"):
                piece = h - hashes[anc][up] * powers[length]
            has, s = v.find(piece)
            total = np.where(has, scores[anc][up] + s, -np.inf)
            better = total > best
            best = np.where(better, total, best)
            count = np.where(better, counts[anc][up] + 1, count)
        # the last character as bytes, where a character ends here (or could: a byte of none)
        for size in range(1, min(4, depth + 1 - base) + 1):
            anc = depth + 1 - size - base
            lead = _lead(flat, start[live][first] + depth + 1 - size)
            ends = lead == size
            total = np.where(ends & np.isfinite(scores[anc][chain[size - 1]]), scores[anc][chain[size - 1]] + v.unknown, -np.inf)
            better = total > best
            best = np.where(better, total, best)
            count = np.where(better, counts[anc][chain[size - 1]] + size, count)
        hashes.append(h), scores.append(best), counts.append(count), parents.append(parent)
        node[live] = number
        depth += 1
        done = n[live] == depth
        out[np.asarray(words_at)[live[done]]] = count[number[done]]
        live = live[~done]
        if depth - base > v.longest + 4:
            hashes.pop(0), scores.pop(0), counts.pop(0), parents.pop(0)
            base += 1
    return out


def _lead(flat, at):
    """Bytes of the UTF-8 character that starts at each place, 0 inside one."""
    b = flat[at]
    return np.select([b < 0x80, b < 0xC0, b < 0xE0, b < 0xF0], [1, 0, 2, 3], 4)


def _counter(sent, text: str, keep: list[str], names: list[str]):
    mark = MARK.encode()

    def run(batches):
        v = sent.value
        for rows, data, off in W.chunks(batches, text, 4 * W.CHUNK_BYTES):
            w = W.find_words(data, off, lower=False)
            h, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            keys, known = v.known
            place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            have = keys[place] == h if len(keys) else np.zeros(len(h), bool)
            count = np.zeros(len(h), np.int64)
            if len(keys):
                count[have] = known[place[have]]
            raw = data.tobytes()
            missing = np.flatnonzero(~have)
            words = [mark + raw[w.start[k]: w.end[k]] for k in at[missing].tolist()]
            count[missing] = count_words(v, words)
            merged = np.concatenate([keys, h[missing]]) if len(keys) + len(missing) <= CACHE else h
            values = np.concatenate([known, count[missing]]) if len(merged) != len(h) or len(keys) + len(missing) <= CACHE else count
            order = np.argsort(merged, kind="stable")
            v.known = merged[order], values[order]
            per = np.concatenate([[0], np.cumsum(count[inverse])])
            n = per[w.offsets[1:]] - per[w.offsets[:-1]]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in keep]
                                             + [pa.array(np.diff(w.offsets), pa.int64()), pa.array(n.astype(np.int64))], names)
    return run


def count_tokens(docs: DataFrame, vocab_path: str, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row of ``docs``, its ``n_pretokens`` (words) and ``n_tokens``.

    White space only separates words.  A null, empty or blank text has no
    tokens.  Repeated rows are answered each; an empty table gives no rows.
    Columns of ``docs`` called like the new ones can't be kept.
    """
    spark = ready(docs)
    columns = ["doc_id"] if columns is None else [c for c in columns if c not in ("n_pretokens", "n_tokens")]
    wide = docs.select(*dict.fromkeys([*columns, text]))
    schema = T.StructType([wide.schema[c] for c in columns] + [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    sent = spark.sparkContext.broadcast(Unigram.load(vocab_path))
    return wide.mapInArrow(_counter(sent, text, columns, [f.name for f in schema]), schema)
