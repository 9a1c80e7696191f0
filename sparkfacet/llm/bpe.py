"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces that a task has not met yet go into a trie,
which is walked depth first. A node stands for a prefix; its state is the last token of the prefix's encoding. The
encoding of a prefix is that of a shorter prefix plus one token t, where t is a suffix of the prefix and the last token
before it followed by t encodes to just these two tokens. So a node's state comes from its ancestors' states, and a
prefix that many pieces share is encoded once.

Cases: a null text is an empty text; an empty text has no tokens; a text of any length is encoded whole; repeated rows
are encoded alike; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfacet.llm._arrow import gather, list_array, slices, text_buffers

#: Fixed value: the byte-level pattern, with white space as Unicode's White_Space property.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Unicode versions may class other characters differently: a text with any beyond these is cut by the tokenizer's library.
UNSETTLED = regex.compile(r"[^\x00-ɏ‐-⁞€ぁ-ゖァ-ヺ一-龥가-힣]").search
#: Pieces that a worker remembers; more are forgotten and encoded again, to bound memory.
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """The vocabulary of one tokenizer file, and the pieces encoded so far by this process."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd:
            raise ValueError(f"{path}: only a plain byte-level BPE is supported {odd}")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens with single_word, lstrip or rstrip aren't supported")
        alphabet = byte_alphabet()
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in model["vocab"].items()}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.parts = {token: pair for pair, (_, token) in self.merges.items()}
        self.rank = dict.fromkeys(self.bytes_of, -1) | {token: rank for rank, token in self.merges.values()}
        if len(self.parts) < len(self.merges):
            raise ValueError(f"{path}: two merges make one token")
        self.longest = max(map(len, self.ids))
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.path, self.library = path, None
        self.own: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        n = max(self.bytes_of) + 1
        table = [self.bytes_of.get(i, b"") for i in range(n)]
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def merged(self, ids: list[int]) -> list[int]:
        """The merges applied one by one, lowest rank and leftmost first; for short runs only."""
        while len(ids) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        found = self.own.get(token)
        if found is None:
            raw = self.bytes_of[token]
            found = self.own[token] = self.merged([self.ids[raw[k : k + 1]] for k in range(len(raw))]) == [token]
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens encode to just these two: back in time along the boundary, no merge across it comes first."""
        x, y, before = left, right, len(self.parts)
        rank = self.rank
        while True:
            across = self.merges.get((x, y))
            if across is not None and across[0] < before:
                return False
            if rank[x] > rank[y]:  # x came to be last: before that, its right part stood here
                before, x = rank[x], self.parts[x][1]
            elif rank[y] >= 0:  # of equal pairs the left one is merged first
                before, y = rank[y] + 1, self.parts[y][0]
            else:
                return True

    def learn(self, words: list[str]) -> None:
        """Encode pieces into the memo. In sorted order their trie is walked depth first: path is the branch that leads to the node."""
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        path, states = b"", [-1]  # the last token of each prefix of path
        find, fits, longest = self.ids.get, self.fits, self.longest
        for raw, word in sorted((w.encode(), w) for w in words):
            keep, most = 0, min(len(path), len(raw))
            while keep < most and path[keep] == raw[keep]:
                keep += 1
            del states[keep + 1 :]
            for end in range(keep + 1, len(raw) + 1):
                for begin in range(max(0, end - longest), end):
                    token = find(raw[begin:end])
                    if token is None:
                        continue
                    if begin:
                        pair = (states[begin], token)
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self.may_follow(*pair)
                    else:
                        fit = self.whole(token)
                    if fit:
                        states.append(token)
                        break
            path, ids, end = raw, [], len(raw)
            while end:
                ids.append(states[end])
                end -= len(self.bytes_of[states[end]])
            self.memo[word] = np.array(ids[::-1], np.int32).tobytes()

    def cut(self, text: str) -> list[str]:
        if UNSETTLED(text) is None:
            return self.pieces(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The token ids of each text, as the bytes of 32-bit integers."""
        runs: list[list] = []  # per text: pieces, or ids of added tokens
        for text in texts:
            if self.split is not None and any(t in text for t in self.added):
                run: list = []
                for k, part in enumerate(self.split.split(text)):
                    run += [self.added[part]] if k % 2 else self.cut(part)
                runs.append(run)
            else:
                runs.append(self.cut(text))
        every = set().union(*runs)
        new = every - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = every
        self.learn([w for w in new if isinstance(w, str)])
        self.memo.update((k, np.array([k], np.int32).tobytes()) for k in new if isinstance(k, int))
        return [b"".join(map(self.memo.__getitem__, run)) for run in runs]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lengths = self.lengths[ids]
        raw = gather(self.flat, self.starts[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, token_ids array<int> and decoded string (the text made from the ids) of each row.

    path: a tokenizer file that every executor can open at the same place, as an installed package gives.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                texts = [t or "" for t in batch.column(1)[a:b].to_pylist()]
                packed = code.encode(texts)
                ids = np.frombuffer(b"".join(packed), np.int32)
                counts = np.array([len(p) // 4 for p in packed], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], list_array(ids, counts, pa.int32()), pa.array(code.decode(ids, counts), pa.string())], names=["id", "token_ids", "decoded"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, token_ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id", *keep: str) -> DataFrame:
    """The number of ids, and SHA-256 of the comma-joined ids and of the decoded text; keep: further columns."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select(id_col, *keep, F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
