"""Byte-level BPE: encoding by batched merge rounds, and decoding.

``encode`` adds the token ids of a text column as little-endian unsigned 32-bit integers,
``decode`` turns such a column back into text. The vocabulary file is a parameter and is read
once per Python worker.

Method: the pieces of a batch of texts that have not been met before are laid out in one flat
array of symbols. Each round looks up the ranks of changed neighbours by binary search in the
sorted pair keys, finds the lowest rank of every piece with one segmented minimum, merges all
its places at once and drops pieces that have no known pair left.

Defined results: a null text encodes as an empty one, null ids decode to an empty text; texts are
encoded whole whatever their length; repeated rows stay; other columns pass through, and one that
has the name of the added column is replaced.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from fleetlens.llm.common import with_columns

# Fixed value: how byte-level BPE cuts a text into pieces, with Unicode's white space. Letters come
# first, which changes nothing, as no other alternative begins with a letter.
PIECES = regex.compile(
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
)
NO_RANK = np.int32(1 << 30)
REMEMBERED = 150_000  # pieces a worker remembers, a bound on memory alone
TEXT_AT_ONCE = 1 << 20  # characters of texts whose new pieces are merged together


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next of U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = (spec["model"]["type"], (spec.get("pre_tokenizer") or {}).get("type"), (spec["pre_tokenizer"] or {}).get("add_prefix_space"))
        if kind != ("BPE", "ByteLevel", False) or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {kind}")
        vocab = spec["model"]["vocab"]
        character = byte_characters()
        back = {c: b for b, c in character.items()}
        self.byte_ids = np.array([vocab[character[b]] for b in range(256)], np.int32)
        self.token_bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: token.encode() for token, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = 1 << max(len(vocab) + len(self.special), max(self.token_bytes)).bit_length()
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.known: dict[str, bytes] = {}

    def ranks_of(self, ids: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place, NO_RANK if there is none within the piece."""
        out = np.full(len(at), NO_RANK)
        inner = at + 1 < len(ids)
        inner[inner] = piece[at[inner]] == piece[at[inner] + 1]
        key = ids[at[inner]].astype(np.int64) * self.size + ids[at[inner] + 1]
        where = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        out[inner] = np.where(self.pairs[where] == key, self.ranks[where], NO_RANK)
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        rank = self.ranks_of(ids, piece, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_RANK
            if done.any():
                raw = ids.astype("<u4").tobytes()
                for p, s, n in zip(piece[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[p] = raw[4 * s : 4 * (s + n)]
                stay = np.repeat(~done, sizes)
                ids, piece, rank, best, sizes = ids[stay], piece[stay], rank[stay], best[~done], sizes[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # Equal pairs overlap in a run like aaaa: every second place of the run merges.
            opens = np.r_[True, np.diff(at) != 1]
            at = at[(at - at[opens][np.cumsum(opens) - 1]) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            ids, piece, rank = ids[stay], piece[stay], rank[stay]
            at = place[at]
            near = np.zeros(len(ids), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            changed = np.flatnonzero(near)
            rank[changed] = self.ranks_of(ids, piece, changed)
        return out

    def parts(self, text: str) -> list[str]:
        """Pieces of a text; a special token's string is a piece of its own."""
        if self.cut is None or not self.cut.search(text):
            return PIECES.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else PIECES.findall(part)
        return out

    def learn(self, parts: set[str]) -> None:
        known = self.known
        fresh = parts.difference(known)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = parts
        special = [p for p in fresh if p in self.special]
        plain = [p for p in fresh if p not in self.special]
        known.update(zip(plain, self.merge([p.encode() for p in plain])))
        known.update((p, self.special[p].to_bytes(4, "little")) for p in special)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        waiting: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            waiting.append(self.parts(text or ""))
            size += len(text or "")
            if size >= TEXT_AT_ONCE or i + 1 == len(texts):
                self.learn(set().union(*waiting))
                out += [b"".join(map(self.known.__getitem__, parts)) for parts in waiting]
                waiting, size = [], 0
        return out

    def decode(self, ids: bytes | None) -> str:
        tokens = np.frombuffer(ids or b"", "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, tokens)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``into``: the ids of the whole text as little-endian unsigned 32-bit integers."""
    path = path or default_vocabulary()
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array(vocabulary(path).encode_many(batch.column(at).to_pylist()), pa.binary())]

    return with_columns(df, T.StructType([T.StructField(into, T.BinaryType())]), run)


def encode_checked(df: DataFrame, text: str = "text", into: str = "ids", restored: str = "restored", path: str | None = None) -> DataFrame:
    """Adds ``into`` as ``encode`` does, and ``restored``: whether the ids decode to the text again."""
    path = path or default_vocabulary()
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> list:
        known, texts = vocabulary(path), batch.column(at).to_pylist()
        ids = known.encode_many(texts)
        same = [known.decode(i) == (t or "") for i, t in zip(ids, texts)]
        return [pa.array(ids, pa.binary()), pa.array(same, pa.bool_())]

    return with_columns(df, T.StructType([T.StructField(into, T.BinaryType()), T.StructField(restored, T.BooleanType())]), run)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``into``: the text of an id column as ``encode`` writes it."""
    path = path or default_vocabulary()
    at = df.columns.index(ids)

    def run(batch: pa.RecordBatch) -> list:
        known = vocabulary(path)
        return [pa.array([known.decode(x) for x in batch.column(at).to_pylist()], pa.string())]

    return with_columns(df, T.StructType([T.StructField(into, T.StringType())]), run)
