"""Byte-level BPE: short pieces merged pair by pair, long ones by a table of every prefix's last token; and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, whole_text

#: Pieces and token pairs a task remembers; a full memory is emptied, which changes no result.
_REMEMBERED = 1_000_000
#: Pieces of so many bytes are merged pair by pair, which takes fewer look-ups there; longer ones by the table.
_SHORT = 48
#: Texts longer than this are cut into pieces a stretch at a time.
_STRETCH = 4_000_000


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Byte-pair merging as defined: again and again the pair of the lowest rank, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (below is None or rank < below) and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merged_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of the parts :func:`merge_by_rank` leaves; a merge looks up its two new pairs only."""
    get, none = ranks.get, 1 << 62
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) != none:
        at = pairs.index(best)
        parts[at] += parts.pop(at + 1)
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


class Vocabulary:
    """Ranks, and for each token the two tokens that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.text = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.halves[rank] = None
                continue
            parts = merge_by_rank(token, ranks, rank)
            if len(parts) == 2:  # else merging never makes this token; only a whole piece can be it
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a})

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens side by side.

        Their merges are undone from the last to the first. While both parts
        at the border exist, no merge across it may come before the next one
        inside; of equal ranks the one further left comes first.
        """
        ranks, text, halves = self.ranks, self.text, self.halves
        limit = len(ranks) << 8
        while True:
            across = ranks.get(text[left] + text[right])
            if across is not None and across < limit:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if a is not None and (b is None or left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]


class PrefixTable:
    """The encoding of every prefix of a byte string, told by its last token.

    Each prefix has one valid encoding, and what is left without its last
    token is the valid encoding of a shorter prefix. So an entry is the one
    token that ends the prefix and may follow the entry where it begins.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", known: dict[tuple[int, int], bool] | None = None):
        self.vocabulary = vocabulary
        self.known = {} if known is None else known
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _entry(self, data: bytes, end: int) -> int:
        ranks, halves, last, known = self.vocabulary.ranks, self.vocabulary.halves, self.last, self.known
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = ranks.get(data[start:end])
            if token is None or token not in halves:
                continue
            if start == 0:
                return token
            pair = (last[start - 1], token)
            fits = known.get(pair)
            if fits is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                fits = known[pair] = self.vocabulary.neighbours(*pair)
            if fits:
                return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, more: bytes) -> None:
        """Entries of the longer prefixes; those there are stay as they are."""
        data = self.data + more
        for end in range(len(self.data) + 1, len(data) + 1):
            self.last.append(self._entry(data, end))
        self.data = data

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Exchange bytes and return how many entries were made anew.

        Entries before the edit stay. After it, once as many entries in a row
        as the longest token has bytes are what they were, all later ones are
        too, as each depends on no others.
        """
        old, data = self.last, self.data[:start] + by + self.data[end:]
        shift = len(by) - (end - start)
        self.last = old[:start]
        same = 0
        for stop in range(start + 1, len(data) + 1):
            token = self._entry(data, stop)
            self.last.append(token)
            before = stop - shift
            same = same + 1 if stop > start + len(by) and old[before - 1] == token else 0
            if same >= self.vocabulary.longest:
                self.last.extend(old[before:])
                self.data = data
                return stop - start
        self.data = data
        return len(data) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, or of all."""
        out, text = [], self.vocabulary.text
        at = len(self.data) if end is None else end
        while at:
            out.append(self.last[at - 1])
            at -= len(text[out[-1]])
        return out[::-1]


class PieceCodes(dict):
    """Pieces of text with their ids as little-endian bytes, found when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.known = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        raw = piece.encode("utf-8", "surrogatepass")
        ranks = self.vocabulary.ranks
        whole = ranks.get(raw)
        if whole is not None:
            ids = [whole]
        elif len(raw) <= _SHORT:
            ids = merged_ids(raw, ranks)
        else:
            ids = PrefixTable(self.vocabulary, raw, self.known).tokens()
        code = self[piece] = np.array(ids, dtype="<u4").tobytes()
        return code


class Codec:
    """Encodes texts, pieces apart, and decodes ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        # the two engines differ in what \s is: here it is the Unicode property White_Space
        self.cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.codes = PieceCodes(vocabulary)
        size = max(vocabulary.text, default=0) + 1
        lengths = np.zeros(size + 1, dtype=np.int64)
        for rank, token in vocabulary.text.items():
            lengths[rank + 1] = len(token)
        self.begins = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(vocabulary.text.get(i, b"") for i in range(size)), dtype=np.uint8)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian bytes, one stretch of the text after the other."""
        look = self.codes.__getitem__
        if len(text) <= _STRETCH:
            yield b"".join([look(p) for p in self.cut.findall(text)])
            return
        pieces = (m.group() for m in self.cut.finditer(text))
        while some := list(islice(pieces, 200_000)):
            yield b"".join([look(p) for p in some])

    def decode(self, code: bytes) -> bytes:
        ids = np.frombuffer(code, dtype="<u4").astype(np.int64)
        if not len(ids):
            return b""
        starts = self.begins[ids]
        lengths = self.begins[ids + 1] - starts
        shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return self.bytes[np.arange(len(shift)) + shift].tobytes()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of what they decode to; the ids too if asked for.

    The file named by ``path`` is read on the driver and sent to the tasks; a
    vocabulary has a size set by its file, under a megabyte here.

    Defined cases: a missing text is empty and has no tokens; digests are
    then those of no bytes. Repeated rows come back as often as they are
    given, missing identifiers stay missing, an empty table gives no rows.
    Other columns aren't read.
    """
    pattern = pattern or default_pattern()
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_file(path or default_path()).__dict__)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.__new__(Vocabulary)
        vocabulary.__dict__.update(shared.value)
        codec = Codec(vocabulary, pattern)
        for batch in batches:
            counts, digests, decoded, codes = [], [], [], []
            for i in range(batch.num_rows):
                ids, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for code in codec.encode(batch.column("_text")[i].as_py() or ""):
                    ids.update(code)
                    back.update(codec.decode(code))
                    n += len(code) // 4
                    if keep_ids:
                        kept.append(code)
                counts.append(n)
                digests.append(ids.hexdigest())
                decoded.append(back.hexdigest())
                if keep_ids:
                    codes.append(np.frombuffer(b"".join(kept), dtype="<u4").astype(np.int32))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                names, columns = [*names, "ids"], [*columns, pa.array(codes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", whole_text().alias("_text")).mapInArrow(work, schema)
