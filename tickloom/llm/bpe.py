"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

The merge list fixes how far text to the right can change a token boundary.
Two runs of the merges over ``x`` and ``xy`` first differ at the end of ``x``;
each later difference lies one left part further left and needs a merge of
higher rank whose right part begins with the left part before it.  The longest
such chain, in bytes, is the sufficient lookahead: a boundary that far from the
end of what was read is final.  The encoder reads bytes, keeps at most twice
the lookahead of them, and emits tokens once their ends are final, so its memory
does not depend on the length of a word.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.common import append_arrow, int_lists, texts_of

# The vocabulary file's word pattern and its white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

NONE = 1 << 30
CACHE_WORDS = 300_000
CACHE_CHARS = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare_letter = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare_letter))
            spare_letter += 1
    return out


class Vocabulary:
    """Merges, as ids, of a vocabulary file with word ends."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (ids | self.special).items()}
        self.letters = byte_letters()
        self.inner = [ids[x] for x in self.letters]
        self.last = [ids[x + self.end] for x in self.letters]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): i for i, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.sizes = {i: len(t.removesuffix(self.end)) for t, i in ids.items()}
        self.lookahead = self._lookahead(pairs)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Bytes to the right of a boundary that can still move it."""
        base = {*self.letters, *(x + self.end for x in self.letters)}
        made, best = set(base), {}
        for a, b in pairs:
            if a not in made or b not in made:
                raise ValueError(f"merge of {a!r} and {b!r} comes before one of them")
            reach = max((best.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0) + len(a.removesuffix(self.end))
            best[a] = max(best.get(a, 0), reach)
            made.add(a + b)
        return max(best.values(), default=1)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges over ``ids``, lowest rank first, leftmost first."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.ranks.get
        ranks = list(map(get, zip(ids, ids[1:]), repeat(NONE)))
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list."""
        ranks, n = self.ranks, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        token = list(ids)
        heap = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            j = after[i] if token[i] == a else -1
            if j < 0 or token[j] != b:
                continue
            token[i], token[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(p := (token[i], token[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := ranks.get(p := (token[h], token[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return [t for t in token if t >= 0]


class Transducer:
    """Bytes of one word in, token ids out as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None) -> None:
        self.v = vocabulary
        self.keep = max(1, window or vocabulary.lookahead)
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        v, keep = self.v, self.keep
        for i in range(0, len(data), keep):
            self.buffer += data[i : i + keep]
            # The last byte read may yet be the word's last, which is another symbol.
            if (n := len(self.buffer) - 1) > 2 * keep:
                upto = done = 0
                for t in v.merge([v.inner[b] for b in self.buffer[:n]]):
                    upto += v.sizes[t]
                    if upto > n - keep:
                        break
                    done = upto
                    yield t
                del self.buffer[:done]

    def word(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a whole word; a short one would only pass through the buffer."""
        if len(data) > self.keep:
            return (*self.feed(data), *self.close())
        ids = [self.v.inner[b] for b in data]
        ids[-1] = self.v.last[data[-1]]
        return tuple(self.v.merge(ids))

    def close(self) -> list[int]:
        """The tokens of what is left; the next byte starts a new word."""
        if not self.buffer:
            return []
        ids = [self.v.inner[b] for b in self.buffer]
        ids[-1] = self.v.last[self.buffer[-1]]
        self.buffer.clear()
        return self.v.merge(ids)


class Encoder:
    """Texts to token ids, with a bounded memory of short words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.transducer = Transducer(vocabulary)
        self.word = regex.compile(WORD)
        self.space = re.compile(SPACE)
        self.odd = re.compile("[\x1c-\x1f]")
        self.marks = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> list[int]:
        """Ids of a run without white space, in time proportional to its length."""
        # Letter by letter: the final form of a sigma is not made here.
        plain = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        known, ids = self.known, []
        # A run of letters is one word, as the pattern has it.
        for w in (plain,) if plain.isalpha() else self.word.findall(plain):
            if (got := known.get(w)) is None:
                got = self.transducer.word(w.encode())
                if len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = got
            ids += got
        return ids

    def pieces(self, text: str) -> list[str]:
        """White-space runs of a text and its special tokens, in order."""
        if self.marks and any(s in text for s in self.v.special):
            return [x for part in self.marks.split(text) for x in ((part,) if part in self.v.special else self.runs(part))]
        return self.runs(text)

    def runs(self, text: str) -> list[str]:
        # These four controls are no white space here, but str.split() cuts at them.
        return [x for x in self.space.split(text) if x] if self.odd.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, special = self.known.get, self.v.special
        for p in self.pieces(text):
            # What is known is in lower case, composed, and one word.
            if (got := known(p)) is None:
                got = (special[p],) if p in special else self.piece(p)
            out += got
        return out


class ByteToText:
    """Token ids in, text out: letters become bytes, bytes become code points as they complete.

    A word end is a blank.  A special token is its own string.  Bytes that are
    no UTF-8 become U+FFFD.  With ``spell`` the vocabulary's own strings come out,
    joined by blanks, as a tokenizer file without a decoder part has it; what is
    kept then is whether a token went before.
    """

    def __init__(self, vocabulary: Vocabulary, *, spell: bool = False) -> None:
        self.v = vocabulary
        self.spell, self.begun = spell, False
        self.bytes_of = {x: b for b, x in enumerate(vocabulary.letters)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        if self.spell:
            if text := " ".join(map(self.v.names.__getitem__, ids)):
                yield " " + text if self.begun else text
                self.begun = True
            return
        for i in ids:
            name = self.v.names[i]
            if name in self.v.special:
                yield self.state.decode(b"", final=True) + name
                self.state.reset()
                continue
            ended = bool(self.v.end) and name.endswith(self.v.end)
            data = bytes(self.bytes_of[c] for c in (name[: -len(self.v.end)] if ended else name))
            yield self.state.decode(data) + (" " if ended else "")

    def close(self) -> str:
        """What is left; the next token starts a new text."""
        self.begun = False
        return self.state.decode(b"", final=True)


#: Ids decoded at a time.
FEED = 4096


def decoded_digest(machine: ByteToText, ids: list[int]) -> str:
    """SHA-256 of the text of a row's ids, fed to the decoder and on to the hash piece by piece."""
    h = hashlib.sha256()
    for i in range(0, len(ids), FEED):
        for piece in machine.feed(ids[i : i + FEED]):
            h.update(piece.encode())
    h.update(machine.close().encode())
    return h.hexdigest()


def encode_documents(
    df: DataFrame, vocabulary_json: str, text: str = "text", ids: str = "ids", n: str = "n_tokens", decoded: str | None = None
) -> DataFrame:
    """Append ``ids`` array<int> and ``n`` long; null text counts as empty, empty text has no ids.

    With ``decoded`` the digest of the text that the decoder makes of the ids is
    appended, too.  Repeated rows repeat; taken names get underscores.  The
    vocabulary (a bounded file) is sent to the tasks once.  No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_json)

    def make():
        v = Vocabulary(shared.value)
        enc, machine = Encoder(v), ByteToText(v, spell=True)

        def fn(column: pa.Array):
            chunks, counts, texts = [], [], []
            for t in texts_of(column):
                row = enc.encode(t)
                counts.append(len(row))
                chunks.append(struct.pack(f"<{len(row)}i", *row))
                if decoded:
                    texts.append(decoded_digest(machine, row))
            out = [int_lists(chunks, counts), pa.array(counts, pa.int64())]
            return [*out, pa.array(texts, pa.string())] if decoded else out

        return fn

    fields = [(ids, T.ArrayType(T.IntegerType())), (n, T.LongType())]
    return append_arrow(df, [text], [*fields, (decoded, T.StringType())] if decoded else fields, make)


def decode_ids(df: DataFrame, vocabulary_json: str, ids: str = "ids", out: str = "decoded", *, spell: bool = False) -> DataFrame:
    """Append the text of an array<int> column; null ids give an empty text.

    ``spell`` gives the vocabulary's own strings, joined by blanks, as a
    tokenizer file without a decoder part does.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_json)

    def make():
        v = Vocabulary(shared.value)

        def one(row) -> str:
            m = ByteToText(v, spell=spell)
            return "".join(m.feed(row)) + m.close()

        def fn(column: pa.Array):
            return [pa.array([one(r or ()) for r in column.to_pylist()], pa.string())]

        return fn

    return append_arrow(df, [ids], [(out, T.StringType())], make)


def digests(df: DataFrame, vocabulary_json: str, text: str = "text") -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass,
    so that ids and decoded texts need not leave the task.

    Null text is empty; repeated rows repeat; taken names get underscores.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_json)

    def make():
        v = Vocabulary(shared.value)
        enc, machine, digits = Encoder(v), ByteToText(v, spell=True), {i: str(i) for i in v.names}

        def fn(column: pa.Array):
            n, a, b = [], [], []
            for t in texts_of(column):
                ids = enc.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(decoded_digest(machine, ids))
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return fn

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_arrow(df, [text], fields, make)
