"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a batch are sorted, which makes the list a depth-first walk of their trie:
between neighbours only the path below their common prefix is new.  Along the path the state of a
prefix is the last token of its encoding.  The next state is the only vocabulary token that ends
here and whose seam with the state before it holds, i.e. no merge would have joined the two sides;
a word's tokens are read back along the states.  So a prefix shared by many words is encoded once.

Spark deals out the texts; a task holds one Arrow batch, the vocabulary (broadcast, its size is
the file's) and a bounded table of words already encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD_TABLE = 400_000  # words kept encoded in a worker; beyond it the table starts anew
SEAM_TABLE = 500_000  # token pairs whose seam has been looked at, likewise

# From here on letters and cases depend on the Unicode version (below: Latin, Greek, Cyrillic).
EXOTIC = "\u0530"

# White space as the vocabulary's own patterns define it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"


def _ranges(kind: str) -> str:
    """Ranges of a pattern's class for the letters (L) or numbers (N) below EXOTIC."""
    hits = [c for c in range(ord(EXOTIC)) if unicodedata.category(chr(c))[0] == kind]
    runs = [[c, c] for c in hits if c - 1 not in hits]
    for r in runs:
        while r[1] + 1 in hits:
            r[1] += 1
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is printable Latin-1, else the next free character from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, read from the JSON text of a ``tokenizers`` file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        ids = model["vocab"]
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        # rank of a token: 0 for single bytes, else 1 + the number of its merge
        self.rank, self.halves, self.joined = {}, {}, {}
        for n, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = ids[left], ids[right], ids[left + right]
            self.rank[whole], self.halves[whole], self.joined[left, right] = n + 1, (left, right), whole
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        lone: set[int] = set()
        for s, i in sorted(ids.items(), key=lambda x: self.rank.get(x[1], 0)):
            if i in self.special.values():
                continue
            # a token whose own bytes would merge otherwise never appears
            if i in self.halves:
                left, right = self.halves[i]
                if left not in lone or right not in lone or not self.seam_holds(left, right, self.rank[i]):
                    continue
            lone.add(i)
            ends = s.endswith(end) and len(s) > len(end)
            raw = bytes(of_char[c] for c in (s[:-len(end)] if ends else s))
            (self.final if ends else self.inner)[raw] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.length = {i: len(b) for t in (self.inner, self.final) for b, i in t.items()}
        letters, numbers = _ranges("L"), _ranges("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seams: dict[int, bool] = {}
        self.splitter = None
        self.source = text
        self.known: dict[str, bytes] = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}

    def seam_holds(self, left: int, right: int, below: int = 1 << 62) -> bool:
        """No merge of rank under ``below`` joins the token ``left`` with its neighbour ``right``.

        The two sides are taken back in time, latest merge first; before each step the tokens at
        the seam stood side by side and must not have been a pair that merges earlier than what
        was undone.  Of equal merges the left one comes first.
        """
        rank = self.rank
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and rank[whole] < below:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if not a and not b:
                return True
            if a > b:
                below, left = a, self.halves[left][1]
            else:
                below, right = b + 1, self.halves[right][0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; ``words`` sorted, so neighbours share their prefix's states."""
        inner, final, longest, seams = self.inner, self.final, self.longest, self.seams

        def seam(pair: int) -> bool:
            if len(seams) >= SEAM_TABLE:
                seams.clear()
            holds = seams[pair] = self.seam_holds(pair >> 24, pair & 0xFFFFFF)
            return holds

        out, before, state = [], b"", [-1]  # state[d]: last token of the first d bytes
        for w in words:
            if w in final:  # the whole word is one token; its prefixes' states are not needed
                out.append([final[w]])
                continue
            d, top = 0, min(len(before), len(w) - 1, len(state) - 1)
            while d < top and before[d] == w[d]:
                d += 1
            del state[d + 1:]
            for at in range(d + 1, len(w)):
                for start in range(at - longest if at > longest else 0, at):
                    t = inner.get(w[start:at])
                    if t is not None:
                        if start:
                            pair = state[start] << 24 | t
                            holds = seams.get(pair)
                            if not (seam(pair) if holds is None else holds):
                                continue
                        state.append(t)
                        break
            n = len(w)
            for k in range(min(n, longest), 0, -1):
                t = final.get(w[n - k:])
                if t is not None and (k == n or seam(state[n - k] << 24 | t)):
                    break
            ids, at = [t], n - k
            while at:
                ids.append(state[at])
                at -= self.length[state[at]]
            out.append(ids[::-1])
            before = w
        return out

    def split(self, text: str) -> list[str]:
        """Special tokens and lower-case words of a text, in order."""
        out: list[str] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                # lower case character by character: no final-sigma rule
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                exotic = not low.isascii() and max(low) >= EXOTIC
                out += self.split_exotic(part) if exotic else self.words.findall(low)
        return out

    def split_exotic(self, part: str) -> list[str]:
        """Words of a text with scripts whose letters depend on the Unicode version: normalised
        and split by the library the vocabulary is for."""
        if self.splitter is None:
            from tokenizers import Tokenizer
            self.splitter = Tokenizer.from_str(self.source)
            self.of_char = {c: b for b, c in enumerate(byte_alphabet())}
        t = self.splitter
        return [bytes([self.of_char[c] for c in w]).decode()
                for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))]

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        known = self.known
        if len(known) > WORD_TABLE:
            known.clear()
            known.update({s: np.array([i], "<u4").tobytes() for s, i in self.special.items()})
        new = {w.encode(): w for w in set().union(*split) if w not in known}
        order = sorted(new)
        for w, ids in zip(order, self.encode_words(order)):
            known[new[w]] = pack(f"<{len(ids)}I", *ids)
        for ws in split:
            yield b"".join([known[w] for w in ws])

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space (the vocabulary has no decoder of its own)."""
        s = self.strings
        return " ".join([s[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(text: str) -> Vocabulary:
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(text)
    return _LOADED[key]


def _strings(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
           digest: bool = False) -> DataFrame:
    """Encode every whole text and decode it again, one row per input row.

    ``doc_id, ids array<int>, decoded string``, or with ``digest`` ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``.  A null text counts as empty and gives no tokens; other columns are ignored;
    repeated rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest
              else f"doc_id {id_type}, ids array<int>, decoded string")

    def run(batches):
        v = _vocabulary(shared.value)
        for b in batches:
            enc = list(v.encode_texts(_strings(b.column(1))))
            if digest:
                cols = [pa.array([len(e) // 4 for e in enc], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in enc], pa.string()),
                        pa.array([hashlib.sha256(v.decode(e).encode()).hexdigest() for e in enc], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array([np.frombuffer(e, "<i4") for e in enc], pa.list_(pa.int32())),
                        pa.array([v.decode(e) for e in enc], pa.string())]
                names = ["doc_id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of id arrays (null: empty)."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        v = _vocabulary(shared.value)
        for b in batches:
            texts = [v.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(
        run, f"doc_id {id_type}, decoded string")
